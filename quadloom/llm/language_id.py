"""Language identification by fusing evidence from the text and from around it.

The posterior of a language adds, as logarithms: the likelihood of the text's character trigrams, the chance of the
language that the markup declares, the chance of the address suffix, and a prior of the host. Host priors are smoothed
hierarchically: a host's counts lean on those of its suffix, and these on the whole corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import cut, fresh, row_key, ship, small

#: Suffixes of national addresses and the language that they speak for.
SUFFIX_LANGUAGE = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en"}
BUCKETS = 1 << 15
WINDOW = 100_000
UNKNOWN = "und"
_NOISE = re.compile(r"[\d@_=/\\<>|]").search


def _grams(windows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of the characters of some windows of text, and the window of each."""
    codes = np.frombuffer("".join(windows).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(windows)), [len(t) for t in windows])
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    h = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (c * np.uint32(0xC2B2AE3D))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    same = owner[2:] == owner[:-2]
    return (h >> np.uint32(17))[same], owner[2:][same]


def _windows(text: str) -> list[str]:
    """A text in windows of bounded size that share two characters, so that each trigram is in one of them."""
    if not text:
        return []
    padded = f"  {text} "
    return [padded[lo : lo + WINDOW + 2] for lo in range(0, len(padded) - 2, WINDOW)]


def _clean(text: str | None) -> str:
    """The words, in lower case; numbers, addresses, keys and the like say nothing of a language."""
    return " ".join([w for w in (text or "").lower().split() if w.isalpha() or not _NOISE(w)])


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample_rows: int = 1500, max_languages: int = 64) -> tuple[list[str], np.ndarray]:
    """Trigram log likelihoods of each labelled language, and of unknown text (a flat distribution).

    Fitted on a bounded sample: about ``sample_rows`` rows of each label (the rows whose hash falls under its share),
    with whole texts, of the ``max_languages`` labels with most rows (ties by name). Counts are grouped in Spark; at most
    languages x ``BUCKETS`` numbers reach the driver. Rows with a null text or label train nothing.
    """
    ship(docs.sparkSession)
    labelled = docs.select(F.col(label_col).cast("string").alias("label"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("row_id")).where("label is not null and text is not null")
    sizes = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(max_languages).collect()}
    languages = sorted(sizes)
    share = F.lit(0.0)
    for label, n in sizes.items():
        share = F.when(F.col("label") == label, F.lit(min(1.0, sample_rows / n))).otherwise(share)
    sample = labelled.where(F.pmod(F.xxhash64("row_id", "text"), F.lit(1_000_003)) < share * 1_000_003).select("label", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums.setdefault(label, np.zeros(BUCKETS, np.int64))
                for window in _windows(_clean(text)):
                    sums[label] += np.bincount(_grams([window])[0], minlength=BUCKETS)
        for label, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["label", "bucket", "n"])

    counted = sample.mapInArrow(count, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((len(languages) + 1, BUCKETS))
    for label, part in counted.groupby("label"):
        table[languages.index(label), part["bucket"].to_numpy()] = part["n"].to_numpy()
    overall = table.sum(axis=0) + 0.5
    background = overall / overall.sum()
    flat = np.full(BUCKETS, 1.0 / max(1, np.count_nonzero(table.sum(axis=0))))
    for k in range(len(languages)):  # each language leans a little on all of them
        table[k] = (table[k] + 200.0 * background) / (table[k].sum() + 200.0)
    table[len(languages)] = flat
    return [*languages, UNKNOWN], np.log(table).astype(np.float32)


def _scores(docs: DataFrame, languages: list[str], table: np.ndarray, effective: float) -> DataFrame:
    """Adds ``letters`` and ``ll``, the text's log likelihoods less their maximum, and drops the text."""
    schema = T.StructType([*(f for f in docs.schema if f.name != "text"), T.StructField("letters", T.LongType()), T.StructField("ll", T.ArrayType(T.DoubleType()))])
    names = [f.name for f in schema][:-2]
    shared = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(table.T))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_p = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sums, letters = np.zeros((part.num_rows, log_p.shape[1])), []
                block: list[str] = []
                rows: list[int] = []

                def add_up(block=block, rows=rows, sums=sums) -> None:
                    h, owner = _grams(block)
                    if len(h):
                        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                        np.add.at(sums, np.array(rows)[owner[starts]], np.add.reduceat(log_p[h], starts, axis=0, dtype=np.float64))
                    block.clear()
                    rows.clear()

                held = 0
                for at, text in enumerate(part.column("text")):
                    text = _clean(text.as_py())
                    letters.append(len(text))
                    for window in _windows(text):
                        block.append(window)
                        rows.append(at)
                        held += len(window)
                        if held > 2 * WINDOW:
                            add_up()
                            held = 0
                if block:
                    add_up()
                n = np.array(letters)[:, None]
                # trigrams overlap and repeat: a text speaks as ``effective`` independent ones at most
                sums *= np.minimum(1 / 3, effective / np.maximum(n, 1))
                sums -= sums.max(axis=1, keepdims=True)
                ll = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * len(languages), pa.int32()), pa.array(sums.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(n.ravel(), pa.int64()), ll], [*names, "letters", "ll"])

    return docs.mapInArrow(run, schema)


def evidence_from_url(url: Column) -> tuple[Column, Column]:
    """Host and suffix (last label) of an address; null where there is none."""
    host = F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))
    return host, F.nullif(F.regexp_extract(host, r"\.([a-z]{2,})$", 1), F.lit(""))


def declared_in_markup(html: Column) -> Column:
    """The primary language tag of the html element, or null."""
    return F.nullif(F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)), F.lit(""))


def identify_languages(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    declared: Column | None = None,
    suffix: Column | None = None,
    host: Column | None = None,
    labels: DataFrame | None = None,
    label_col: str = "lang",
    sample_rows: int = 1500,
    max_languages: int = 64,
    carry: dict[str, Column] | None = None,
    declared_trust: float = 0.7,
    suffix_trust: float = 0.6,
    host_weight: float = 20.0,
    effective: float = 120.0,
    threshold: float = 0.5,
) -> DataFrame:
    """``doc_id, language, probability, declared, keep`` for each row of ``docs``, and the columns that ``carry`` names and makes.

    ``labels`` (default: ``docs``) trains the text model on ``label_col``. ``keep`` is false where the unknown class
    wins, no language reaches ``threshold``, or the text has no words. Defined cases: a null or blank text, or one of numbers and addresses alone, has no
    likelihood, its language is that of the other evidence, and it isn't kept; null declared, suffix or host give no
    evidence; a declared language that was never seen gives none; ties go to the first language by name; repeated rows
    and null ids are judged row by row; other columns are ignored; an empty table gives an empty result.

    Two scans of the texts at most (sample, scores); from then on only ids and a few numbers move. Priors are grouped
    sums, combined before the shuffle, so a host with a third of all rows is one row for each task.
    """
    none = F.lit(None).cast("string")
    languages, table = train(labels if labels is not None else docs, id_col=id_col, text_col=text_col, label_col=label_col, sample_rows=sample_rows, max_languages=max_languages)
    known, n = languages[:-1], len(languages)
    # aliases keep clear of the columns of docs
    carried = {f"carry_{k}": column for k, column in enumerate((carry or {}).values())}
    base = docs.select(*(column.alias(name) for name, column in carried.items()), F.col(id_col).cast("long").alias("row_id"), F.col(text_col).cast("string").alias("text"), F.lower((declared if declared is not None else none).cast("string")).alias("declared"), (suffix if suffix is not None else none).cast("string").alias("suffix"), (host if host is not None else none).cast("string").alias("host"))
    scored = cut(_scores(base, languages, table, effective))

    def likelihood(said: Column, trust: float, speaks_for: dict[str, str]) -> Column:
        """P(what is said | language) as an array of logarithms; zeros where nothing is said."""
        other = np.log((1 - trust) / max(1, n - 1))
        chance = F.array(*[F.lit(0.0)] * n)
        for tag, language in speaks_for.items():
            if language in known:
                row = [F.lit(float(np.log(trust) if x == language else other)) for x in languages]
                chance = F.when(said == tag, F.array(*row)).otherwise(chance)
        return chance

    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    local = add(add(F.col("ll"), likelihood(F.col("declared"), declared_trust, {x: x for x in known})), likelihood(F.lower("suffix"), suffix_trust, SUFFIX_LANGUAGE))
    scored = scored.withColumn("local", local)
    weights = F.transform("local", lambda x: F.exp(x - F.array_max("local")))
    soft = scored.where("letters > 0").select("host", "suffix", *[(weights[k] / F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)).alias(f"w{k}") for k in range(n)])
    sums = [F.sum(f"w{k}").alias(f"w{k}") for k in range(n)]
    by_host = soft.groupBy("host", "suffix").agg(*sums)
    by_host = cut(by_host)
    whole = by_host.agg(*sums).first()
    total = sum(whole[k] or 0.0 for k in range(n))
    corpus = [((whole[k] or 0.0) + 1.0) / (total + n) for k in range(n)]

    def lean(counts: str, prior: str) -> Column:
        return F.zip_with(counts, prior, lambda c, p: (c + host_weight * p) / (F.aggregate(counts, F.lit(host_weight), lambda s, x: s + x)))

    arr = lambda: F.array(*[F.col(f"w{k}") for k in range(n)])
    suffixes = by_host.groupBy("suffix").agg(*sums).select(F.col("suffix").alias("s"), arr().alias("c"), F.array(*map(F.lit, corpus)).alias("p")).select("s", lean("c", "p").alias("suffix_prior"))
    hosts = by_host.where("host is not null").join(small(suffixes), F.col("suffix").eqNullSafe(F.col("s"))).select("host", F.col("suffix").alias("hs"), arr().alias("c"), "suffix_prior").select("host", "hs", lean("c", "suffix_prior").alias("host_prior"))
    hosts = hosts.withColumnRenamed("host", "hh")
    judged = scored.join(small(hosts, by_host.count()), (F.col("host") == F.col("hh")) & F.col("suffix").eqNullSafe(F.col("hs")), "left")
    prior = F.coalesce("host_prior", F.array(*map(F.lit, corpus)))
    post = add(F.col("local"), F.transform(prior, lambda p: F.log(p)))
    judged = judged.select(*carried, "row_id", "letters", "declared", post.alias("post")).withColumn("top", F.array_max("post"))
    judged = judged.withColumn("probability", 1.0 / F.aggregate("post", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top"))))
    language = F.element_at(F.array(*map(F.lit, languages)), F.array_position("post", F.col("top")).cast("int"))
    judged = judged.withColumn("language", language)
    keep = (F.col("language") != UNKNOWN) & (F.col("probability") >= threshold) & (F.col("letters") > 0)
    extra = [F.col(name).alias(title) for name, title in zip(carried, carry or (), strict=True)]
    return judged.select(F.col("row_id").alias(id_col), "language", "probability", "declared", keep.alias("keep"), *extra)


def keep_known(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **evidence) -> DataFrame:
    """The rows of ``docs`` that ``identify_languages`` keeps, with the language that was found in ``lang_col``.

    ``evidence`` are further options of ``identify_languages``. Each row is judged by itself: of rows that repeat an id
    only those without a known language go, and rows with a null id go as others do; so do null, empty and blank texts.
    Rows that are equal in all columns are judged alike. An empty table gives an empty result; other columns stay.
    """
    key, said = row_key(docs), F.col(lang_col).cast("string")
    judged = identify_languages(docs, id_col=id_col, text_col=text_col, label_col=lang_col, carry={"r1": key[0], "r2": key[1], "said": said}, **evidence)
    # most rows are kept in the language that they name, and need no row here
    names = fresh(docs, "r1", "r2", "found", "kept")
    judged = judged.where(~F.col("keep") | ~F.col("said").eqNullSafe(F.col("language"))).select("r1", "r2", "language", "keep")
    judged = cut(judged.distinct()).toDF(*names)
    out = docs.join(small(judged), [k == F.col(n) for k, n in zip(key, names, strict=False)], "left").where(F.coalesce(F.col(names[3]), F.lit(True)))
    return out.withColumn(lang_col, F.coalesce(F.col(names[2]), F.col(lang_col))).drop(*names)
