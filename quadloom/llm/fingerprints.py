"""Bottom-k fingerprints of documents, with built-in functions only.

A fingerprint is the sorted array of the ``k`` least distinct 64-bit hashes of a text's word shingles. Fingerprints of
parts merge into that of the whole; two of them estimate resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import fresh

LEAST = -(1 << 63)
K = 128
SHINGLE = 5


def words_of(text: Column) -> Column:
    """Word hashes of a text, lower-cased and split at white space; null or blank: empty."""
    tokens = F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+")
    return F.transform(F.filter(tokens, lambda w: w != ""), lambda w: F.xxhash64(w))


def sketch_of(words: str, k: int = K, n: int = SHINGLE) -> Column:
    """Fingerprint from a column of word hashes; a text of fewer than ``n`` words is one shingle."""
    w = F.col(words)
    runs = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(n)]))
    whole = F.array(F.xxhash64(w))
    hashes = F.when(F.size(w) >= n, runs).when(F.size(w) > 0, whole).otherwise(F.array().cast("array<bigint>"))
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def as_text(sketch: Column) -> Column:
    """A fingerprint as text: 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def from_text(text: Column) -> Column:
    """The sketch of a fingerprint's text."""
    starts = F.sequence(F.lit(0), (F.length(text) / 16).cast("int") - 1)
    hashes = F.transform(starts, lambda i: F.conv(F.substring(text, i * 16 + 1, F.lit(16)), 16, -10).cast("bigint"))
    return F.when(F.length(text) > 0, hashes).otherwise(F.array().cast("array<bigint>"))


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The fingerprint of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness of two shingle sets, 0 to 1; two empty sets are alike (1), an empty and another not (0)."""
    both = merge(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(both, a), b))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared.cast("double") / F.size(both))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    share = (F.element_at(a, -1).cast("double") + 9.223372036854775808e18) / 1.8446744073709551616e19
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has; 1 for an empty ``a``."""
    both = distinct_shingles(merge(a, b, k), k)
    shared = resemblance(a, b, k) * both
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def fingerprint(docs: DataFrame, *, text_col: str = "text", out: str = "sketch", k: int = K, n: int = SHINGLE) -> DataFrame:
    """``docs`` with the fingerprint of each text in ``out``; no shuffle. Null, empty and blank texts have an empty one."""
    (words,) = fresh(docs, "words")
    return docs.withColumn(words, words_of(F.col(text_col).cast("string"))).withColumn(out, sketch_of(words, k, n)).drop(words)


def merge_by(sketches: DataFrame, key: str, sketch_col: str = "sketch", k: int = K, salts: int = 64) -> DataFrame:
    """One fingerprint for each ``key`` (null is a key). Hot keys are first merged in ``salts`` parts of at most k hashes."""
    from pyspark.sql import Window

    hashes = sketches.select(F.col(key).alias("key"), F.explode_outer(sketch_col).alias("h")).distinct()
    salted = hashes.withColumn("salt", F.pmod(F.xxhash64("h"), F.lit(salts)))
    # the window's rank limit is applied before the shuffle too
    part = salted.withColumn("at", F.row_number().over(Window.partitionBy("key", "salt").orderBy("h"))).where(F.col("at") <= k)
    whole = part.drop("at").withColumn("at", F.row_number().over(Window.partitionBy("key").orderBy(F.col("h").asc_nulls_last()))).where(F.col("at") <= k)
    return whole.groupBy("key").agg(F.sort_array(F.collect_list("h")).alias(sketch_col)).withColumnRenamed("key", key)


def _bounds(base: DataFrame, buckets: int) -> tuple[tuple[int, int], list[tuple[int, int]]]:
    """The place (id, hash) of the first row, and the places at which the further ranges begin; empty for an empty table.

    A range begins with an id. An id that is several percentiles fills several ranges: these begin with a hash each.
    """
    shares = [i / buckets for i in range(1, buckets)]
    least, cuts = base.agg(F.min("id"), F.percentile_approx("id", shares or [0.5], 20 * buckets)).first()
    repeats = Counter(cuts or ()) if shares else Counter()
    hot = {i: k for i, k in repeats.items() if k > 1}
    begins = [(i, LEAST) for i, k in repeats.items() if k == 1]
    if hot:
        parts = F.create_map(*[F.lit(x).cast("long") for pair in hot.items() for x in pair])
        part = F.floor((F.col("hash").cast("double") / 2.0**64 + 0.5) * parts[F.col("id")])
        begins += [(r["id"], r["first"]) for r in base.where(F.col("id").isin(*hot)).groupBy("id", part.alias("part")).agg(F.min("hash").alias("first")).collect()]
    begins.sort()
    first = (least, LEAST)
    if begins and begins[0][0] == least:  # nothing stands before it
        first = begins.pop(0)
    return first, begins


def with_next(docs: DataFrame, buckets: int, *, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text, sketch, next_text, next_sketch``: each text beside the one that follows by id; the first follows the last.

    Rows are ordered by id (a null counts as the least long), a hash of the text, and the text. They are dealt into
    ranges of about equal size; an id that fills several is split by the hash, so that only rows which are equal in id
    and text must meet. The first row of a range also goes, marked, to the end of the range before: one shuffle of the
    texts suffices, no range depends on another, and no join follows.
    """
    from pyspark.sql import Window

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("id", F.coalesce("doc_id", F.lit(LEAST))).withColumn("hash", F.xxhash64("text"))
    first, begins = _bounds(base, buckets)
    last = len(begins)
    ids, hashes = (F.array(*[F.lit(x) for x in xs]).cast("array<bigint>") for xs in (zip(*begins, strict=True) if begins else ((), ())))
    steps = [1 << k for k in reversed(range(max(1, last).bit_length()))]
    reached = lambda k: F.coalesce((F.get(ids, k) < F.col("id")) | (F.get(ids, k) == F.col("id")) & (F.get(hashes, k) <= F.col("hash")), F.lit(False))
    # binary search by falling steps
    at = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda lo, s: F.when(reached(lo + s - 1), lo + s).otherwise(lo)) if begins else F.lit(0)
    here = lambda place: (F.col("id") == place[0]) & ((place[1] == LEAST) | (F.col("hash") == place[1]))
    begin = here((F.get(ids, F.col("range") - 1), F.get(hashes, F.col("range") - 1))) if begins else F.lit(False)
    own = F.struct(F.col("range").alias("range"), F.lit(0).alias("guest"))
    before = F.struct((F.col("range") - 1).alias("range"), F.lit(1).alias("guest"))
    wrapped = F.struct(F.lit(last).alias("range"), F.lit(1).alias("guest"))
    places = F.when(here((F.lit(first[0]).cast("long"), F.lit(first[1]).cast("long"))), F.array(own, wrapped)).when(begin, F.array(own, before)).otherwise(F.array(own))
    dealt = base.withColumn("range", at).withColumn("place", F.explode(places)).select("doc_id", "id", "hash", "text", F.col("place.range").alias("range"), F.col("place.guest").alias("guest"))
    dealt = fingerprint(dealt.repartition(last + 1, "range"))
    order = Window.partitionBy("range").orderBy("guest", "id", "hash", "text")
    whole = dealt.withColumn("next_text", F.lead("text").over(order)).withColumn("next_sketch", F.lead("sketch").over(order))
    return whole.where("guest = 0").select("doc_id", "text", "sketch", "next_text", "next_sketch")


def ranges_for(docs: DataFrame) -> int:
    """Ranges of some 32 MB as Spark reckons the table's size, at least four to a shuffle partition, at most 10,000."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(10_000, size >> 25)) if size < 1 << 60 else least


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text (the last quarter replaced by the start of the next document).

    One row for each row of ``docs``. A null text is empty; equal texts have equal fingerprints; rows that repeat an id
    follow one another by a hash of the text; null ids come first; a single document follows itself; an empty table
    gives an empty result; other columns are ignored.
    """
    rows = with_next(docs, buckets or ranges_for(docs), id_col=id_col, text_col=text_col)
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next_text", F.lit(1), quarter))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    rows = fingerprint(rows, text_col="edited", out="edited_sketch")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"), distinct_shingles(F.col("sketch")).alias("distinct_shingles"),
    )
