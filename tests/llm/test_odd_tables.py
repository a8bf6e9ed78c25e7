"""Every operator and every stage on odd tables, held against brute force: ids that are null, repeat or exceed 2^53, null,
empty, blank and long texts, ties, repeated rows, an empty table, and columns of clashing names."""

import hashlib
import json
import math
import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from quadloom.llm import chat, decontaminate, fingerprints, html_extract, language_id, line_dedup, ngram_join, packing, queries, sstable, token_counts
from test_operators import LongVocab, least_edits, levenshtein, prose

DOC = "doc_id long, text string, lang string, source string, n_chars long"
BIG = 2**53 + 1
CLASH = """bucket node comp class length pos range guest host declared suffix ids value next row sketch words cluster piece id none check i h kept found r1 r2 stays gone salt salts va vb a b
    k1 k2 least_id copies size bands part first_id at hash edited_sketch next_sketch lines_dropped __id __drop __words __leaked said page_id carry_0 row_id letters ll post top local language keep probability item_id edits
    occurrences start n_tokens n_words turns apart conv_id formatted""".split()
BENCH = [(1, "one two"), (2, None), (3, " "), (3, " "), (4, "the shared passage of a benchmark that nobody should train on at all, in any form")]
LEAK = "The  shared passage of a benchmark\nthat nobody shuold train on at all, in any form"


@lru_cache
def odd_rows():
    rng = random.Random(5)
    body, other, edited = prose(rng, 60), prose(rng, 60), None
    words = body.split()
    words[30] = "changed"
    edited = " ".join(words)
    lines = [prose(rng, 9) for _ in range(4)]
    rows = [
        (1, body, "en", "a", 1), (2, body, "en", "a", 1), (2, body, "en", "a", 1), (2, other, "en", "b", 1), (3, None, None, None, None), (4, "", "en", None, 0), (5, " \n\t\n ", None, "b", 3),
        (None, edited, "en", "a", 1), (None, other, "fr", "a", 1), (None, None, None, None, None), (6, "one two", "fr", "b", 7), (7, prose(rng, 40_000), "en", "a", 1), (8, "é" * 70 + "\n" + "é" * 70, "fr", "b", 141),
        (9, "12 34 5678 a@b.c", "en", "b", 9), (9, "\n".join(lines), "en", "b", 9), (9, "\n".join(x[:-1] + "!" for x in lines[1:]) + "\nnew and only here", "en", "b", 9), (BIG, "\n".join([lines[0], "a line of its own", lines[0]]), "en", "c", 9),
        (BIG, LEAK, "en", "c", 9), (BIG - 1, "before " + LEAK.upper() + " after", "fr", "c", 9), (None, LEAK, "en", None, 9), (-(2**63), prose(rng, 20), "fr", "c", 9), (2**63 - 1, prose(rng, 20), "fr", "c", 9),
    ]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), DOC).repartition(3).withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def row_hash(text):
    h = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def last(doc_id):
    """Order by id, null last."""
    return doc_id is None, doc_id or 0


def bag(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


@lru_cache
def tokens():
    vocab = LongVocab(token_counts.read_vocabulary(str(queries.tokenizer_file("piece_bpe_32k.model"))))
    count = lru_cache(None)(vocab)
    return [sum(map(count, (r[1] or "").split())) for r in odd_rows()]


def check_packed(out, rows, lengths):
    want = Counter()
    for r, n in zip(rows, lengths, strict=True):
        want[r[0], None if n else "none"] += n
    got, bins = Counter(), defaultdict(list)
    for r in out:
        got[r.doc_id, None if r.bin is not None else "none"] += r.length
        if r.bin is not None:
            bins[r.shard, r.bin].append(r)
    assert got == want and {k for k in got} == {k for k in want}
    for held in bins.values():
        assert sum(r.length for r in held) <= 2048
        assert len({r.doc_id for r in held}) == len(held)


def test_packing(docs):
    check_packed(packing.best_fit_pack(queries.packing_items(docs)).collect(), odd_rows(), tokens())


def test_token_counts(docs):
    out = token_counts.token_counts(docs, str(queries.tokenizer_file("piece_bpe_32k.model")), carry=("source",))
    assert bag(out, "doc_id", "n_words", "n_tokens", "source") == Counter((r[0], len((r[1] or "").split()), n, r[3]) for r, n in zip(odd_rows(), tokens(), strict=True))


def brute_languages(rows, labelled, *, declared, suffix, host, declared_trust=0.7, suffix_trust=0.6, host_weight=20.0, effective=120.0):
    """(language, probability, keep) of each row, by loops: (text) and the columns of evidence."""
    buckets = language_id.BUCKETS

    def grams(text):
        clean = " ".join(w for w in (text or "").lower().split() if w.isalpha() or not any(c.isdigit() or c in "@_=/\\<>|" for c in w))
        padded, out = f"  {clean} " if clean else "", []
        for a, b, c in zip(padded, padded[1:], padded[2:], strict=False):
            h = (ord(a) * 0x9E3779B1 ^ ord(b) * 0x85EBCA77 ^ ord(c) * 0xC2B2AE3D) & 0xFFFFFFFF
            h = (ord(a) * 0x9E3779B1 & 0xFFFFFFFF) ^ (ord(b) * 0x85EBCA77 & 0xFFFFFFFF) ^ (ord(c) * 0xC2B2AE3D & 0xFFFFFFFF)
            out.append(((h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF) >> 17)
        return len(clean), out

    names = sorted({lang for _, lang in labelled if lang is not None})
    counts = {x: Counter() for x in names}
    for text, lang in labelled:
        if lang is not None and text is not None:
            counts[lang].update(grams(text)[1])
    whole = sum(counts.values(), Counter())
    total = sum(whole.values()) + 0.5 * buckets
    flat = -math.log(max(1, len(whole)))
    log_p = lambda x, g: flat if x is None else math.log((counts[x][g] + 200 * (whole[g] + 0.5) / total) / (sum(counts[x].values()) + 200))
    classes = [*names, None]
    local, letters = [], []
    for r, text in enumerate(rows):
        n, found = grams(text)
        letters.append(n)
        scale = min(1 / 3, effective / max(n, 1))
        score = [scale * sum(k * log_p(x, g) for g, k in Counter(found).items()) for x in classes]
        for said, trust in ((declared[r], declared_trust), (language_id.SUFFIX_LANGUAGE.get(suffix[r]), suffix_trust)):
            if said is not None and said in names:
                score = [s + math.log(trust if x == said else (1 - trust) / (len(classes) - 1)) for s, x in zip(score, classes, strict=True)]
        local.append(score)
    share = lambda score: (lambda w: [x / sum(w) for x in w])([math.exp(s - max(score)) for s in score])
    by = defaultdict(lambda: [0.0] * len(classes))
    for r, score in enumerate(local):
        if letters[r]:
            for key in ((host[r], suffix[r]), ("suffix", suffix[r], 0), "whole"):
                by[key] = [a + b for a, b in zip(by[key], share(score), strict=True)]
    corpus = [(x + 1) / (sum(by["whole"]) + len(classes)) for x in by["whole"]]
    lean = lambda c, p: [(x + host_weight * q) / (sum(c) + host_weight) for x, q in zip(c, p, strict=True)]
    out = []
    for r, score in enumerate(local):
        key = (host[r], suffix[r])
        prior = lean(by[key], lean(by["suffix", suffix[r], 0], corpus)) if host[r] is not None and key in by else corpus
        post = share([s + math.log(p) for s, p in zip(score, prior, strict=True)])
        top = max(range(len(classes)), key=lambda k: (post[k], -k))
        out.append((classes[top] or "und", post[top], classes[top] is not None and post[top] >= 0.5 and letters[r] > 0))
    return out


def test_languages(docs):
    rows = odd_rows()
    labelled = [(r[1], r[2]) for r in rows]
    want = brute_languages([r[1] for r in rows], labelled, declared=[r[2] for r in rows], suffix=[None] * len(rows), host=[r[3] for r in rows])
    out = language_id.identify_languages(docs, declared=F.col("lang"), host=F.col("source")).collect()
    assert sorted((last(r.doc_id), r.language, round(r.probability, 4), r.keep) for r in out) == sorted((last(d[0]), x, round(p, 4), k) for d, (x, p, k) in zip(rows, want, strict=True))


def test_language_query_by_brute_force(spark):
    """Documents and pages, with all evidence, on the smallest tables."""
    sf = "/root/testdata/sf0.001"
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r.doc_id)
    pages = sorted(spark.read.parquet(f"{sf}/pages.parquet").collect(), key=lambda r: r.page_id)
    hosts = [r.url.split("://")[1].split("/")[0].split(":")[0].split("?")[0].split("#")[0].lower() for r in pages]
    said = [r.html.lower().split('lang="')[1][:2] if 'lang="' in r.html.lower().split(">")[1] + r.html.lower().split(">")[0] else None for r in pages]
    n = len(docs)
    want = brute_languages([r.text for r in docs] + [html_extract.extract(r.html) for r in pages], [(r.text, r.lang) for r in docs], declared=[r.lang for r in docs] + said, suffix=[None] * n + [h.rsplit(".", 1)[1] for h in hosts], host=[r.source for r in docs] + hosts)
    out = {(r.doc_id, r.page_id): r for r in queries.op3_language_id(spark, sf).collect()}
    for key, (language, probability, keep) in zip([(r.doc_id, None) for r in docs] + [(None, r.page_id) for r in pages], want, strict=True):
        assert (out[key].language, out[key].keep) == (language, keep) and abs(out[key].probability - probability) < 1e-3
    assert len(out) == len(want)


def test_fingerprints(docs):
    rows = sorted(odd_rows(), key=lambda r: (-(2**63) if r[0] is None else r[0], row_hash(r[1]), r[1] or ""))
    want = Counter()
    for r, after in zip(rows, rows[1:] + rows[:1], strict=True):
        text, q = r[1] or "", len(r[1] or "") // 4
        want[r[0], len(text), hashlib.sha256((text[: len(text) - q] + (after[1] or "")[:q]).encode()).hexdigest()] += 1
    for buckets in (1, 7, 60):
        out = fingerprints.edited_fingerprints(docs, buckets=buckets)
        assert bag(out, "doc_id", "n_chars", "edited_sha256") == want
    assert len({(r.text, r.sketch) for r in fingerprints.fingerprint(docs.select("text")).select("text", F.col("sketch").cast("string").alias("sketch")).collect()}) == len({r[1] for r in rows})


def test_fingerprints_split_an_id_that_repeats(spark):
    rows = [(5, f"text {k} with words of its own to shingle") for k in range(300)] + [(k, f"other {k}") for k in range(100)] + [(5, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted(((d, row_hash(t), t or "") for d, t in rows))
    want = Counter((a[2], b[2]) for a, b in zip(order, order[1:] + order[:1], strict=True))
    for buckets in (2, 16, 50):
        base = docs.select(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
        assert len(fingerprints._bounds(base, buckets)[1]) > buckets // 2 - 1
        assert bag(fingerprints.with_next(docs, buckets, id_col="doc_id", text_col="text"), "text", "next_text") == want


def grams(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_classes(rows):
    """Class number and number of links of each row."""
    sets, parent, links = [grams(r[1]) for r in rows], list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j and len(a & b) >= 0.8 * len(a | b):
                links[i] += 1
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(rows))], links


def test_join(docs):
    rows = odd_rows()
    classes, links = brute_classes(rows)
    least = {c: min((r[0] for r, k in zip(rows, classes, strict=True) if k == c and r[0] is not None), default=None) for c in set(classes)}
    assert bag(ngram_join.ngram_join(docs), "doc_id", "class_id", "n_links") == Counter((r[0], least[c], n) for r, c, n in zip(rows, classes, links, strict=True))


def brute_join_kept(rows):
    classes, _ = brute_classes(rows)
    return Counter(min((r for r, k in zip(rows, classes, strict=True) if k == c), key=lambda r: (last(r[0]), row_hash(r[1])))[:2] for c in set(classes))


def brute_lines(rows):
    """(id, text, lines dropped) of each row."""
    lines = sorted({x.strip(" ") for r in rows for x in (r[1] or "").split("\n") if 30 <= len(x.strip(" ")) < 1000})
    parent = {x: x for x in lines}

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[i + 1 :]:
            if abs(len(a) - len(b)) <= 2 and levenshtein(a, b) <= 2:
                parent[find(a)] = find(b)
    owner = {}
    for r in sorted((r for r in rows if r[1] is not None), key=lambda r: (last(r[0]), row_hash(r[1]))):
        for pos, x in enumerate(r[1].split("\n")):
            owner.setdefault(find(x.strip(" ")), (r[0], r[1], pos))
    out = []
    for r in rows:
        kept = None if r[1] is None else [x for pos, x in enumerate(r[1].split("\n")) if len(x.strip(" ")) < 10 or owner[find(x.strip(" "))] == (r[0], r[1], pos)]
        out.append((r[0], None if kept is None else "\n".join(kept), 0 if kept is None else len(r[1].split("\n")) - len(kept)))
    return out


def test_lines(docs):
    want = brute_lines(odd_rows())
    assert bag(line_dedup.dedup_lines(docs), "doc_id", "text", "lines_dropped") == Counter(want)
    assert sum(n for *_, n in want) > 8 and any("new and only here" in (t or "") for _, t, _ in want)


def test_token_output(spark, docs):
    from tokenizers import Tokenizer

    path = str(queries.tokenizer_file("word_bpe_49k.json"))
    plain, want = Tokenizer.from_file(path), Counter()
    for r in odd_rows():
        ids = [*plain.encode(r[1] or "", add_special_tokens=False).ids, 1]
        want[r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    out = sstable.read_shards(spark, sstable.write_shards(docs, path))
    assert bag(out, "doc_id", "n_tokens", "ids_crc32") == want
    starts = sorted((r.start, r.n_tokens, r.doc_id) for r in out.collect())
    assert all(a[0] + a[1] == b[0] for a, b in zip(starts, starts[1:], strict=False)) and [d for *_, d in starts] == sorted((d for *_, d in starts), key=lambda d: (d is not None, d or 0))


def brute_leaks(text):
    level = " ".join((text or "").lower().split())[:20_000]
    return {i: n for i, item in BENCH if item and item.strip() and (n := least_edits(item, level)) <= int(len(item) * 0.08)}


def test_leaks(spark, docs):
    out = decontaminate.find_leaks(docs, spark.createDataFrame(BENCH, "item_id long, text string"))
    want = Counter((r[0], i, n) for r in odd_rows() for i, n in brute_leaks(r[1]).items())
    assert bag(out, "doc_id", "item_id", "edits") == want and len(want) >= 4
    assert decontaminate.find_leaks(docs, spark.createDataFrame([], "item_id long, text string")).collect() == []


def test_chat(docs):
    turns = docs.select(F.col("doc_id").alias("conv_id"), F.lit(1).alias("turn"), F.when(F.col("lang") == "en", "assistant").alias("role"), "text")
    groups = defaultdict(list)
    for r in odd_rows():
        role, text = "assistant" if r[2] == "en" else "", r[1] or ""
        groups[r[0] if r[0] is not None else (role, text)].append((role, text))
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = Counter((k if isinstance(k, int) else None, len(g), digest("".join(f"{a}\n{b}\n" for a, b in sorted(g))), digest("".join(b for a, b in sorted(g) if a))) for k, g in groups.items())
    assert bag(chat.read_back(chat.format_conversations(turns)), "conv_id", "n_turns", "turns_sha256", "loss_sha256") == want


def test_html(docs):
    pages = docs.drop("page_id").withColumnRenamed("doc_id", "page_id").withColumn("html", F.concat(F.lit("<p>"), "text")).withColumn("url", F.lit("u"))
    want = Counter((r[0], "u", " ".join((r[1] or "").split())) for r in odd_rows())
    assert bag(html_extract.extract_pages(pages), "page_id", "url", "text") == want


STAGES = dict(corpus_pipeline.STAGES)


def test_language_stage(docs, sf_dir):
    rows = odd_rows()
    want = brute_languages([r[1] for r in rows], [(r[1], r[2]) for r in rows], declared=[r[2] for r in rows], suffix=[None] * len(rows), host=[r[3] for r in rows])
    out = STAGES["language_id"](docs.sparkSession, docs, sf_dir)
    assert out.columns == corpus_pipeline.COLUMNS
    assert bag(out, *out.columns) == Counter((r[0], r[1], x, r[3], r[4]) for r, (x, _, keep) in zip(rows, want, strict=True) if keep)


def test_line_stage(docs, sf_dir):
    out = STAGES["line_dedup"](docs.sparkSession, docs, sf_dir)
    assert bag(out, "doc_id", "text", "n_chars") == Counter((d, t, None if t is None else len(t)) for d, t, n in brute_lines(odd_rows()) if not n or t.strip(" "))


def test_join_stage(docs, sf_dir):
    out = STAGES["ngram_jaccard_join"](docs.sparkSession, docs, sf_dir)
    got = bag(out, "doc_id", "text")
    plain = brute_join_kept([r for r in odd_rows() if grams(r[1])])
    assert {k: n for k, n in got.items() if grams(k[1])} == plain
    assert [k[0] for k in got if not grams(k[1])] == [3]


def test_benchmark_stage(docs, sf_dir):
    out = STAGES["benchmark_decontamination"](docs.sparkSession, docs, sf_dir)
    assert bag(out, *out.columns) == Counter(r for r in odd_rows() if not brute_leaks(r[1]))


def test_packing_stage(docs, sf_dir):
    check_packed(STAGES["best_fit_packing"](docs.sparkSession, docs, sf_dir).collect(), odd_rows(), tokens())


@pytest.mark.parametrize("name", STAGES)
def test_stages_on_an_empty_table(docs, sf_dir, name):
    assert STAGES[name](docs.sparkSession, docs.limit(0), sf_dir).collect() == []


def test_operators_on_an_empty_table(spark, docs):
    none, path = docs.limit(0), str(queries.tokenizer_file("word_bpe_49k.json"))
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    pages = none.drop("page_id").withColumnRenamed("doc_id", "page_id").withColumn("html", F.col("text")).withColumn("url", F.lit("u"))
    turns = none.select(F.col("doc_id").alias("conv_id"), F.lit(1).alias("turn"), F.lit("user").alias("role"), "text")
    for made in (
        token_counts.token_counts(none, str(queries.tokenizer_file("piece_bpe_32k.model"))), language_id.identify_languages(none), fingerprints.edited_fingerprints(none), ngram_join.ngram_join(none), line_dedup.dedup_lines(none),
        sstable.read_shards(spark, sstable.write_shards(none, path)), decontaminate.find_leaks(none, bench), chat.read_back(chat.format_conversations(turns)), html_extract.extract_pages(pages),
    ):
        assert made.collect() == []
    assert sstable.lookup([], 5) is None and json.dumps(sstable.write_shards(none, path)) == "[]"


def test_one_row(spark):
    one = spark.createDataFrame([(5, "just one row of text", "en", "a", 20)], DOC)
    assert ngram_join.ngram_join(one).collect() == [(5, 5, 0)]
    assert line_dedup.dedup_lines(one).first().lines_dropped == 0
    assert fingerprints.edited_fingerprints(one).first().near_next == 1.0
