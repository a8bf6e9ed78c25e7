"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on odd tables."""

import hashlib
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from quadloom.llm import chat, decontaminate, fingerprints, html_extract, language_id, line_dedup, linking, ngram_join, packing, queries, sstable, token_counts
from quadloom.llm.components import components
from quadloom.llm.shingles import BoundedCache, shingle_hashes

DOC = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"
WORDS = [a + b + c for a in ("ka", "lo", "mi", "ter", "sun") for b in ("ra", "ne", "vi", "dol", "pex") for c in ("", "s", "ta")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# packing


def brute_pack(rows, capacity):
    """The same placement by looking at every bin; rows are (length, source, cluster, doc) in packing order."""
    bins = []
    for length, source, cluster, doc in rows:
        fit = [(left, b) for b, (left, held) in enumerate(bins) if left >= length and not any((source is not None and s == source) or (cluster is not None and c == cluster) or d == doc for s, c, d in held)]
        b = min(fit)[1] if fit else len(bins)
        if not fit:
            bins.append((capacity, []))
        left, held = bins[b]
        bins[b] = (left - length, [*held, (source, cluster, doc)])
        yield b, capacity - left


@pytest.mark.parametrize("sources", [1, 6, 400])
def test_packing_is_the_tightest_fit(sources):
    rng = random.Random(1)
    rows = sorted(((rng.randint(1, 60), rng.choice([None, *range(sources)]), rng.choice([None, *range(30)]), i // 2) for i in range(400)), key=lambda r: -r[0])
    fit = packing.BestFit(64)
    assert [fit.add(*r) for r in rows] == list(brute_pack(rows, 64))


def test_packing_one_source_is_fast():
    fit, began = packing.BestFit(2048), time.perf_counter()
    assert [fit.add(1 + k % 700, "one", None, None)[0] for k in range(20_000)] == list(range(20_000))
    assert time.perf_counter() - began < 10


def test_packing_keeps_large_ids(spark):
    items = spark.createDataFrame([(2**53 + 1, 5, "a", 1), (None, 5, "b", 2), (2**53 + 1, 5, "a", 1), (None, None, None, None)], "doc_id long, length long, source string, cluster long")
    out = packing.best_fit_pack(items, 10).collect()
    assert Counter((r.doc_id, r.length) for r in out) == {(2**53 + 1, 5): 2, (None, 5): 1, (None, 0): 1}
    assert len({(r.shard, r.bin) for r in out if r.doc_id}) == 2


def test_packing_is_whole_and_keeps_apart(spark):
    items = spark.createDataFrame([(i, 1 + i * 37 % 5000, f"s{i % 3}" if i % 4 else None, i % 50 if i % 5 else None) for i in range(600)], "doc_id long, length long, source string, cluster long")
    out = packing.best_fit_pack(items, 1000, shard_pieces=500).collect()
    placed = defaultdict(list)
    held = Counter()
    row = {r.doc_id: r for r in items.collect()}
    for r in out:
        held[r.doc_id] += r.length
        placed[r.shard, r.bin].append(r)
    assert held == {i: r.length for i, r in row.items()}
    for pieces in placed.values():
        pieces.sort(key=lambda r: r.bin_offset)
        assert all(a.bin_offset + a.length == b.bin_offset for a, b in zip(pieces, pieces[1:], strict=False))
        assert sum(r.length for r in pieces) <= 1000
        for key in ("source", "cluster"):
            seen = [row[r.doc_id][key] for r in pieces if row[r.doc_id][key] is not None]
            assert len(seen) == len(set(seen))


# token counts


def brute_count(pieces, word):
    """Greedy longest match by trying every prefix."""
    vocab = {p for p in pieces if p and "▁" not in p[1:]}
    rest, n = "▁" + word, 0
    while rest:
        k = next((k for k in range(len(rest), 0, -1) if rest[:k] in vocab), 0)
        n += 1 if k else len(rest[0].encode())
        rest = rest[k or 1 :]
    return n


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab▁é", min_size=1, max_size=5), max_size=14), st.lists(st.text("abcé", max_size=12), max_size=5))
def test_counts_are_greedy(pieces, words):
    automaton = token_counts.LongestMatch(pieces)
    for word in words:
        assert automaton.count(word) == brute_count(pieces, word)


def test_counts_query(spark):
    pieces = token_counts.read_vocabulary(str(queries.tokenizer_file("piece_bpe_32k.model")))
    vocab = LongVocab(pieces)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(20).collect()}
    for r in queries.op2_token_counts(spark, SF).where(F.col("doc_id").isin(*texts)).collect():
        assert (r.n_words, r.n_tokens) == (len(texts[r.doc_id].split()), sum(map(vocab, texts[r.doc_id].split())))


class LongVocab:
    def __init__(self, pieces):
        self.vocab = {p for p in pieces if "▁" not in p[1:]}

    def __call__(self, word):
        rest, n = "▁" + word, 0
        while rest:
            k = next((k for k in range(min(len(rest), 24), 0, -1) if rest[:k] in self.vocab), 0)
            n += 1 if k else len(rest[0].encode())
            rest = rest[k or 1 :]
        return n


# language


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, rest = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1 and n_chars > 100")
    out = language_id.identify_languages(rest, labels=train).join(rest.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.language == r.lang for r in out) / len(out) > 0.97
    assert sum(r.keep for r in out) / len(out) > 0.99


def test_language_evidence(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    page = spark.createDataFrame([(1, "", "<html lang='fr-FR'>", "https://blog.exemple.fr/x"), (2, "", "<HTML class=a LANG=de>", "http://x.de:80/"), (3, "", "<html>", "nothing")], "doc_id long, text string, html string, url string")
    host, suffix = language_id.evidence_from_url(F.col("url"))
    assert [tuple(r) for r in page.select(host, suffix).collect()] == [("blog.exemple.fr", "fr"), ("x.de", "de"), (None, None)]
    out = {r.doc_id: r for r in language_id.identify_languages(page, declared=language_id.declared_in_markup(F.col("html")), host=host, suffix=suffix, labels=docs).collect()}
    assert out[1].language == "fr" and out[2].language == "de" and not out[3].keep


# fingerprints


def test_fingerprints_query(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    out = {r.doc_id: r for r in queries.op4_document_fingerprints(spark, SF).collect()}
    grams = lambda t: set(shingle_hashes(t).tolist())
    for (doc_id, text), (_, following) in zip(docs, docs[1:] + docs[:1], strict=True):
        q = len(text) // 4
        edited = text[: len(text) - q] + following[:q]
        r = out[doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for estimate, other in ((r.near_edited, edited), (r.near_next, following)):
            a, b = grams(text), grams(other)
            assert abs(estimate - len(a & b) / len(a | b)) < 0.2
        assert abs(r.distinct_shingles / len(grams(text)) - 1) < 0.5
        assert r.edited_fingerprint == out[doc_id].edited_fingerprint and len(r.fingerprint) <= 16 * fingerprints.K


def test_fingerprints_merge(spark):
    rng = random.Random(2)
    a, b = prose(rng, 300), prose(rng, 300)
    rows = spark.createDataFrame([(1, a), (1, b), (2, a), (3, None), (4, a)], "key long, text string")
    sketched = fingerprints.fingerprint(rows)
    merged = {r.key: r.sketch for r in fingerprints.merge_by(sketched, "key", salts=4).collect()}
    single = {r.key: r.sketch for r in sketched.where("key > 1").collect()}
    assert merged[2] == single[2] == single[4] and merged[3] == []
    both = sketched.where("key = 1").agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("sketch")))), 1, fingerprints.K).alias("s")).first().s
    assert merged[1] == both
    near = sketched.where("key = 2").select(fingerprints.from_text(fingerprints.as_text(F.col("sketch"))).alias("back"), "sketch", fingerprints.containment(F.col("sketch"), F.col("sketch")).alias("c")).first()
    assert near.back == near.sketch and near.c == 1.0


@pytest.mark.parametrize("buckets", [1, 3, 40])
def test_next_document_over_ranges(spark, buckets):
    ids = [-5, 7, 7, 100, 3, 9_000_000_000, 42, None, 12, 13]
    docs = spark.createDataFrame([(x, f"text {i} of many words here to shingle {x}" + "z" * i) for i, x in enumerate(ids)], "doc_id long, text string")
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    hashed = lambda t: signed(xxhash.xxh64_intdigest(t.encode(), 42))
    # rows that repeat an id follow one another by a hash of the text, so that one id can fill several ranges
    rows = sorted(((x is not None, x or 0, t) for x, t in docs.collect()), key=lambda r: (*r[:2], hashed(r[2])))
    want = Counter((t, u) for (_, _, t), (_, _, u) in zip(rows, rows[1:] + rows[:1], strict=True))
    got = Counter((r.text, r.next_text) for r in fingerprints.with_next(docs, buckets, id_col="doc_id", text_col="text").collect())
    assert got == want


# n-gram join


def near_groups(rng):
    rows, doc_id = [], 0
    for size in (1, 2, 3, 40, 120):
        base = prose(rng, 90).split()
        for k in range(size):
            words = list(base)
            for _ in range(rng.choice((0, 1, 1, 2, 3))):
                words[rng.randrange(90)] = f"edit{rng.randrange(10**6)}"
            rows.append((doc_id, " ".join(words)))
            doc_id += 1
    return rows + [(1000 + i, prose(rng, 60)) for i in range(60)]


def brute_classes(rows, threshold=0.8):
    sets = {d: set(shingle_hashes(t).tolist()) for d, t in rows}
    parent = {d: d for d in sets}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: find(d) for d in sets}


def brute_links(rows, threshold=0.8):
    sets = {d: set(shingle_hashes(t).tolist()) for d, t in rows}
    return {a: sum(a != b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) for b in sets) for a in sets}


def test_join_finds_all_classes(spark):
    rows = near_groups(random.Random(3))
    out = {r.doc_id: r for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_classes(rows)
    assert {d: r.class_id for d, r in out.items()} == want
    assert {d: r.n_links for d, r in out.items()} == brute_links(rows)


@pytest.mark.parametrize("grams", [ngram_join.CHUNK_GRAMS, 600])
def test_join_counts_all_links(spark, monkeypatch, grams):
    """A chained class of many different texts, in one chunk and in several."""
    monkeypatch.setattr(ngram_join, "CHUNK_GRAMS", grams)
    rng = random.Random(11)
    words, rows = prose(rng, 70).split(), []
    for d in range(90):
        if rng.random() < 0.3:
            words[rng.randrange(len(words))] = f"w{d}"
        rows.append((d, " ".join(words)))
    rows += [(200 + d, prose(rng, 30)) for d in range(10)] + [(7, rows[7][1]), (300, None)]
    out = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"))
    twice = rows[7][1]  # the row that repeats an id is a document too
    want = brute_links(rows[:-2] + [(1000, twice), (300, None)])
    got = sorted((r.doc_id, r.n_links) for r in out.collect())
    assert got == sorted((7 if d == 1000 else d, n) for d, n in want.items()) and max(n for _, n in got) > 8
    assert ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), count_links=False).columns == ["doc_id", "class_id"]


def test_near_matrix():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 60)
    sets = [np.unique(np.r_[base[rng.random(60) < 0.95], rng.integers(0, 1 << 62, rng.integers(0, 6))]) for _ in range(40)] + [np.unique(rng.integers(0, 1 << 62, 9))]

    def near(x, y):
        both = len(np.intersect1d(x, y))
        return both >= 0.8 * (len(x) + len(y) - both)

    for a, b in ((sets, sets), (sets[:17], sets[17:])):
        assert ngram_join.near_matrix(a, b, 0.8).tolist() == [[near(x, y) for y in b] for x in a]


def test_large_buckets_lose_no_pair(spark):
    """Groups of near copies at every likeness around the threshold: each link between different classes is found."""
    rng, rows, doc_id = random.Random(12), [], 0
    for _ in range(4):
        base = prose(rng, 120).split()
        for _ in range(70):
            words = list(base)
            for _ in range(rng.randint(0, 5)):
                words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
            rows.append((doc_id, " ".join(words)))
            doc_id += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, links = brute_classes(rows), brute_links(rows)
    out = ngram_join.ngram_join(docs).collect()
    assert {r.doc_id: r.class_id for r in out} == want and {r.doc_id: r.n_links for r in out} == links
    assert {r.doc_id for r in ngram_join.drop_near_duplicates(docs).collect()} == set(want.values())


@pytest.mark.parametrize("same", [True, False])
def test_connecting_links(same):
    """Links between two chunks: as many as it takes to connect what is near, and none between sets that are not."""
    rng = np.random.default_rng(6)
    bases = [rng.integers(0, 1 << 62, 50) for _ in range(3)]
    sets = [np.unique(np.r_[bases[k % 3][rng.random(50) < 0.94], rng.integers(0, 1 << 62, rng.integers(0, 3))]) for k in range(36)]
    node, chunk = np.arange(36) + 100, np.zeros(36, np.int64) if same else np.arange(36) % 2
    comp = np.where(np.arange(36) < 12, np.arange(36) % 3 + 900, node)
    table = pa.table({"node": node, "comp": comp, "chunk": chunk, "value": pa.array([x.tolist() for x in sets], pa.list_(pa.int64())), "lo": np.zeros(36, np.int64), "hi": np.full(36, 0 if same else 1)})
    out = ngram_join._connect(table, 0.8)
    near = lambda x, y: len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y))
    pairs = list(zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True))
    assert all(near(sets[a - 100], sets[b - 100]) for a, b in pairs) and len(pairs) < 36
    group = {int(n): int(c) for n, c in zip(node, comp, strict=True)}
    merge = lambda g, x, y: {n: g[x] if c == g[y] else c for n, c in g.items()}
    want = dict(group)
    for i in range(36):
        for j in range(36):
            if (same or chunk[i] != chunk[j]) and near(sets[i], sets[j]):
                want = merge(want, 100 + i, 100 + j)
    for a, b in pairs:
        group = merge(group, a, b)
    blocks = lambda g: {frozenset(n for n in g if g[n] == c) for c in g.values()}
    assert blocks(group) == blocks(want)


def test_values_of_hubs(spark):
    pairs = spark.createDataFrame([(1, k) for k in range(2, 90)] + [(2, 3), (4, 3)], "a long, b long")
    values = spark.createDataFrame([(k, f"v{k}") for k in range(1, 90)], "node long, value string")
    for rows in (8, 1000):
        out = linking.with_values(pairs, values, rows).collect()
        assert sorted((r.a, r.b) for r in out) == sorted(map(tuple, pairs.collect())) and all((r.va, r.vb) == (f"v{r.a}", f"v{r.b}") for r in out)


def test_band_layout():
    bands, rows = ngram_join.band_layout(0.8, 0.999, 256)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= 256


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)] + [(1, None), (5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent)}


# lines


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.text("abc", max_size=14), st.text("abc", max_size=14), st.integers(0, 4))
def test_banded_edit_distance(a, b, threshold):
    d = levenshtein(a, b)
    assert line_dedup.edit_distance_within(a, b, threshold) == (d if d <= threshold else None)


@pytest.mark.parametrize("chunk", [4, linking.CHUNK])
def test_blocks_of_a_bucket_lose_no_connection(spark, monkeypatch, chunk):
    """Classes that are near in some bucket are joined, whatever the blocks, and nothing else is."""
    monkeypatch.setattr(linking, "CHUNK", chunk)
    rng = random.Random(9)
    values = {node: rng.randrange(400) for node in range(150)}
    comp = {node: node if node % 3 else node % 2 for node in values}  # a third in two classes, the others alone
    live = [(bucket, node, int(rng.random() < 0.5), comp[node]) for bucket in (1, 2) for node in sorted(rng.sample(range(150), 90))]
    near = lambda one, others: [abs(one - other) <= 2 for other in others]
    links = linking.near_apart(spark.createDataFrame(live, "bucket long, node long, indexed int, comp long"), spark.createDataFrame(list(values.items()), "node long, payload long"), near)
    links = [tuple(r) for r in links.collect()]
    pairs = {(x[1], y[1]) for x in live for y in live if x[0] == y[0] and x[3] != y[3] and x[2] + y[2] > 0 and abs(values[x[1]] - values[y[1]]) <= 2}
    assert set(links) <= pairs

    def classes(joined):
        top = dict(comp)
        for a, b in joined:
            old, new = top[a], top[b]
            top = {node: new if c == old else c for node, c in top.items()}
        return {frozenset(node for node in top if top[node] == c) for c in set(top.values())}

    assert classes(links) == classes(pairs)


def test_lines_against_brute_force(spark):
    rng = random.Random(6)
    pool = [prose(rng, rng.randint(6, 14)) for _ in range(40)] + ["short line x"]
    shared = "the same opening words of very many lines "  # one hot segment
    pool += [shared + prose(rng, 8) for _ in range(90)]

    def edit(line):
        out = list(line)
        for _ in range(rng.choice((0, 0, 1, 2))):
            i = rng.randrange(len(out))
            k = rng.random()
            out[i : i + (k < 0.6)] = rng.choice("xyz") if k > 0.3 else ""
        return "".join(out)

    docs = [(d, "\n".join(edit(rng.choice(pool)) if rng.random() < 0.9 else "  " for _ in range(6))) for d in range(80)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    lines = sorted({x.strip(" ") for _, t in docs for x in t.split("\n") if len(x.strip(" ")) >= 10})
    parent = {x: x for x in lines}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[i + 1 :]:
            if len(a) >= 30 and len(b) >= 30 and abs(len(a) - len(b)) <= 2 and find(a) != find(b) and line_dedup.edit_distance_within(a, b, 2) is not None:
                parent[find(b)] = find(a)
    seen, want = set(), {}
    for d, t in docs:
        kept = []
        for raw in t.split("\n"):
            line = raw.strip(" ")
            if len(line) < 10 or find(line) not in seen:
                kept.append(raw)
            if len(line) >= 10:
                seen.add(find(line))
        want[d] = "\n".join(kept)
    assert got == want


def test_lines_near_from_thirty_characters(spark, tmp_path):
    rng = random.Random(8)
    texts = []
    for n in range(28, 52):
        line = "".join(rng.choice("abcdefgh") for _ in range(n))
        texts += [line, f"{line[: n // 2]}+{line[n // 2 + 1 : -1]}.", line[:9] + line[10:]]  # two substitutions, a deletion
    spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in enumerate(texts)], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    near = lambda x, y: min(len(x), len(y)) >= 30 and levenshtein(x, y) <= 2
    want = {d: int(any(near(t, u) for u in texts[:d])) for d, t in enumerate(texts)}
    assert [want[d] for d in range(9)] == [0, 0, 0, 0, 0, 0, 0, 1, 0]
    assert {r.doc_id: r.lines_dropped for r in queries.op6_line_dedup(spark, str(tmp_path)).collect()} == want
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id for r in corpus_pipeline.line_stage(spark, docs, str(tmp_path)).collect()} == {d for d, n in want.items() if not n}


# token output


def test_tokens_round_trip(spark):
    from tokenizers import Tokenizer

    path = str(queries.tokenizer_file("word_bpe_49k.json"))
    plain = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10**12, "It's, O'Neil's ÉCLAIR. <|endoftext|> <|ENDOFTEXT|> İ. Σας A. ..,"), (-3, None)], "doc_id long, text string"))
    manifest = sstable.write_shards(docs, path, shards=5)
    got = {r.doc_id: r for r in sstable.read_shards(spark, manifest).collect()}
    start = 0
    for doc_id, text in sorted(docs.collect()):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        r = got[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        if doc_id % 40 == 0:
            assert sstable.lookup(manifest, doc_id).tolist() == ids
    assert len(manifest) > 1 and sstable.lookup(manifest, 123_456_789) is None


@pytest.mark.parametrize("shards", [1, 4])
def test_lookup_finds_nulls_and_repeats(spark, shards):
    path = str(queries.tokenizer_file("word_bpe_49k.json"))
    rows = [(None, "the first"), (None, None), (5, "one"), (6, None), *((7, f"the text {k} of seven") for k in range(40)), (2**53 + 1, "last")]
    manifest = sstable.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), path, shards=shards)
    from tokenizers import Tokenizer

    ids = lambda t: [*Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids, 1]
    for doc_id in (None, 5, 6, 7, 2**53 + 1, 2**53, -4):
        want = sorted(ids(t) for d, t in rows if d == doc_id)
        assert sorted(x.tolist() for x in sstable.lookup_all(manifest, doc_id)) == want
        one = sstable.lookup(manifest, doc_id)
        assert one is None if not want else one.tolist() in want


@settings(max_examples=100, deadline=None)
@given(st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)), st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)))
def test_keys_sort_as_ids(a, b):
    assert sstable.split_key(sstable.make_key(a, 3)) == (a, 3)
    order = lambda x: (x is not None, x or 0)
    assert (sstable.make_key(a) < sstable.make_key(b)) == (order(a) < order(b))


def test_cache_is_bounded():
    made = []
    cache = BoundedCache(lambda k: made.append(k) or k * 2, 10)
    assert [cache[i] for i in (*range(25), 3, 24, 24)] == [*(2 * i for i in range(25)), 6, 48, 48]
    assert len(cache) <= 10 and len(cache.older) <= 10


# decontamination


def least_edits(pattern, text):
    """Least edits of the pattern against any part of a text, by the whole table."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (x != c)))
        row, best = new, min(best, new[-1])
    return best


def test_leaks_against_brute_force(spark):
    rng = random.Random(7)
    items = [(i, prose(rng, rng.choice((2, 4, rng.randint(12, 40))))) for i in range(14)]
    docs, want = [], {}
    for d in range(40):
        text = prose(rng, 100)
        if d % 3 == 0:
            _, item = rng.choice(items)
            chars = list(item)
            for _ in range(rng.randint(0, int(len(item) * 0.08) + 1)):
                k = rng.randrange(len(chars))
                chars[k : k + rng.randint(0, 1)] = rng.choice(("", "q", "qq"))
            text = text[:200] + " \n" + "".join(chars).upper() + "\n " + text[200:]
        docs.append((d, text))
        level = " ".join(text.lower().split())
        want |= {(d, i): n for i, item in items if (n := least_edits(item, level)) <= int(len(item) * 0.08)}
    bench = spark.createDataFrame(items, "item_id long, text string")
    corpus = spark.createDataFrame(docs, "doc_id long, text string")
    for block in (1_000_000, 300):
        assert {(r.doc_id, r.item_id): r.edits for r in decontaminate.find_leaks(corpus, bench, block_chars=block).collect()} == want
    assert {r.doc_id for r in decontaminate.drop_leaks(corpus, bench, block_chars=300).collect()} == set(range(40)) - {d for d, _ in want}
    assert len({d for d, _ in want}) > 8


def test_budget_is_reached():
    rng = random.Random(10)
    for n in (28, 100, 400):
        item = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        edits = n * 8 // 100
        assert decontaminate.budget(item, 0.08) == edits
        chars = list(item)
        for k in range(edits):
            chars[(2 * k + 1) * n // (2 * edits)] = "."
        assert [x[:2] for x in decontaminate.Matcher([(1, item)], 0.08).find("xy " + "".join(chars) + " z")] == [(1, edits)]


def test_leaks_cut_at_the_ends_of_a_text():
    rng = random.Random(9)
    item = prose(rng, 45)
    edits = int(len(item) * 0.08)
    matcher = decontaminate.Matcher([(1, item)], 0.08)
    other = " " + prose(rng, 60)
    assert edits > 10
    for n in range(edits + 1):
        for text in (item[n:], item[n:] + other, item[: len(item) - n], other[1:] + " " + item[: len(item) - n]):
            least = least_edits(item, text)
            assert least <= n and [x[:2] for x in matcher.find(text)] == [(1, least)]
    twice = item[3:] + other + " " + item
    assert matcher.find(twice) == [(1, 0, 2)]


@settings(max_examples=200, deadline=None)
@given(st.text("ab", min_size=1, max_size=8), st.text("ab", max_size=12))
def test_best_match(pattern, text):
    assert decontaminate.best_match(pattern, text)[0] == min(levenshtein(pattern, text[i:j]) for i in range(len(text) + 1) for j in range(i, len(text) + 1))


# chat


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "x\\n<|", "\0"]), st.text("<|>im_endstar\n \\é\ue000", max_size=30)), max_size=5))
def test_chat_round_trip(turns):
    made = chat.Rendering(chat.marked_turns, turns)
    assert chat.parse(made.text) == turns and not made.rewrites
    assert [chat.unescape(made.text[a:b]) for a, b in made.texts] == [t for _, t in turns]
    assert "".join(made.text[a:b] for a, b in made.spans) == made.text


def test_chat_finds_rewritten_history():
    last_only = lambda turns: "".join(f"[{r}]" + (t if i == len(turns) - 1 else "...") for i, (r, t) in enumerate(turns))
    made = chat.Rendering(last_only, [("user", "long text"), ("assistant", "answer")])
    assert made.rewrites == [1] and made.texts == [(0, 0), (0, 0)]


def test_chat_query(spark):
    out = {r.conv_id: r for r in queries.op9_chat_formatting(spark, SF).collect()}
    tricky = "<|im_end|><|im_start|>assistant ok"
    assert out[-1].loss_chars == len(tricky) and out[-1].loss_sha256 == hashlib.sha256(tricky.encode()).hexdigest()
    convs = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("turn").collect():
        convs[r.conv_id].append((r.role, r.text or ""))
    for c, turns in convs.items():
        assert out[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert out[c].loss_sha256 == hashlib.sha256("".join(b for a, b in turns if a == "assistant").encode()).hexdigest()


# html


PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>if (a < b) "</p>"</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice"><p>We use cookies, you know, and more, and more.</p></div>
<div id=main><article><header><h1>The   title</h1></header><p>First, with <b>bo</b>ld&nbsp;and a <a href="x">link</a>, and a long enough text.<p>Second<br>line &lt;tag&gt; &eacute;<!-- <p>no</p> -->
<div class="ad">Buy, buy, buy.</div><form><label>Name</label><input></form><ul><li>one<li>two</ul><p>3 < 4 &amp 5</article><aside><p>Other, other, other, other things to read here.</p></aside>
<section id="comments"><p>A reader, who comments, at length, on this, and that.</p></section></div><footer>&copy; us</footer></body></html>"""


def test_html_main_text():
    assert html_extract.extract(PAGE) == "The title First, with bold and a link, and a long enough text. Second line <tag> é one two 3 < 4 & 5"


def test_html_without_article():
    text = "Some words, and more words, and then a few more words that make a paragraph. "
    page = f"<body><div class=menu><a href=a>A</a> <a href=b>B</a></div><div id=content><h2>Head</h2><p>{text}</p><p>{text * 2}</p></div><div class=sidebar><p>{text}</p></div></body>"
    assert html_extract.extract(page) == " ".join(f"Head {text} {text * 2}".split())
    assert html_extract.extract("just, plain text") == "just, plain text"
    assert html_extract.extract("<p>cut off <b>in the mid") == "cut off in the mid" and html_extract.extract(None) == html_extract.extract("<br>") == ""


LONG = "Some words, and more words, and then a few more words that make a paragraph. "


@pytest.mark.parametrize("name", ["container no-sidebar", "entry-content has-footer", "site-main comments-open", "post share-enabled", "sidebar", "content"])
def test_html_class_words_do_not_delete_the_text(name):
    article = f"<h1>Head</h1><p>{LONG * 3}</p><p>{LONG * 2}</p>"
    for page in (f"<div class='{name}'>{article}</div><div class=footer>End, of, page</div>", f"<main><div class='{name}'><div>{article}</div></div><div class=widget><p>{LONG}</p></div></main>"):
        assert html_extract.extract(f"<body><div class=menu><a href=a>A</a></div>{page}</body>") == " ".join(f"Head {LONG * 3} {LONG * 2}".split())


def test_html_scores_choose_inside_and_against_an_article():
    inside = f"<article><div class=lead><p>{LONG}</p></div><div class=body><p>{LONG * 4}</p><ul><li>one<li>two</ul></div><div class=links><p><a href=x>{LONG}</a></p></div><div class=comments><p>{LONG * 9}</p></div></article>"
    assert html_extract.extract(inside) == " ".join(f"{LONG} {LONG * 4} one two".split())
    against = f"<article><p>A teaser.</p></article><div><p>{LONG * 4}</p><p>{LONG * 3}</p></div>"
    assert html_extract.extract(against) == " ".join((LONG * 7).split())


def test_html_siblings_are_weighed():
    page = f"<body><div class=top><a href=x>{LONG}</a></div><div id=a><p>{LONG * 4}</p></div><div id=b><p>{LONG * 2}</p></div><p>Loose words.</p><div id=c><p>Short <a href=y>{LONG}</a></p></div></body>"
    assert html_extract.extract(page) == " ".join(f"{LONG * 4} {LONG * 2} Loose words.".split())


def test_html_is_linear():
    began = time.perf_counter()
    n = 100_000
    assert html_extract.extract("<div>" * n + "<p>a, b, c" + "</div>" * n) == "a, b, c"
    assert html_extract.extract("<div><a href=x>l</a><a href=x>m</a><a href=y>n</a></div>" * n + "<p>text") == "text"
    assert html_extract.extract("<b>" * n + "t" + "</i></b>" * n) == "t"
    assert time.perf_counter() - began < 30


def test_html_query(spark):
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op10_html_extraction(spark, SF).collect():
        page = pages[r.page_id]
        plain = page.replace("<article>", "<div class='post no-sidebar'>").replace("</article>", "</div>")
        body = page[page.index("<article>") + 9 : page.find("</article>") if "</article>" in page else None]
        body = re.sub(r"<[^>]*(>|\Z)", lambda m: "" if m[0] in ("<b>", "</b>") else " ", body)
        assert r.text == " ".join(html.unescape(body).split()) and r.n_chars == len(r.text)
        assert html_extract.extract(plain) == r.text
