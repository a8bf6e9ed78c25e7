"""The pipeline as a whole, and each stage against a brute-force version on the smallest tables."""

from collections import Counter, defaultdict

import corpus_pipeline
import __spark_entry__
from quadloom.llm import decontaminate, queries, token_counts
from quadloom.llm.line_dedup import edit_distance_within
from quadloom.llm.shingles import shingle_hashes

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = (before, docs)

    before, after = kept["language_id"]
    assert after.count() >= 0.98 * before.count()

    before, after = ({r.doc_id: r.text for r in x.collect()} for x in kept["line_dedup"])
    lines = sorted({x.strip(" ") for t in before.values() for x in t.split("\n") if len(x.strip(" ")) >= 10})
    parent = {x: x for x in lines}
    find = lambda x: x if parent[x] == x else find(parent[x])
    by_length = defaultdict(list)
    for a in lines:
        for n in range(len(a) - 2, len(a) + 3):
            for b in by_length[n]:
                if min(len(a), len(b)) >= 30 and edit_distance_within(a, b, 2) is not None:
                    parent[find(a)] = find(b)
        by_length[len(a)].append(a)
    seen, want = set(), {}
    for d in sorted(before):
        left = []
        for raw in before[d].split("\n"):
            line = raw.strip(" ")
            if len(line) < 10 or find(line) not in seen:
                left.append(raw)
            if len(line) >= 10:
                seen.add(find(line))
        if len(left) == len(before[d].split("\n")) or "\n".join(left).strip(" "):
            want[d] = "\n".join(left)
    assert after == want

    before, after = ({r.doc_id: r.text for r in x.collect()} for x in kept["ngram_jaccard_join"])
    sets = {d: set(shingle_hashes(t).tolist()) for d, t in before.items()}
    top = {}
    for d in sorted(sets):
        near = [e for e in sorted(top) if len(sets[d] & sets[e]) >= 0.8 * len(sets[d] | sets[e])]
        top[d] = min([d, *(top[e] for e in near)])
        for e in near:
            old = top[e]
            top = {k: top[d] if v == old else v for k, v in top.items()}
    assert set(after) == set(top.values())

    before, after = ({r.doc_id: decontaminate.normalise(r.text) for r in x.collect()} for x in kept["benchmark_decontamination"])
    items = [decontaminate.normalise(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {d for d, t in before.items() if any(decontaminate.best_match(i, t)[0] <= int(len(i) * 0.08) for i in items)}
    assert set(after) == set(before) - leaked

    before, packed = kept["best_fit_packing"]
    counted = token_counts.LongestMatch(token_counts.read_vocabulary(str(queries.tokenizer_file("piece_bpe_32k.model"))))
    words = {r.doc_id: sum(map(counted.count, (r.text or "").split())) for r in before.collect()}
    held = Counter()
    for r in packed.collect():
        held[r.doc_id] += r.length
    assert held == words


def test_run_is_registered_and_stable(spark):
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    rows = lambda: sorted((r.doc_id, r.piece, r.length, r.shard, r.bin, r.bin_offset) for r in corpus_pipeline.run(spark, SF).collect())
    assert rows() == rows()
