"""Removal of lines that repeat, exactly or within an edit distance, anywhere in a corpus.

Equal lines are one node. Near lines are found by partition: a line is split into threshold-plus-one segments, of which
an edit within the threshold leaves one whole; segments are indexed with the length of their line, and each line probes
the index with those of its substrings that can meet a segment (multi-match-aware selection). Candidates are verified
with a banded bit-parallel edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linking import link_buckets, near_apart, with_values
from .runtime import compact, cut, fresh, ship, small
from .shingles import BoundedCache


def segments(length: int, threshold: int) -> list[tuple[int, int]]:
    """Start and length of ``threshold + 1`` segments of a line; the later ones take the rest."""
    parts = threshold + 1
    base, longer = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        n = base + (i >= parts - longer)
        out.append((at, n))
        at += n
    return out


def probe_offsets(threshold: int) -> list[tuple[int, int, int]]:
    """Where a line meets the segments of an indexed line that is ``gap`` shorter: (gap, segment, offset to its start).

    The multi-match-aware choice: left and right of a segment there may be no more edits than there are other segments.
    An equal length and offset 0 is the line's own index entry, and is left out.
    """
    out = []
    for gap in range(threshold + 1):
        for i in range(threshold + 1):
            left, right = max(-i, gap - (threshold - i)), min(i, gap + (threshold - i))
            out += [(gap, i, offset) for offset in range(left, right + 1) if gap or offset]
    return out


def edit_distance_within(a: str, b: str, threshold: int) -> int | None:
    """The edit distance if it is at most ``threshold``, else None.

    Bit-parallel (Myers, Hyyro) on a diagonal band: a word of 2 x threshold + 1 bits slides along the diagonal, so the
    cost does not depend on the length of the pattern.
    """
    if abs(len(a) - len(b)) > threshold:
        return None
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < len(a) - lo and hi < len(b) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if not a or not b:
        return len(a) + len(b)
    if len(a) > len(b):
        a, b = b, a
    where: dict[str, int] = {}  # grows with the band
    for i, c in enumerate(a[:threshold]):
        where[c] = where.get(c, 0) | 1 << i
    rows = len(a)
    # In column j, bit k of a word is row j - threshold + k; the band slides one row down a column.
    mask = (1 << (2 * threshold + 1)) - 1
    up, down, distance = mask ^ ((1 << threshold) - 1), 0, 0  # vertical differences of +1 and -1
    for j, c in enumerate(b, 1):
        shift = j - threshold - 1
        if (i := j + threshold - 1) < rows:
            where[a[i]] = where.get(a[i], 0) | 1 << i
        eq = where.get(c, 0)
        eq = (eq >> shift if shift >= 0 else eq << -shift) & mask
        same = ((((eq & up) + up) ^ up) | eq | down) & mask  # diagonal differences of 0
        right, left = down | (mask & ~(same | up)), same & up  # horizontal differences of +1 and -1
        if j <= rows:
            distance += not same >> threshold & 1
        else:
            row = rows - j + threshold
            distance += (right >> row & 1) - (left >> row & 1)
        if distance > 2 * threshold:  # the last cell is at most threshold diagonals away, and diagonals never fall
            return None
        up, down = left | (mask & ~((same >> 1) | right)), (same >> 1) & right
    return distance if distance <= threshold else None


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """``id, none, row, pos, line, node, check`` of every line of ``min_chars`` characters or more, trimmed; a line's identity is the 128 bits of node and check."""
    raw = docs.select("id", "none", "row", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    lines = raw.select("id", "none", "row", "pos", F.trim("raw").alias("line")).where(F.char_length("line") >= min_chars)
    return lines.withColumn("node", F.xxhash64("line")).withColumn("check", _check("line"))


def _check(line: str) -> Column:
    return F.xxhash64(F.lit(7), line)


def _keys(docs: DataFrame, threshold: int, min_near: int, index: bool) -> DataFrame:
    """``bucket, node``: the index entries of each line of ``min_near`` characters or more, or its probes.

    A worker leaves out lines that it has met a short while ago; what is left of repeats is harmless.
    """
    offsets = [(0, i, 0) for i in range(threshold + 1)] if index else probe_offsets(threshold)

    def slices(n: int) -> list[tuple[int, int, int]]:
        """Start, end and seed of each key of a line of ``n`` characters."""
        out = []
        for gap, i, offset in offsets:
            if n - gap >= min_near:
                at, size = segments(n - gap, threshold)[i]
                if 0 <= at + offset <= n - size:
                    out.append((at + offset, at + offset + size, (n - gap) << 8 | i))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, seen, plans = xxhash.xxh64_intdigest, set(), BoundedCache(slices, 20_000)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                buckets, nodes, counts = [], [], []
                for text in batch.column(0).slice(lo, 256):
                    for line in (text.as_py() or "").split("\n"):
                        line = line.strip(" ")
                        n = len(line)
                        if n < min_near or (node := digest(line, 42)) in seen:
                            continue
                        seen.add(node)
                        plan = plans[n]
                        buckets += [digest(line[start:end], seed) for start, end, seed in plan]
                        nodes.append(node)
                        counts.append(len(plan))
                    if len(seen) > 250_000:
                        seen.clear()
                node = np.repeat(np.array(nodes, np.uint64), counts).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(buckets, np.uint64).view(np.int64)), pa.array(node)], ["bucket", "node"])

    return docs.select("text").mapInArrow(run, "bucket long, node long")


def near_lines(docs: DataFrame, lines: DataFrame, threshold: int = 2, min_near: int | None = None) -> DataFrame:
    """``node, check, comp``: components of different lines within ``threshold`` edits of each other.

    ``docs`` has the column text, ``lines`` is what ``_lines`` makes of it. Lines shorter than ``min_near`` (ten
    characters a segment) match only exactly, and are not here. Null and empty texts have no lines, repeats of a line are
    one node, an empty table gives an empty result.
    """
    min_near = min_near or 10 * (threshold + 1)
    # the filter is what the join below asks for anyway: with it, both uses of the entries are one exchange
    index = _keys(docs, threshold, min_near, True).where("bucket is not null")
    # keys that only one line has need no list: its least and greatest node are the same
    held = index.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
    probed = _keys(docs, threshold, min_near, False).join(held, "bucket").where("lo <> node or hi <> node").select("bucket", "node")
    # both parts read the same exchange of index entries
    found = compact(probed.unionByName(held.where("lo <> hi").select("bucket", F.lit(None).cast("long").alias("node"))).distinct())
    shared = compact(found.select("bucket").distinct())
    entries = index.join(small(shared), "bucket", "left_semi").withColumn("indexed", F.lit(1))
    rows = compact(entries.unionByName(found.where("node is not null").withColumn("indexed", F.lit(0))).groupBy("bucket", "node").agg(F.max("indexed").alias("indexed")))

    # the lines that meet another in some bucket: read once, for all that follows
    met_nodes = compact(rows.select("node").distinct())
    texts = cut(lines.join(small(met_nodes), "node", "left_semi").select("node", "line").groupBy("node").agg(F.first("line").alias("value")))

    def verify(pairs: DataFrame) -> DataFrame:
        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in (batch.slice(lo, 256) for lo in range(0, batch.num_rows, 256)):
                    near = [edit_distance_within(x, y, threshold) is not None for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                    yield part.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

        return with_values(pairs, texts).mapInArrow(check, "a long, b long")

    def near(one: str, others: list[str]) -> list[bool]:
        return [edit_distance_within(one, other, threshold) is not None for other in others]

    def apart(live: DataFrame) -> DataFrame:
        wanted = small(compact(live.select("node").distinct()))
        return near_apart(live, texts.join(wanted, "node", "left_semi").select("node", F.col("value").alias("payload")), near)

    comp = link_buckets(rows, verify, apart)
    return texts.join(small(comp), "node").select("node", _check("value").alias("check"), "comp")


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: int = 2, min_chars: int = 10, min_near: int | None = None) -> DataFrame:
    """``docs`` with repeated lines taken out of the text, and ``lines_dropped``.

    Of each class of lines (equal after trimming, or joined by edits within ``threshold``) the first stays: that of the
    least id (null ids come last), among rows that repeat the id that of the text with the least hash, and there the
    first in the text. So a row is a document, whether its id is null, repeated or its own; only rows that are equal in
    id and text are one document, and keep the same lines. Lines under ``min_chars`` characters always stay, and lines
    under ``min_near`` (default: ten characters a segment) are only compared exactly. Null texts stay null and empty ones
    empty; an empty table gives an empty result. Columns of ``docs`` keep their places; one named ``lines_dropped`` is
    replaced.
    """
    ship(docs.sparkSession)
    text = F.col(text_col).cast("string")
    key = [F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)), F.col(id_col).isNull(), F.xxhash64(text)]
    base = docs.where(F.col(text_col).isNotNull()).select(*(k.alias(n) for k, n in zip(key, ("id", "none", "row"), strict=True)), text.alias("text"))
    lines = _lines(base, min_chars)
    places = lines.select("id", "none", "row", "pos", "node", "check")
    # one row a line and task is shuffled, however often a line occurs
    seen = places.groupBy("node", "check").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    comp = near_lines(base, lines, threshold, min_near)
    repeated = compact(seen.join(small(compact(comp)), ["node", "check"], "left").where("n > 1 or comp is not null").select("node", "check", F.coalesce("comp", "node").alias("class"), F.when(F.col("comp").isNull(), F.col("check")).otherwise(0).alias("part"), "first_id"))
    first = repeated.groupBy("class", "part").agg(F.min("first_id").alias("first_id"))
    repeated = compact(repeated.select("node", "check", "class", "part").join(first, ["class", "part"]))
    hits = cut(places.join(small(repeated), ["node", "check"]).select("id", "none", "row", "pos", "class", "part", "first_id"))
    # whatever the size of a class, only its lines under the first id need a closer look
    first = hits.where("id = first_id")
    kept = first.groupBy("class", "part").agg(F.min(F.struct("none", "row", "pos")).alias("kept"))
    dropped = first.join(kept, ["class", "part"]).where(F.struct("none", "row", "pos") != F.col("kept")).select("id", "none", "row", "pos")
    dropped = dropped.unionByName(hits.where("id <> first_id").select("id", "none", "row", "pos"))
    drops = cut(dropped.groupBy("id", "none", "row").agg(F.array_sort(F.collect_set("pos")).alias("at")))
    # for each line up to the last that goes, whether it stays
    gap = lambda i: F.get("at", i) - F.when(i == 0, -1).otherwise(F.get("at", i - 1)) - 1
    stays = F.flatten(F.transform(F.sequence(F.lit(0), F.size("at") - 1), lambda i: F.concat(F.array_repeat(F.lit(True), gap(i)), F.array(F.lit(False)))))
    names = fresh(docs, "id", "none", "row", "stays", "gone")
    drops = drops.select("id", "none", "row", stays, F.size("at")).toDF(*names)
    out = docs.join(drops, [k == F.col(n) for k, n in zip(key, names, strict=False)], "left")
    left = F.filter(F.split(text, "\n"), lambda x, i: F.coalesce(F.get(F.col(names[3]), i), F.lit(True)))
    out = out.withColumn(text_col, F.when(F.col(names[3]).isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n")))
    return out.withColumn("lines_dropped", F.coalesce(F.col(names[4]), F.lit(0))).drop(*names)
