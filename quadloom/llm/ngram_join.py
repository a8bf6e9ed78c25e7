"""Join of documents whose word n-gram sets have a Jaccard likeness of at least a threshold.

MinHash with banding: the numbers of bands and rows follow from the recall that is asked for at the threshold. Equal
n-gram sets are one node from the start, so copies never meet each other. Nodes are shuffled on band hashes, candidates
are verified on their full n-gram sets: by the pair, or, where a large bucket holds several classes after that, group by
group in chunks. Links are then counted within each class, by comparing its full sets in chunks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .linking import link_buckets, with_values
from .runtime import compact, cut, fresh, ship, small
from .shingles import forget_words, mix64, shingle_hashes

#: About as many n-grams has a chunk of a class. A set counts as LEAST_GRAMS at least, so a chunk's sets are bounded too.
CHUNK_GRAMS, LEAST_GRAMS = 1 << 17, 128
COLUMNS = 1024


def band_layout(threshold: float = 0.8, recall: float = 0.999, max_hashes: int = 256) -> tuple[int, int]:
    """Bands and rows: the most selective layout of at most ``max_hashes`` hashes that finds a pair at the threshold with ``recall``."""
    fits = []
    for rows in range(1, max_hashes + 1):
        chance = threshold**rows
        bands = 1 if chance >= recall else math.ceil(math.log(1 - recall) / math.log1p(-chance))
        if bands * rows <= max_hashes:
            fits.append((rows, bands))
    rows, bands = max(fits)
    return bands, rows


@lru_cache(8)
def _multipliers(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20_210_817)
    return draw.integers(0, 1 << 32, hashes, np.uint32) | np.uint32(1), draw.integers(0, 1 << 32, hashes, np.uint32)


def signatures(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """Of some n-gram sets: a 64-bit hash for each band. An empty set has the hashes of no minimum."""
    times, plus = _multipliers(bands * rows)
    least = np.full((len(sets), bands * rows), 0xFFFFFFFF, np.uint32)
    for at, grams in enumerate(sets):
        low = (grams >> np.uint64(32)).astype(np.uint32)
        for lo in range(0, len(low), 1024):
            v = low[lo : lo + 1024, None] * times
            v += plus
            np.minimum(least[at], v.min(axis=0), out=least[at])
    least = least.reshape(len(sets), bands, rows).astype(np.uint64)
    key = mix64(np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sets), bands)))
    for r in range(rows):
        key = mix64(key ^ least[:, :, r])
    return key


def _names(sets: list[np.ndarray]) -> np.ndarray:
    """A 128-bit name of each n-gram set, as two longs."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)


def _sign(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, row, k1, k2, size, bands`` of ``doc_id, row, text``: the name of the n-gram set, its size and its band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = [shingle_hashes(t.as_py(), words) for t in part.column(2)]
                names = _names(sets)
                keys = signatures(sets, bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * bands, pa.int32()), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array(map(len, sets), pa.int64()), lists], ["doc_id", "row", "k1", "k2", "size", "bands"])
        forget_words()

    return docs.mapInArrow(run, "doc_id long, row long, k1 long, k2 long, size long, bands array<long>")


def _gram_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``node, k1, k2, value`` and the other columns of ``wanted`` (longs; one row a node, with ``row`` and the set's name).

    Only texts whose hash is that of a wanted node's representative are read into sets; each set must then have the name
    that is wanted, so that texts of equal hashes are told apart. A text that occurs twice gives its node twice.
    """
    more = [c for c in wanted.columns if c not in ("row", "node", "k1", "k2")]
    rows = docs.select("row", "text").join(small(wanted), "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                sets = [shingle_hashes(t.as_py(), words) for t in part.column(0)]
                right = pa.array((_names(sets) == np.column_stack([part.column(2).to_numpy(), part.column(3).to_numpy()])).all(axis=1))
                ends = np.cumsum([0, *map(len, sets)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(1), lists, *part.columns[4:]], ["node", "value", *more]).filter(right)
        forget_words()

    schema = ", ".join(["node long", "value array<long>", *(f"{c} long" for c in more)])
    return rows.select("text", "node", "k1", "k2", *more).mapInArrow(run, schema)


def near_matrix(a: list[np.ndarray], b: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which sets of ``a`` are near which sets of ``b`` (which may be ``a`` itself), as a matrix of booleans.

    The sizes of all intersections are one product of matrices. N-grams that the same sets hold are one column with a
    weight, and those of one side only are none, so near copies need few columns however many they are.
    """
    sets, n = (a if b is a else a + b), len(a)
    sizes = np.array([len(s) for s in sets], np.int64)
    size_b = sizes if b is a else sizes[n:]
    shared = np.zeros((n, len(b)))
    grams, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    held_by = np.zeros(len(grams), np.uint64)
    np.add.at(held_by, column, mix64(np.arange(1, len(sets) + 1, dtype=np.uint64))[row])
    _, sample, kind, weight = np.unique(held_by, return_index=True, return_inverse=True, return_counts=True)
    kept = sample[kind[column]] == column
    row, column = row[kept], kind[column[kept]]
    left = np.bincount(column[row < n], minlength=len(weight))
    useful = left > 1 if b is a else (left > 0) & (np.bincount(column[row >= n], minlength=len(weight)) > 0)
    place = np.cumsum(useful) - 1
    row, column, weight = row[useful[column]], place[column[useful[column]]], weight[useful].astype(np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for lo in range(0, len(weight), COLUMNS):
        at = slice(*np.searchsorted(column, (lo, lo + COLUMNS)))
        block = np.zeros((len(sets), min(COLUMNS, len(weight) - lo)), np.float32)
        block[row[at], column[at] - lo] = 1
        shared += (block[:n] * weight[lo : lo + COLUMNS]) @ (block if b is a else block[n:]).T
    if b is a:
        np.fill_diagonal(shared, sizes)
    return shared >= threshold * (sizes[:n, None] + size_b[None, :] - shared)


def _two_sides(table: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Rows of one chunk, rows of the other (or the same), which of them are near each other, and whether it is the same."""
    values = table["value"].combine_chunks()
    ends, flat = values.offsets.to_numpy(), values.values.to_numpy()
    chunk, node = (table[c].to_numpy() for c in ("chunk", "node"))
    sides: list[dict[int, int]] = [{}, {}]
    for i in range(table.num_rows):  # a text that occurs twice is here twice
        sides[int(chunk[i] != chunk[0])].setdefault(int(node[i]), i)
    one, two = (np.array(list(s.values()), np.int64) for s in sides)
    same = table["lo"][0] == table["hi"][0]
    if same:
        two = one
    elif not len(two):  # the other chunk is empty
        return one, two, np.zeros((len(one), 0), bool), False
    a = [flat[ends[i] : ends[i + 1]] for i in one]
    return one, two, near_matrix(a, a if same else [flat[ends[i] : ends[i + 1]] for i in two], threshold), same


def _links_of(table: pa.Table, threshold: float) -> pa.Table:
    """``node, others`` for two chunks of a class, or one and itself: the copies of the sets that are near a node's."""
    one, two, near, same = _two_sides(table, threshold)
    node, copies = (table[c].to_numpy() for c in ("node", "copies"))
    near &= node[one][:, None] != node[two][None, :]
    out = [(node[one], near @ copies[two])] + ([] if same else [(node[two], near.T @ copies[one])])
    return pa.table({"node": pa.array(np.concatenate([x for x, _ in out])), "others": pa.array(np.concatenate([y for _, y in out]).astype(np.int64))})


def _connect(table: pa.Table, threshold: float) -> pa.Table:
    """``a, b``: links that connect what is near in two chunks, one for each two classes at most."""
    one, two, near, _ = _two_sides(table, threshold)
    node, comp = (table[c].to_numpy() for c in ("node", "comp"))
    left, right, a, b = comp[one].copy(), comp[two].copy(), [], []
    for i in range(len(one)):
        while True:
            apart = near[i] & (right != left[i])
            j = int(np.argmax(apart)) if apart.any() else -1
            if j < 0:
                break
            a.append(int(node[one[i]]))
            b.append(int(node[two[j]]))
            old = right[j]  # from here on the two classes are one
            left[left == old] = left[i]
            right[right == old] = left[i]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _chunks_meet(texts: DataFrame, members: DataFrame, words: int, meet: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``meet`` for each two chunks of a group, and each with itself; ``members`` (cut): node, row, k1, k2, size, group, and further longs.

    A group is dealt by hash into chunks of about ``CHUNK_GRAMS``; each two chunks meet in one worker. So a task is
    bounded whatever the size of a group, and what is shuffled is its n-grams times the number of its chunks.
    """
    sizes = members.groupBy("group").agg(F.ceil(F.sum(F.greatest("size", F.lit(LEAST_GRAMS))) / CHUNK_GRAMS).alias("chunks"))
    placed = members.join(small(compact(sizes)), "group").withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks")).drop("size")
    sets = _gram_sets(texts, compact(placed), words)
    met = sets.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    met = met.withColumn("lo", F.least("chunk", "with")).withColumn("hi", F.greatest("chunk", "with")).drop("with", "chunks")
    # tasks are few bytes and much work: they keep their number
    met = met.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "group", "lo", "hi")
    return met.groupBy("group", "lo", "hi").applyInArrow(meet, schema)


def _count_links(texts: DataFrame, nodes: DataFrame, comp: DataFrame, words: int, threshold: float) -> DataFrame:
    """``node, others``: of each node with a link, the number of documents with other n-gram sets that are near its own.

    The chunks of a class meet; a worker returns a sum for each member and no pairs, so all links of a class count.
    """
    members = cut(nodes.join(small(comp), "node").select("node", "row", "k1", "k2", "size", F.col("comp").alias("group"), "copies"))
    return _chunks_meet(texts, members, words, lambda t: _links_of(t, threshold), "node long, others long").groupBy("node").agg(F.sum("others").alias("others"))


def _join(base: DataFrame, words: int, threshold: float, recall: float, max_hashes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For ``doc_id, row, text``: what ``_sign`` gives, the nodes, and the components ``node, comp`` of nodes with a link."""
    bands, rows = band_layout(threshold, recall, max_hashes)
    signed = cut(_sign(base, words, bands, rows))
    # one node for each n-gram set; its number is fixed by the cut, its text is found again by the hash of one that has it
    sets = signed.groupBy("k1", "k2").agg(F.min("doc_id").alias("least_id"), F.min("row").alias("row"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    nodes = cut(sets.withColumn("node", F.monotonically_increasing_id()))
    buckets = nodes.select(F.explode("bands").alias("bucket"), "node", F.lit(1).alias("indexed"))

    def verify(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        wanted = compact(nodes.select("node", "row", "k1", "k2").join(small(compact(wanted)), "node", "left_semi"))
        met = with_values(pairs, _gram_sets(base, wanted, words))
        shared = F.size(F.array_intersect("va", "vb"))
        return met.where(shared >= threshold * (F.size("va") + F.size("vb") - shared)).select("a", "b")

    def apart(live: DataFrame) -> DataFrame:
        # classes that meet in some bucket are one group, whose members are all compared on their full sets
        first = live.groupBy("bucket").agg(F.min("comp").alias("a"))
        groups = components(live.join(first, "bucket").where("comp <> a").select("a", F.col("comp").alias("b")).distinct())
        members = live.select("node", "comp").distinct().join(small(groups.toDF("comp", "group")), "comp")
        members = cut(nodes.select("node", "row", "k1", "k2", "size").join(members, "node"))
        return _chunks_meet(base, members, words, lambda t: _connect(t, threshold), "a long, b long")

    return signed, nodes, link_buckets(buckets, verify, apart)


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("row"), text.alias("text"))


def ngram_join(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8, recall: float = 0.999, max_hashes: int = 256, count_links: bool = True
) -> DataFrame:
    """``doc_id, class_id, n_links`` for each row of ``docs``.

    ``class_id`` is the least id among the documents that links connect. ``n_links`` counts all other documents whose
    n-gram set is equal or at least as near as the threshold, copies included; without ``count_links`` this column and
    its work are left out. A text of fewer than ``words`` words is one n-gram; null, empty and blank texts are copies of
    each other. Each row is a document: rows that repeat an id, and rows with a null id, are joined by their own texts
    (a class of rows without ids has a null class). Other columns are ignored; an empty table gives an empty result.

    Every candidate pair of the bands is verified on its full n-gram sets, unless other links connect the two.
    """
    ship(docs.sparkSession)
    base = _base(docs, id_col, text_col)
    signed, nodes, comp = _join(base, words, threshold, recall, max_hashes)
    classes = nodes.select("k1", "k2", "node", "copies", "least_id").join(small(comp), "node", "left")
    least = classes.where("comp is not null").groupBy("comp").agg(F.min("least_id").alias("class_least"))
    classes = classes.join(small(compact(least)), "comp", "left").withColumn("class_id", F.when(F.col("comp").isNull(), F.col("least_id")).otherwise(F.col("class_least")))
    if count_links:
        classes = classes.join(_count_links(base, nodes, comp, words, threshold), "node", "left")
        classes = classes.withColumn("n_links", F.col("copies") - 1 + F.coalesce("others", F.lit(0)))
    out = signed.select("doc_id", "k1", "k2").join(classes, ["k1", "k2"]).select("doc_id", "class_id", *(["n_links"] if count_links else []))
    return out.withColumnRenamed("doc_id", id_col)


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8, recall: float = 0.999, max_hashes: int = 256) -> DataFrame:
    """One row of ``docs`` for each class of near duplicates, with all its columns.

    The row with the least id stays (null ids come last), among these the one whose text has the least hash, and of
    rows equal in both any one. Rows that repeat an id are documents of their own. A row without words is a copy of the
    others without words. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    base = _base(docs, id_col, text_col)
    signed, nodes, comp = _join(base, words, threshold, recall, max_hashes)
    groups = nodes.select("k1", "k2", "copies", F.col("node").alias("n")).join(small(comp), F.col("n") == F.col("node"), "left").where("copies > 1 or comp is not null")
    groups = compact(groups.select("k1", "k2", F.coalesce("comp", "n").alias("comp")))
    # the rows of classes with two rows or more: ids and hashes
    rows = cut(signed.join(small(groups), ["k1", "k2"]).groupBy("comp", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), F.col("doc_id").isNull().alias("none"), "row").agg(F.count("*").alias("n")))
    first = rows.groupBy("comp").agg(F.min(F.struct("none", "id", "row")).alias("f"))
    rows = rows.join(small(compact(first.select("comp", "f.none", "f.id", "f.row").toDF("comp", "fn", "fi", "fr"))), "comp")
    rows = rows.withColumn("kept", (F.col("none") == F.col("fn")) & (F.col("id") == F.col("fi")) & (F.col("row") == F.col("fr")))
    names = fresh(docs, "i", "none", "h", "kept")
    rows = compact(rows.where("not kept or n > 1").select("id", "none", "row", "kept").distinct().toDF(*names))
    row = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    key = [F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)) == F.col(names[0]), F.col(id_col).isNull() == F.col(names[1]), row == F.col(names[2])]
    once = docs.join(small(rows), key, "left_anti")
    twice = rows.where(F.col(names[3]))
    if twice.isEmpty():
        return once
    # rows that are equal in id and text: one of each
    equal = docs.join(small(twice), key).dropDuplicates(names[:3])
    return once.unionByName(equal.drop(*names))
