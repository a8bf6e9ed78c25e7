"""Best-fit packing of documents into training sequences, under conflicts.

A sequence ("bin") never holds two pieces of one source, of one duplicate cluster, or of one document. Bins are kept in
the order of their residual room and carry bitmaps of their sources and clusters. A piece goes to the tightest bin that
is large enough and compatible: the search starts at the successor of the piece's length among the residuals and goes
on through larger residuals until a bin without a conflict is found; else a new bin is opened.

The bitmaps are stored by column: an integer for each source, cluster and document, with a bit for each bin that holds
it, and one for each residual. So all bins of a residual are tested at once, and a piece that no bin can take is known
at the first step, however many bins hold its source.

Scale: pieces (ids and lengths, never texts) are dealt by hash into shards of about ``shard_pieces``, each packed on its
own in one task, longest first. A source or cluster that holds a third of all rows is spread over all shards.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import ship

SCHEMA = "doc_id long, piece int, start long, length long, shard int, bin int, bin_offset long"


class BestFit:
    """Residual-ordered bins of one shard. Sources, clusters and documents are any keys; None is no constraint."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.residual: list[int] = []
        self.present = 0  # bit r is set while some bin has residual r
        self.by_residual: dict[int, int] = defaultdict(int)  # bins of a residual, a bit each
        self.open = 0  # bins with room
        self.holding: dict[tuple, int] = defaultdict(int)  # bins that hold a source, cluster or document

    def _find(self, length: int, keys: list[tuple]) -> int | None:
        free = self.open
        for key in keys:
            free &= ~self.holding.get(key, 0)
        rest, r = self.present >> length, length
        while free and rest:
            step = (rest & -rest).bit_length() - 1
            r += step
            if fits := self.by_residual[r] & free:
                return (fits & -fits).bit_length() - 1
            rest >>= step + 1
            r += 1
        return None

    def add(self, length: int, source=None, cluster=None, doc=None) -> tuple[int, int]:
        """Place a piece; returns its bin (of equally tight ones the first) and its offset in it."""
        keys = [(kind, key) for kind, key in (("source", source), ("cluster", cluster), ("doc", doc)) if key is not None]
        b = self._find(length, keys)
        if b is None:
            b = len(self.residual)
            self.residual.append(self.capacity)
            before = self.capacity
        else:
            before = self.residual[b]
            self.by_residual[before] &= ~(1 << b)
            if not self.by_residual[before]:
                del self.by_residual[before]
                self.present &= ~(1 << before)
        left = self.residual[b] = before - length
        for key in keys:
            self.holding[key] |= 1 << b
        if left:
            self.by_residual[left] |= 1 << b
            self.present |= 1 << left
            self.open |= 1 << b
        else:  # a full bin takes no more
            self.open &= ~(1 << b)
        return b, self.capacity - before


def pack_shard(pieces: pa.Table, capacity: int) -> pa.Table:
    """Pack the pieces of one shard (doc_id, piece, start, length, source, cluster, row, shard), longest first."""
    columns = {c: pieces[c].to_pylist() for c in pieces.column_names}
    ids = [(i is not None, i or 0) for i in columns["doc_id"]]
    order = sorted(range(len(ids)), key=lambda k: (-columns["length"][k], ids[k], columns["piece"][k], columns["row"][k]))
    # a key with one piece here has no conflict
    shared = {c: {k for k, n in Counter(v).items() if n > 1 and k is not None} for c, v in (("source", columns["source"]), ("cluster", columns["cluster"]), ("doc", ids))}
    at = lambda c, key: key if key in shared[c] else None
    bins = BestFit(capacity)
    placed = [bins.add(columns["length"][k], at("source", columns["source"][k]), at("cluster", columns["cluster"][k]), at("doc", ids[k])) for k in order]
    out = pieces.select(["doc_id", "piece", "start", "length", "shard"]).take(pa.array(order, pa.int64()))
    return out.append_column("bin", pa.array([b for b, _ in placed], pa.int32())).append_column("bin_offset", pa.array([o for _, o in placed], pa.int64()))


def best_fit_pack(
    items: DataFrame,
    capacity: int = 2048,
    *,
    id_col: str = "doc_id",
    length_col: str = "length",
    source_col: str = "source",
    cluster_col: str = "cluster",
    shard_pieces: int = 4096,
) -> DataFrame:
    """Pack ``items`` into bins of ``capacity``; one row for each piece, of the columns of ``SCHEMA``.

    An item longer than the capacity is cut into full pieces and a rest, which all count as pieces of its document.
    Lengths that are null or not positive need no room: such items return as one row with ``bin`` and ``bin_offset``
    null. A null source or cluster conflicts with nothing. Repeated rows and rows that repeat an id are packed as often
    as they occur, in different bins (they are pieces of one document); so are rows with a null id. Ids may be any
    longs. Other columns are ignored. An empty table gives an empty result. Bins are numbered within their shard; the
    order of pieces of equal length is by id (null first), piece and a hash of the row, and of equally tight bins the
    first is taken, so the result depends only on the rows.
    """
    ship(items.sparkSession)
    length = F.coalesce(F.col(length_col).cast("long"), F.lit(0))
    base = items.select(F.col(id_col).cast("long").alias("doc_id"), F.greatest(length, F.lit(0)).alias("n"), F.col(source_col).cast("string").alias("source"), F.col(cluster_col).cast("long").alias("cluster"))
    total = base.agg(F.sum(F.ceil(F.col("n") / capacity))).first()[0] or 0
    shards = max(1, math.ceil(total / shard_pieces))
    cut = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0)).cast("int"))
    pieces = base.withColumn("row", F.xxhash64("doc_id", "n", F.isnull("source"), "source", "cluster")).withColumn("piece", F.explode(cut))
    start = F.col("piece").cast("long") * capacity
    shard = F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).cast("int")
    pieces = pieces.select("doc_id", "piece", start.alias("start"), F.least(F.lit(capacity), F.col("n") - start).alias("length"), "source", "cluster", "row", shard.alias("shard"))
    packed = pieces.where("length > 0").groupBy("shard").applyInArrow(lambda table: pack_shard(table, capacity), SCHEMA)
    empty = pieces.where("length <= 0").select("doc_id", "piece", "start", "length", "shard", F.lit(None).cast("int").alias("bin"), F.lit(None).cast("long").alias("bin_offset"))
    return packed.unionByName(empty)
