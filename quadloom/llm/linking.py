"""From buckets of candidates to verified links and classes, without all pairs of a bucket.

A bucket holds nodes that may be near each other. Small buckets are checked pair by pair, which is a bounded number for
each member. In a large bucket every member is first checked against one pivot. Where that leaves members outside the
bucket's largest class, they are compared with all members of other classes: in chunks, inside the worker, which returns
only links that connect classes. So no connection is lost, a group of near copies costs one check a member, and rows
grow with the members and not with their pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .runtime import compact, cut, small

#: Buckets up to SMALL are checked pair by pair. About CHUNK nodes outside the largest class are compared at once.
SMALL, CHUNK = 8, 64


def _pairs_within(members: DataFrame) -> DataFrame:
    """``a < b`` of each bucket's members of different ``comp``; only for buckets of bounded size."""
    groups = members.groupBy("bucket").agg(F.array_sort(F.collect_set(F.struct("node", "comp", "indexed"))).alias("ms")).select("ms").distinct()
    other = lambda x, y: (y.node > x.node) & (y.comp != x.comp) & (y.indexed + x.indexed > 0)
    pair = F.flatten(F.transform("ms", lambda x: F.transform(F.filter("ms", lambda y: other(x, y)), lambda y: F.struct(x.node.alias("a"), y.node.alias("b")))))
    return groups.select(F.explode(pair).alias("p")).select("p.a", "p.b")


def _pairs_with_pivot(members: DataFrame) -> DataFrame:
    """Every member as ``b`` with its bucket's pivot as ``a``; a pair may stand in both orders."""
    return members.where("node <> next").select(F.col("next").alias("a"), F.col("node").alias("b"))


def with_values(pairs: DataFrame, values: DataFrame, rows: int = 4096) -> DataFrame:
    """``a, b, va, vb``: pairs beside the ``value`` of both nodes (``values``: node, value). ``pairs`` has been cut.

    A pivot is in as many pairs as its bucket has members. Where a node is in more than ``rows``, the value of the other
    one is joined first, once a pair, and the pairs of the node are then dealt by a salt: its value goes once to each
    ``rows`` of them.
    """
    value = lambda node, name: values.select(F.col("node").alias(node), F.col("value").alias(name))
    hubs = pairs.groupBy("a").agg(F.ceil(F.count("*") / rows).alias("salts")).where("salts > 1")
    hubs = cut(hubs) if pairs.count() > rows else None
    met = pairs.join(value("b", "vb"), "b")
    if hubs is None or hubs.isEmpty():
        return met.join(value("a", "va"), "a").select("a", "b", "va", "vb")
    salts = F.coalesce("salts", F.lit(1).cast("long"))
    met = met.join(small(hubs), "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), salts)).drop("salts")
    dealt = value("a", "va").join(small(hubs), "a", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("salts")
    return met.join(dealt, ["a", "salt"]).select("a", "b", "va", "vb")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_apart(live: DataFrame, payloads: DataFrame, near: Callable[[object, list], list[bool]]) -> DataFrame:
    """Links ``a, b`` between members of different classes of a bucket; ``live``: bucket, node, indexed, comp; ``payloads``: node, payload.

    Members outside a bucket's largest class are compared with all members of other classes, in the worker. Members are
    dealt into blocks of about CHUNK, and a row holds two blocks: a payload is sent once for each block that it meets, not
    once for each member. Pairs of blocks are dealt by their numbers, so the work of a large bucket is spread. Of each two
    classes that meet in a row one link comes back, if there is any.
    """
    sizes = live.groupBy("bucket", "comp").agg(F.count("*").alias("k"))
    main = sizes.groupBy("bucket").agg(F.max(F.struct("k", "comp")).alias("top"), F.sum("k").alias("n"))
    blocks = lambda n: F.greatest(F.lit(1).cast("long"), F.ceil(n / CHUNK))
    main = main.select("bucket", F.col("top.comp").alias("main"), blocks(F.col("n")).alias("all"), blocks(F.col("n") - F.col("top.k")).alias("others"))
    open_ = cut(live.join(main, "bucket").join(payloads, "node"))
    member = F.struct("node", "comp", "indexed", "payload")

    def dealt(members: DataFrame, of: str, own: str, met: str, to: str, name: str) -> DataFrame:
        """The blocks of ``members``, numbered ``own`` below ``of``, one copy of each for each of the ``to`` blocks that it meets."""
        held = members.groupBy("bucket", "main", "all", "others", F.pmod(F.xxhash64("node"), F.col(of)).alias(own)).agg(F.collect_list(member).alias(name))
        return held.withColumn(met, F.explode(F.sequence(F.lit(0).cast("long"), F.col(to) - 1)))

    left = dealt(open_, "all", "i", "j", "others", "xs").select("bucket", "i", "j", "main", "xs")
    right = dealt(open_.where("comp <> main"), "others", "j", "i", "all", "ys").select("bucket", "i", "j", "ys")
    met = left.join(right, ["bucket", "i", "j"]).select("main", "xs", "ys")

    def links(main: int, xs: list[dict], ys: list[dict]) -> Iterator[tuple[int, int]]:
        linked = set()
        for x in xs:
            # two members outside the main class meet twice; once is enough
            wanted = [y for y in ys if y["comp"] != x["comp"] and y["indexed"] + x["indexed"] > 0 and (x["comp"] == main or x["node"] < y["node"]) and (x["comp"], y["comp"]) not in linked]
            for y, ok in zip(wanted, near(x["payload"], [y["payload"] for y in wanted]), strict=True):
                if ok and (x["comp"], y["comp"]) not in linked:
                    linked |= {(x["comp"], y["comp"]), (y["comp"], x["comp"])}
                    yield x["node"], y["node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for at in range(batch.num_rows):
                found += links(*(c[at].as_py() for c in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def link_buckets(rows: DataFrame, verify: Callable[[DataFrame], DataFrame], apart: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The components ``node, comp`` of nodes that have a link.

    ``rows``: ``bucket, node, indexed`` (two longs, 0 or 1; distinct). Of two members at least one must be indexed.
    ``verify`` keeps the linked ones of the pairs ``a, b``. ``apart`` is given the members ``bucket, node, indexed, comp``
    of large buckets with several classes, and returns links that connect what is linked between them. Buckets are
    counted with sums that are combined before the shuffle; only rows of buckets with two members or more go on.
    """
    entry = F.when(F.col("indexed") == 1, F.col("node"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min(entry).alias("next")).where("n > 1 and next is not null")
    members = compact(rows.join(sizes, "bucket").select("bucket", "node", "indexed", "n", "next", F.col("node").alias("comp")))
    large = F.col("n") > SMALL
    first = _pairs_within(members.where(~large)).unionByName(_pairs_with_pivot(members.where(large))).distinct()
    links = compact(_ordered(verify(compact(first))))
    comp = components(links)
    live = members.where(large).select("bucket", "node", "indexed")
    live = live.join(small(comp), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    several = live.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("bucket")
    live = compact(live.join(several, "bucket"))
    if not live.isEmpty():
        more = compact(_ordered(apart(live)))
        if not more.isEmpty():
            comp = components(links.unionByName(more))
    return comp
