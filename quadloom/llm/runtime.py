"""Session helpers that the operators share: lineage cuts, their removal, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import threading
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a narrow table (at most six longs each) that may be broadcast: some 10 MB as a hash table.
BROADCAST_ROWS = 100_000

_scopes = threading.local()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each context, so that their Python workers can import it."""
    context, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    if getattr(context, "_quadloom_shipped", False) or not root.is_dir():
        return
    path = Path(tempfile.mkdtemp(prefix="quadloom-")) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(path))
    context._quadloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share. Only a local master may go without a named one; else that is an error."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quadloom-checkpoint-"))
        current = context._jsc.sc().getCheckpointDir()
    return current.get()


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate files, if it is there."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def temporary_cuts(spark: SparkSession) -> Iterator[None]:
    """Deletes, at the end, what ``cut`` has written meanwhile in this thread; for work whose result has been written elsewhere."""
    outer, _scopes.paths = getattr(_scopes, "paths", None), []
    try:
        yield
    finally:
        mine, _scopes.paths = _scopes.paths, outer
        for path in mine:
            discard(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and forget how it was made; survives the loss of executors."""
    shared_dir(df.sparkSession)
    made = df.checkpoint(eager=True)
    if getattr(_scopes, "paths", None) is not None:
        file = made._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            _scopes.paths.append(file.get())
    return made


def compact(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``cut``, with as many partitions as a narrow table of its size needs: one for each ``rows``."""
    df = cut(df)
    return df.coalesce(max(1, -(-df.count() // rows)))


def small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (narrow rows) with a broadcast hint if it has at most ``limit`` rows, else as it is, for a shuffled join."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes not to be a column of ``df``."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in held:
            name = f"_{name}"
        out.append(name)
    return out


def row_key(df: DataFrame) -> list[Column]:
    """128 bits that name a row by all its columns (but maps), as two longs.

    Nulls are told from values. Rows that repeat an id stay apart if anything in them differs; equal rows have one name.
    """
    names = [f"`{f.name}`" for f in df.schema if not isinstance(f.dataType, T.MapType)]
    parts = [x for n in names for x in (F.col(n).isNull(), F.col(n))]
    return [F.xxhash64(F.lit(seed), *parts) for seed in (17, 89)]
