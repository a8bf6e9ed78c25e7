"""Statements as lines of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.turtle import RDF


def to_lines(statements: DataFrame) -> DataFrame:
    """``value``: ``s p o.``, with a graph ``s p o <g>.``; class statements have a blank before the stop after a graph."""
    stop = F.when(F.col("graph").isNotNull() & (F.col("predicate") == f"<{RDF}type>"), " .").otherwise(".")
    return statements.select(F.concat(F.concat_ws(" ", "subject", "predicate", "object", "graph"), stop).alias("value"))


def write_statements(statements: DataFrame, folder: str, name: str, single: bool = False) -> str:
    """Writes ``<folder>/<name>.nt``, replacing it: a folder with a part file for each partition, or one file (small graphs)."""
    path = f"{folder.rstrip('/')}/{name}.nt"
    if not single:
        to_lines(statements).write.mode("overwrite").text(path)
        return path
    spark = statements.sparkSession
    to_lines(statements).coalesce(1).write.mode("overwrite").text(f"{path}.parts")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    parts, whole = jvm.org.apache.hadoop.fs.Path(f"{path}.parts"), jvm.org.apache.hadoop.fs.Path(path)
    files = whole.getFileSystem(conf)
    part = next((f.getPath() for f in files.listStatus(parts) if f.getPath().getName().startswith("part-")), None)
    files.delete(whole, True)
    if part is None:
        files.create(whole).close()
    else:
        files.rename(part, whole)
    files.delete(parts, True)
    return path
