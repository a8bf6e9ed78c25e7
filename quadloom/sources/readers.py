"""Logical sources as DataFrames. Text sources are read as text: no type is inferred."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.model import LogicalSource


def normal_header(name: str) -> str:
    """Without a byte order mark, one pair of quotes and outer blanks."""
    name = name.removeprefix("\ufeff").strip()
    if len(name) > 1 and name[0] == name[-1] and name[0] in "\"'":
        name = name[1:-1]
    return name.strip()


def probe_text(spark: SparkSession, path: str) -> tuple[str, bool]:
    """Encoding of a text file, and whether quoted fields go over line ends: one splittable scan of its lines.

    What is not UTF-8 throughout is read as ISO-8859-1. A field that goes on in the next line leaves an odd number of
    quotes in its first one.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    utf8, broken = spark.read.text(path).agg(F.bool_and(F.is_valid_utf8("value")), F.bool_or(quotes % 2 == 1)).first()
    return ("ISO-8859-1" if utf8 is False else "UTF-8"), bool(broken)


def read_delimited(spark: SparkSession, path: str, delimiter: str = ",", encoding: str | None = None, distinct: bool = False, multi_line: bool | None = None) -> DataFrame:
    """A text file with a header. ``encoding`` and ``multi_line`` (which ties a file to one task) are probed where they are not given."""
    if encoding is None or multi_line is None:
        found = probe_text(spark, path)
        encoding, multi_line = encoding or found[0], found[1] if multi_line is None else multi_line
    reader = spark.read.option("header", True).option("sep", delimiter).option("quote", '"').option("escape", '"').option("multiLine", multi_line).option("nullValue", "\0").option("encoding", encoding)
    df = reader.csv(path)
    df = df.toDF(*[normal_header(c) for c in df.columns])
    return df.distinct() if distinct else df


def read_json(spark: SparkSession, path: str, iterator: str | None = None, multi_line: bool = True) -> DataFrame:
    """A list of objects, or an object whose one field is a list; else the rows that the iterator (``$.a[*].b``) names.

    A document is one value and is read in one task; a file of one object a line (``multi_line=False``) is split.
    """
    df = spark.read.option("multiLine", multi_line).option("primitivesAsString", True).json(path)
    steps = [s for s in re.split(r"[.]", (iterator or "$").removeprefix("$")) if s]
    if not steps:
        only = df.schema.fields
        return _unnest(df, only[0].name) if len(only) == 1 and isinstance(only[0].dataType, T.ArrayType) and isinstance(only[0].dataType.elementType, T.StructType) else df
    for step in steps:
        name = step.removesuffix("[*]")
        if not name:
            continue
        df = _unnest(df, name) if isinstance(df.schema[name].dataType, T.ArrayType) else df.select(f"`{name}`.*")
    return df


def _unnest(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.explode(f"`{name}`").alias("row")).select("row.*")


def read_xml(spark: SparkSession, path: str, iterator: str | None = None) -> DataFrame:
    row = [s for s in (iterator or "row").split("/") if s][-1]
    return spark.read.format("xml").option("rowTag", row).option("inferSchema", False).load(path)


def sql_projection(source: LogicalSource, columns: list[str], distinct: bool = True, quote: str = "") -> str:
    """The query that a database is asked: only the columns that the mapping needs, in ``quote`` marks."""
    if source.query:
        return source.query
    names = ", ".join(f"{quote}{c}{quote}" for c in columns)
    return f"SELECT {'DISTINCT ' if distinct else ''}{names or '*'} FROM {source.table or source.name}"


def read_jdbc(spark: SparkSession, source: LogicalSource, connection: dict[str, str], distinct: bool = True) -> DataFrame:
    """MySQL, PostgreSQL and others, with ``connection`` as the options of the JDBC reader (url, user, ...).

    The database is asked for the columns that the mapping mentions. With ``partitionColumn``, ``lowerBound``,
    ``upperBound`` and ``numPartitions`` it is read over several connections.
    """
    options = {**connection, **dict(source.connection)}
    columns = list(source.columns)
    if (by := options.get("partitionColumn")) and columns and by not in columns:
        columns.append(by)
    quote = "`" if options.get("url", "").startswith(("jdbc:mysql:", "jdbc:mariadb:")) else '"'
    return spark.read.format("jdbc").options(**options).option("dbtable", f"({sql_projection(source, columns, distinct, quote)}) q").load()


def reader(spark: SparkSession, folder: str = "", tables: dict[str, DataFrame] | None = None, connection: dict[str, str] | None = None, encoding: str | None = None) -> Callable[[LogicalSource], DataFrame]:
    """A function from logical sources to DataFrames. ``tables`` come first, by source name."""

    def read(source: LogicalSource) -> DataFrame:
        if tables and source.name in tables:
            return tables[source.name]
        path = source.name if source.name.startswith("/") or "://" in source.name or not folder else f"{folder.rstrip('/')}/{source.name}"
        match source.format:
            case "csv" | "tsv":
                return read_delimited(spark, path, source.delimiter or {"csv": ",", "tsv": "\t"}[source.format], source.encoding or encoding)
            case "json" | "jsonl":
                return read_json(spark, path, source.iterator, source.format == "json")
            case "xml":
                return read_xml(spark, path, source.iterator)
            case "jdbc":
                return read_jdbc(spark, source, connection or {})
            case "parquet":
                return spark.read.parquet(path if path.endswith(".parquet") else f"{path}.parquet")
            case "table":
                return spark.table(source.table or source.name)
        raise ValueError(f"no reader for {source.format}")

    return read
