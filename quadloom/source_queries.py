"""Queries that go through files, databases, mapping documents, configured runs and the planner, with their SQL."""

from __future__ import annotations

import csv
import json
import tempfile
import uuid
import zipfile
from dataclasses import replace
from functools import reduce
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.compiler import Compiler, Options
from .plans.document import load_mapping
from .plans.model import LogicalSource, Mapping, TriplesMap, constant, quoted, reference, template
from .plans.planner import order_sources, plan, predicate_counts
from .queries import CUST, EX, NATION, ORDER, QUERIES, REGION, P, cls, lit, p, query, quote, rows, s_nation, table, tm
from .sources import config, readers

# planner: rows worked out by hand


def _planned(*more: TriplesMap) -> Mapping:
    return Mapping((tm("a", "customer", CUST, (p("name"), reference("c_name")), asserted=False), tm("b", "customer", quoted("a"), (p("note"), constant("x")), asserted=False), tm("c", "orders", quoted("b", ("o_custkey", "c_custkey")), (p("from"), ORDER)), tm("d", "nation", NATION, (p("sees"), quoted("b", ("n_nationkey", "c_custkey")))), *more))


_W = tm("w", "customer", CUST, (p("name"), reference("c_name")), (p("key"), reference("c_custkey")))


@query("SELECT * FROM (VALUES ('a', 0), ('b', 1), ('c', 2), ('d', 2)) t(id, level)")
def planner_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(m, k) for k, level in enumerate(plan(_planned()).levels) for m in level], "id string, level int")


@query("SELECT * FROM (VALUES ('a', 'quoted_support', 'row', 'none', 1, 2), ('b', 'mixed', 'join', 'medium', 2, 2), ('c', 'quoted_consumer', 'none', 'none', 0, 2), ('d', 'quoted_consumer', 'none', 'none', 0, 2)) t(id, role, cache, reuse, uses, last_level)")
def planner_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """b has two foreign consumers, which join it by different columns of theirs; a is used on its own rows only."""
    return spark.createDataFrame([(m.id, m.role, m.cache, m.reuse, m.uses, m.last_level) for m in plan(_planned()).maps.values()], "id string, role string, cache string, reuse string, uses int, last_level int")


@query("SELECT * FROM (VALUES ('customer', 'w', 1), ('orders', 'c', 2), ('nation', 'd', 3)) t(source, id, place)")
def planner_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asserted maps in order: level 0 has w, level 2 has c and d; each is a batch of its own source."""
    return spark.createDataFrame([(name, m, k) for k, (name, ids) in enumerate(plan(_planned(_W)).batches(), 1) for m in ids], "source string, id string, place int")


@query("SELECT 'a' AS id, 'w' AS owner, 0 AS statement, 2 AS last_level")
def planner_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one statement of a, which is not asserted, is the first of w; c and d use b, and so a, on level 2."""
    return spark.createDataFrame([(m, owner, at, last) for (owner, at), (ids, last) in plan(_planned(_W)).alias_groups().items() for m in ids], "id string, owner string, statement int, last_level int")


SAME = "http://www.w3.org/2002/07/owl#sameAs"
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
_SOURCES = Mapping((tm("a", "customer", CUST, (p("name"), reference("c_name")), (SAME, template("{c_custkey}"))), tm("b", "nation", NATION, (p("name"), reference("n_name")), classes=("C",)), tm("c", "region", REGION, (p("size"), reference("r_name")))))


@query(f"SELECT * FROM (VALUES ('{EX}name', 2), ('{SAME}_{{c_custkey}}', 1), ('{TYPE}_<C>', 1), ('{EX}size', 1)) t(predicate, n)")
def planner_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(predicate_counts(_SOURCES).items()), "predicate string, n int")


@query("SELECT * FROM (VALUES (1, 'nation'), (2, 'customer'), (3, 'region')) t(place, source)")
def planner_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the sources with one predicate nation is first by name; customer shares its predicate; region shares none."""
    return spark.createDataFrame([(k, name) for k, (name, _) in enumerate(order_sources(_SOURCES), 1)], "place int, source string")


@query("SELECT * FROM (VALUES ('a', 0), ('b', 1), ('c', 2), ('d', 2)) t(id, level)")
def planner_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan as written to a file, which only the driver needs, and read back."""
    with tempfile.TemporaryDirectory() as folder:
        plan(_planned()).write(f"{folder}/plan.json")
        held = json.loads(Path(f"{folder}/plan.json").read_text())
    return spark.createDataFrame([(m, k) for k, level in enumerate(held["levels"]) for m in level], "id string, level int")


SUMMARY = (
    "4 triples maps in 3 levels",
    "  level 0: a [quoted_support] source=customer uses=1 cache=row reuse=none last=2",
    "  level 1: b [mixed] source=customer uses=2 cache=join reuse=medium last=2",
    "  level 2: c [quoted_consumer] source=orders uses=0 cache=none reuse=none last=2",
    "  level 2: d [quoted_consumer] source=nation uses=0 cache=none reuse=none last=2",
)


@query(f"SELECT * FROM (VALUES {', '.join(f'({k}, {line!r})' for k, line in enumerate(SUMMARY, 1))}) t(place, line)")
def planner_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(plan(_planned()).summary().splitlines(), 1)), "place int, line string")


# files


def _folder(spark: SparkSession) -> str:
    """A folder for files of a query: the shared one that the session names; a temporary one only under a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{named.rstrip('/')}/{uuid.uuid4().hex}" if named else tempfile.mkdtemp(prefix="quadloom-")


NATION_TEXT = rows("nation", (s_nation, P["name"], lit("n_name")))


def _nation_from(spark: SparkSession, logical: LogicalSource, **options) -> DataFrame:
    m = TriplesMap("n", logical, NATION).pom(p("name"), reference("n_name"))
    return Compiler(Mapping((m,)), readers.reader(spark), Options(**options)).graph_of().drop("graph")


@query(NATION_TEXT)
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_folder(spark)}/nation.csv"
    table(spark, sf_dir, "nation").write.option("header", True).csv(path)
    return _nation_from(spark, LogicalSource(path, "csv"))


@query(NATION_TEXT)
def tsv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_folder(spark)}/nation.tsv"
    table(spark, sf_dir, "nation").write.option("header", True).option("sep", "\t").csv(path)
    return _nation_from(spark, LogicalSource(path, "tsv"))


@query(rows("nation", (s_nation, P["name"], lit("n_name || ' é'"))))
def csv_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file in ISO-8859-1 that nothing declares as such."""
    path = f"{_folder(spark)}/nation.csv"
    table(spark, sf_dir, "nation").withColumn("n_name", F.concat("n_name", F.lit(" é"))).write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return _nation_from(spark, LogicalSource(path, "csv"))


@query(rows("nation", (s_nation, P["name"], lit("""n_name || chr(10) || '"' || n_regionkey || '"'"""))))
def csv_multi_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted fields that go over line ends and hold doubled quotes."""
    path = f"{_folder(spark)}/nation.csv"
    field = F.concat(F.lit('"'), "n_name", F.lit('\n""'), "n_regionkey", F.lit('"""'))
    records = table(spark, sf_dir, "nation").select(F.concat_ws(",", F.col("n_nationkey").cast("string"), field).alias("r"))
    whole = records.agg(F.concat(F.lit("n_nationkey,n_name\n"), F.concat_ws("\n", F.collect_list("r"))).alias("value"))
    whole.write.text(path)
    return _nation_from(spark, LogicalSource(path, "csv"))


@query("SELECT DISTINCT event_type AS kind, CAST(user_id AS VARCHAR) AS who FROM events")
def csv_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct rows of a file whose header has a byte order mark, quotes and blanks."""
    path = f"{_folder(spark)}/events.csv"
    table(spark, sf_dir, "events").select(F.col("event_type").alias("﻿kind"), F.col("user_id").alias(" 'who' ")).write.option("header", True).csv(path)
    return readers.read_delimited(spark, path, distinct=True)


@query(NATION_TEXT)
def json_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_folder(spark)}/nation.json"
    whole = table(spark, sf_dir, "nation").agg(F.to_json(F.struct(F.collect_list(F.struct("n_nationkey", "n_name")).alias("nations"))).alias("value"))
    whole.write.text(path)
    return _nation_from(spark, LogicalSource(path, "json", "$.nations[*]"))


@query(NATION_TEXT)
def json_lines_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_folder(spark)}/nation.jsonl"
    table(spark, sf_dir, "nation").write.json(path)
    return _nation_from(spark, LogicalSource(path, "jsonl"))


@query(NATION_TEXT)
def xml_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_folder(spark)}/nation.xml"
    table(spark, sf_dir, "nation").write.format("xml").option("rowTag", "nation").option("rootTag", "nations").save(path)
    return _nation_from(spark, LogicalSource(path, "xml", "/nations/nation"))


# databases: one in a file of the shared folder, which the driver and each executor open for themselves, to read

DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def _database(spark: SparkSession, sf_dir: str) -> LogicalSource:
    """A database with the table nation. The driver makes it, shuts it down and packs it; Derby opens a packed one in any number of JVMs.

    The file isn't compressed, as pages are read from any place of it. Values are all quoted, so that only nulls are empty.
    """
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    jar = jvm.org.apache.hadoop.fs.Path(f"{_folder(spark)}/nation.jar")
    if (kind := jar.getFileSystem(conf).getUri().getScheme()) != "file":
        raise ValueError(f"Derby opens no {kind} paths: set spark.checkpoint.dir to a mounted folder that the driver and all executors share")
    packed = Path(jar.toUri().getPath())
    packed.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.TemporaryDirectory(prefix="quadloom-") as made:
        folder = Path(made).resolve()
        with open(folder / "rows.csv", "w", encoding="utf-8", newline="") as f:
            csv.writer(f, quoting=csv.QUOTE_NOTNULL, lineterminator="\n").writerows(nation.toLocalIterator())
        derby, url, none = jvm.org.apache.derby.iapi.jdbc.AutoloadedDriver(), f"jdbc:derby:{folder}/nation", jvm.java.util.Properties()
        opened = derby.connect(f"{url};create=true", none)
        columns = ", ".join(f'"{c}" {"VARCHAR(32672)" if t == "string" else t}' for c, t in nation.dtypes)
        opened.createStatement().execute(f"CREATE TABLE nation ({columns})")
        opened.createStatement().execute(f"CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, 'NATION', '{folder}/rows.csv', NULL, NULL, 'UTF-8', 0)")
        opened.close()
        try:
            derby.connect(f"{url};shutdown=true", none)
        except Py4JJavaError as e:  # which is how Derby says that it is done
            if e.java_exception.getSQLState() != "08006":
                raise
        with zipfile.ZipFile(packed, "w") as z:
            for file in sorted((folder / "nation").rglob("*")):
                z.write(file, file.relative_to(folder))
    return LogicalSource("db", "jdbc", table="nation", connection=(("url", f"jdbc:derby:jar:({packed})nation"), ("driver", DERBY)))


@query(NATION_TEXT)
def jdbc_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nation_from(spark, _database(spark, sf_dir))


@query("SELECT DISTINCT n_regionkey FROM nation")
def jdbc_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The database itself sends distinct rows of the columns that are asked for, over two connections."""
    asked = replace(_database(spark, sf_dir), columns=("n_regionkey",))
    return readers.read_jdbc(spark, asked, {"partitionColumn": "n_regionkey", "lowerBound": "0", "upperBound": "5", "numPartitions": "2"})


@query("SELECT n_regionkey FROM nation")
def jdbc_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_jdbc(spark, replace(_database(spark, sf_dir), columns=("n_regionkey",)), {}, distinct=False)


# mapping documents and configured runs; the driver writes and reads these small files itself

DOCUMENT = """@prefix r: <http://w3id.org/rml/> . @prefix ex: <http://ex/> . @base <http://ex/maps/> .
<#nation> r:logicalSource [ r:source "%(nation)s" ; r:referenceFormulation r:Parquet ] ; r:subjectMap [ r:template "http://ex/nation/{n_nationkey}" ; r:class ex:Nation ] ;
  r:predicateObjectMap [ r:predicate ex:name ; r:objectMap [ r:reference "n_name" ] ] ;
  r:predicateObjectMap [ r:predicate ex:of ; r:objectMap [ r:parentTriplesMap <#region> ; r:joinCondition [ r:child "n_regionkey" ; r:parent "r_regionkey" ] ] ] .
<#region> a r:NonAssertedTriplesMap ; r:logicalSource [ r:source "%(region)s" ; r:referenceFormulation r:Parquet ] ; r:subjectMap [ r:template "region-{r_regionkey}" ; r:termType r:IRI ] .
<#told> a r:AssertedTriplesMap ; r:logicalSource [ r:source "%(nation)s" ; r:referenceFormulation r:Parquet ] ; r:subjectMap [ r:quotedTriplesMap <#nation> ] ;
  r:predicateObjectMap [ r:predicateMap [ r:constant ex:note ] ; r:object "sure" ] .
"""
_FACTS = ((s_nation, *cls("Nation")), (s_nation, P["name"], lit("n_name")), (s_nation, P["of"], "'<http://ex/maps/region-' || n_regionkey || '>'"))
DOCUMENT_SQL = rows("nation", *_FACTS, *((quote(*f), P["note"], "'\"sure\"'") for f in _FACTS))


def _document(sf_dir: str) -> str:
    path = f"{tempfile.mkdtemp(prefix='quadloom-')}/mapping.ttl"
    Path(path).write_text(DOCUMENT % {n: f"{sf_dir}/{n}.parquet" for n in ("nation", "region")}, encoding="utf-8")
    return path


@query(DOCUMENT_SQL)
def mapping_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Compiler(load_mapping(_document(sf_dir)), readers.reader(spark)).graph_of().drop("graph")


def _run(spark: SparkSession, sf_dir: str, **options: str) -> DataFrame:
    """The lines that a configured run of two datasets writes, with the name of their file."""
    out, mapping = _folder(spark), _document(sf_dir)
    keys = "\n".join(f"{k}={v}" for k, v in options.items())
    text = f"[datasets]\nhome={out}\nnumber_of_datasets=2\noutput_folder=${{datasets:home}}/out\n{keys}\n[dataset1]\nname=one\nmapping={mapping}\n[dataset2]\nname=two\nmapping={mapping}\n"
    Path(f"{mapping}.ini").write_text(text, encoding="utf-8")
    written = config.run(spark, f"{mapping}.ini")
    return reduce(DataFrame.unionAll, [spark.read.text(path).select("value", F.lit(name).alias("file")) for name, path in written.items()])


_LINES = f"SELECT subject || ' ' || predicate || ' ' || object || '.' AS value FROM ({DOCUMENT_SQL})"


@query(f"SELECT value, file FROM ({_LINES}), (VALUES ('one'), ('two')) f(file)")
def config_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One set of distinct lines a dataset."""
    return _run(spark, sf_dir, remove_duplicate="yes")


@query(f"SELECT value, 'all' AS file FROM ({_LINES}), (VALUES (1), (2)) f(k)")
def config_run_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All datasets in one file, with repeats."""
    return _run(spark, sf_dir, remove_duplicate="no", all_in_one_file="yes", name="all", single_file="yes")


@query(f"SELECT value, 'all' AS file FROM ({_LINES})")
def config_run_all_in_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, remove_duplicate="yes", all_in_one_file="yes", name="all", reuse_join_inputs="yes")


NAMES = [name for name, f in QUERIES.items() if f.__module__ == __name__]
