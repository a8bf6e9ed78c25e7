"""Queries on executors that are JVMs of their own: nothing that one JVM holds is there for another."""

import json
import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from quadloom import queries, source_queries
from quadloom.sources import readers

SF = "/root/testdata/sf0.001"
NAMES = ["jdbc_bag", "jdbc_projection", "jdbc_source"]
SCRIPT = """
import json, sys
from pyspark.sql import SparkSession
from quadloom import queries, source_queries
names, sf, shared, out = json.loads(sys.argv[1])
b = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.checkpoint.dir", f"file://{shared}").config("spark.ui.enabled", "false")
spark = b.config("spark.driver.host", "127.0.0.1").config("spark.executor.memory", "1g").config("spark.executor.instances", "2").getOrCreate()
found = {}
for name in names:
    try:
        df = queries.QUERIES[name](spark, sf)
        found[name] = [list(r) for r in df.select(*sorted(df.columns)).collect()]
    except Exception as e:
        found[name] = str(e)[:2000]
open(out, "w").write(json.dumps(found))
spark.stop()
"""


@pytest.fixture(scope="module")
def found(tmp_path_factory):
    folder = tmp_path_factory.mktemp("cluster")
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_", "SPARK_"))}
    env |= {"PYTHONPATH": str(Path(queries.__file__).parents[1]), "PYSPARK_PYTHON": sys.executable, "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_WORKER_DIR": str(folder / "work")}
    args = json.dumps([NAMES, SF, str(folder / "shared"), str(folder / "out.json")])
    run = subprocess.run([sys.executable, "-c", SCRIPT, args], env=env, cwd=folder, capture_output=True, text=True, timeout=300)
    assert (folder / "out.json").exists(), run.stderr[-2000:]
    return json.loads((folder / "out.json").read_text())


@pytest.mark.parametrize("name", NAMES)
def test_cluster(found, name):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW nation AS SELECT * FROM '{SF}/nation.parquet'")
    want = db.sql(queries.ORACLE_SQL[name])
    want = want.select(*sorted(want.columns)).fetchall()
    assert not isinstance(found[name], str), found[name]
    assert Counter(map(tuple, found[name])) == Counter(want) and want


def test_database_values(spark, tmp_path, monkeypatch):
    """Nulls, empty texts, quotes, line ends and repeats come back as they were; a folder that Derby can't open is named."""
    rows = [(0, 'a "q", b', 0), (1, "", 1), (2, None, None), (3, " pad ", 2), (4, "two\nlines", 2), (5, "cr\r\nlf", 3), (6, "é漢😀", 4), (7, '"', -1), (7, '"', -1), (None, "x" * 99, 3), (8, "\\n,\t", 2**31 - 1)]
    spark.createDataFrame(rows, "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    made = source_queries._database(spark, str(tmp_path))
    assert Counter(map(tuple, readers.read_jdbc(spark, made, {}, distinct=False).collect())) == Counter(rows)
    assert Counter(map(tuple, readers.read_jdbc(spark, made, {}).collect())) == Counter(set(rows))
    monkeypatch.setattr(source_queries, "_folder", lambda spark: "hdfs://localhost:1/x")
    with pytest.raises(ValueError, match="hdfs"):
        source_queries._database(spark, str(tmp_path))
