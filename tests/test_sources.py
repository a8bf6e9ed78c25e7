"""Readers, sinks and runs."""

from quadloom.operators.compiler import Compiler
from quadloom.plans.model import LogicalSource, Mapping, TriplesMap, reference, template
from quadloom.sources import config, readers, sinks

TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿"id", name \n1,"two\nlines"\n2,"say ""x"""\n2,"say ""x"""\n'.encode())
    (tmp_path / "b.tsv").write_bytes("id\tname\n1\tcaf\xe9\n".encode("latin-1"))
    df = readers.read_delimited(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["id", "name"] and [r.name for r in df.collect()] == ["two\nlines", 'say "x"', 'say "x"']
    assert readers.read_delimited(spark, str(tmp_path / "a.csv"), distinct=True).count() == 2
    read = readers.reader(spark, str(tmp_path))
    assert read(LogicalSource("b.tsv", "tsv", encoding="ISO-8859-1")).first().name == "café"
    assert read(LogicalSource("b.tsv", "tsv")).first().name == "café"
    assert readers.probe_text(spark, str(tmp_path / "a.csv")) == ("UTF-8", True) and readers.probe_text(spark, str(tmp_path / "b.tsv")) == ("ISO-8859-1", False)
    assert [readers.normal_header(x) for x in ("﻿id", " 'a' ", '"b"', "c")] == ["id", "a", "b", "c"]


def test_json_and_xml(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1, "n": {"x": 1.50}}, {"id": 2}]')
    (tmp_path / "b.json").write_text('{"data": [{"id": 1}, {"id": 2}]}')
    (tmp_path / "c.json").write_text('{"o": {"list": [{"id": 1, "sub": [{"k": "a"}, {"k": "b"}]}]}}')
    (tmp_path / "d.xml").write_text("<all><row><id>1</id></row><row><id>2</id></row></all>")
    read = readers.reader(spark, str(tmp_path))
    for name, kind, iterator, n in (("a.json", "json", None, 2), ("b.json", "json", None, 2), ("b.json", "json", "$.data[*]", 2), ("c.json", "json", "$.o.list[*].sub[*]", 2), ("d.xml", "xml", "/all/row", 2)):
        assert read(LogicalSource(name, kind, iterator)).count() == n
    m = TriplesMap("m", LogicalSource("a.json", "json"), template("{id}")).pom("x", reference("n.x"))
    assert [tuple(r)[:3] for r in Compiler(Mapping((m,)), read).graph_of().collect()] == [("<1>", "<x>", '"1.50"')]


def test_projection():
    s = LogicalSource("db", "jdbc", table="t")
    assert readers.sql_projection(s, ["a", "b"]) == "SELECT DISTINCT a, b FROM t" and readers.sql_projection(s, ["a"], distinct=False) == "SELECT a FROM t"
    assert readers.sql_projection(LogicalSource("db", "jdbc", query="SELECT 1"), ["a"]) == "SELECT 1"


def test_jdbc(spark):
    url = "jdbc:derby:memory:quadloom_test;create=true"
    rows = spark.createDataFrame([(k, f"name {k % 3}", k % 2) for k in range(20)], "id int, name string, other int")
    rows.write.format("jdbc").options(url=url, dbtable="T", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver", createTableColumnTypes="name VARCHAR(40)").mode("overwrite").save()
    source = LogicalSource("db", "jdbc", table="T", connection=(("url", url), ("driver", "org.apache.derby.iapi.jdbc.AutoloadedDriver")))
    m = TriplesMap("m", source, template("http://x/{name}")).pom("p", reference("other"))
    made = Compiler(Mapping((m,)), readers.reader(spark))
    assert made.source(source).count() == 6 and made.graph_of().count() == 6
    parted = readers.reader(spark, connection={"partitionColumn": "id", "lowerBound": "0", "upperBound": "20", "numPartitions": "4"})
    assert Compiler(Mapping((m,)), parted).source(source).rdd.getNumPartitions() == 4 and Compiler(Mapping((m,)), parted).graph_of().count() == 6


def test_single_file(spark, tmp_path):
    for n in (3, 0):
        rows = spark.range(n).selectExpr("'<s>' subject", "'<p>' predicate", "concat('\"', id, '\"') object", "cast(null as string) graph").repartition(3)
        path = sinks.write_statements(rows, str(tmp_path), "g", single=True)
        assert sorted(open(path).read().splitlines()) == [f'<s> <p> "{k}".' for k in range(n)] and [f.name for f in tmp_path.iterdir() if "crc" not in f.name] == ["g.nt"]


def test_lines(spark):
    rows = spark.createDataFrame([("<s>", "<p>", '"o"', None), ("<s>", "<p>", '"o"', "<g>"), ("<s>", TYPE, "<C>", "<g>")], "subject string, predicate string, object string, graph string")
    assert [r.value for r in sinks.to_lines(rows).collect()] == ['<s> <p> "o".', '<s> <p> "o" <g>.', f"<s> {TYPE} <C> <g> ."]


MAPPING = """@prefix r: <http://w3id.org/rml/> . <{n}> r:logicalSource [ r:source "t.csv" ] ; r:subjectMap [ r:template "http://x/{{id}}" ] ; r:predicateObjectMap [ r:predicate <http://p> ; r:objectMap [ r:reference "v" ] ] ."""


def test_run(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,v\n1,a\n1,a\n2,\n")
    for n in (1, 2):
        (tmp_path / f"m{n}.ttl").write_text(MAPPING.format(n=n))
    text = "[datasets]\nmain_directory={d}\nnumber_of_datasets=2\noutput_folder=${{datasets:main_directory}}/out\nall_in_one_file={one}\nremove_duplicate={dedup}\nname=all\nenrichment=yes\n[dataset1]\nname=one\nmapping=${{datasets:main_directory}}/m1.ttl\n[dataset2]\nname=two\nmapping=${{datasets:main_directory}}/m2.ttl\n"
    for one, dedup, names, n in (("no", "yes", ["one", "two"], 1), ("no", "no", ["one", "two"], 2), ("yes", "yes", ["all"], 1), ("yes", "no", ["all"], 4)):
        (tmp_path / "c.ini").write_text(text.format(d=tmp_path, one=one, dedup=dedup))
        written = config.run(spark, str(tmp_path / "c.ini"))
        assert list(written) == names
        assert [spark.read.text(p).count() for p in written.values()] == [n] * len(names)
        assert spark.read.text(written[names[0]]).first().value == '<http://x/1> <http://p> "a".'
