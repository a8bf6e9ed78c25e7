"""Joins, quoting, graphs and distinct statements on small tables; results do not depend on plan options."""

import itertools

import pytest

from quadloom.operators.compiler import Compiler, Options
from quadloom.plans.model import LogicalSource, Mapping, TriplesMap, constant, parent, quoted, reference, template
from quadloom.plans.planner import MappingCycleError
from quadloom.streaming.statements import stream_statements

C, O = LogicalSource("c", "table"), LogicalSource("o", "table")


@pytest.fixture(scope="module")
def read(spark):
    tables = {"c": spark.createDataFrame([("1", "x"), ("2", "y"), ("2", "y"), ("3", "z")], "id string, n string"), "o": spark.createDataFrame([("10", "1"), ("11", "2"), ("12", "9"), ("13", None)], "oid string, c string")}
    return lambda s: tables[s.name]


def run(read, *maps, **options):
    rows = Compiler(Mapping(maps), read, Options(**options)).graph_of().collect()
    return sorted(" ".join([r.subject, r.predicate, r.object, *([r.graph] if r.graph else [])]) for r in rows)


PRODUCER = TriplesMap("p", C, template("c/{id}"), classes=("C",), asserted=False).pom("n", reference("n"))
RDF = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"


def test_parent_join(read):
    m = TriplesMap("m", O, template("o/{oid}")).pom("of", parent("p", ("c", "id")))
    assert run(read, m, PRODUCER) == ["<o/10> <of> <c/1>", "<o/11> <of> <c/2>"]
    assert run(read, m, PRODUCER, dedup=False) == ["<o/10> <of> <c/1>", "<o/11> <of> <c/2>"]


def test_quoted_subject_join(read):
    m = TriplesMap("m", O, quoted("p", ("c", "id"))).pom("from", template("o/{oid}"))
    want = [f"<< <c/{c}> {p} {x} >> <from> <o/1{k}>" for k, c, v in ((0, 1, "x"), (1, 2, "y")) for p, x in (("<n>", f'"{v}"'), (RDF, "<C>"))]
    for persist, graph in itertools.product((False, True), repeat=2):
        assert run(read, m, PRODUCER, persist=persist, graph_in_key=graph) == sorted(want)


def test_lists_on_both_sides(read):
    other = TriplesMap("q", C, template("c/{id}"), asserted=False).pom("id", reference("id"))
    m = TriplesMap("m", C, quoted("p")).pom("is", quoted("q"))
    assert len(run(read, m, PRODUCER, other)) == 6 and len(run(read, m, PRODUCER, other, dedup=False)) == 8


def test_bag_and_set(read):
    m = TriplesMap("m", C, template("c/{id}")).pom("n", reference("n"))
    assert run(read, m) == ['<c/1> <n> "x"', '<c/2> <n> "y"', '<c/3> <n> "z"']
    assert run(read, m, dedup=False).count('<c/2> <n> "y"') == 2


def test_quoted_subject_takes_no_parent(read):
    m = TriplesMap("m", O, quoted("q")).pom("of", parent("p", ("c", "id"))).pom("ok", constant("yes"))
    q = TriplesMap("q", O, template("o/{oid}"), asserted=False).pom("c", reference("c"))
    assert all("<ok>" in x for x in run(read, m, q, PRODUCER)) and len(run(read, m, q, PRODUCER)) == 3


def test_other_source_without_condition_gives_nothing(read):
    assert run(read, TriplesMap("m", O, template("o/{oid}")).pom("x", quoted("p")), PRODUCER) == []


def test_composite_keys(spark):
    a = spark.createDataFrame([("a_b", "c"), ("k", "l")], "x string, y string")
    b = spark.createDataFrame([("a", "b_c"), ("k", "l")], "x string, y string")
    m = TriplesMap("m", LogicalSource("a"), template("{x}")).pom("of", parent("q", ("x", "x"), ("y", "y")))
    q = TriplesMap("q", LogicalSource("b"), template("{x}{y}"), asserted=False)
    read = lambda s: {"a": a, "b": b}[s.name]
    assert run(read, m, q) == ["<k> <of> <kl>"]
    assert run(read, m, q, legacy_composite_key=True) == ["<a_b> <of> <ab_c>", "<k> <of> <kl>"]


def test_graphs(read):
    m = TriplesMap("m", C, template("c/{id}"), graphs=("g/{n}",), classes=("C",)).pom("n", reference("n"), "h")
    values = {1: "x", 2: "y", 3: "z"}
    want = [f"<c/{i}> {RDF} <C> <g/{v}>" for i, v in values.items()] + [f'<c/{i}> <n> "{v}" <{g}>' for i, v in values.items() for g in (f"g/{v}", "h")]
    assert run(read, m) == sorted(want)
    assert len(run(read, m, graph_in_key=False)) == 6


def test_circles_are_errors(read):
    a = TriplesMap("a", C, quoted("b")).pom("x", constant("1"))
    b = TriplesMap("b", C, quoted("a")).pom("x", constant("1"))
    with pytest.raises(MappingCycleError):
        run(read, a, b)
    with pytest.raises(ValueError, match="refers to"):
        Mapping((a,))


def test_same_source_producer_with_a_join(read):
    """A quoted map on the same row that itself joins another source."""
    inner = TriplesMap("i", O, template("o/{oid}"), asserted=False).pom("of", parent("p", ("c", "id"))).pom("c", reference("c"))
    m = TriplesMap("m", O, quoted("i")).pom("at", template("row/{oid}"))
    assert run(read, m, inner, PRODUCER) == sorted(f"<< <o/1{k}> <{p}> {x} >> <at> <row/1{k}>" for k, p, x in ((0, "of", "<c/1>"), (1, "of", "<c/2>"), (0, "c", '"1"'), (1, "c", '"2"'), (2, "c", '"9"')))


def test_one_scan_and_no_python_for_plain_maps(read):
    m = TriplesMap("m", C, template("http://c/{id}"), classes=("C", "D")).pom("n", reference("n")).pom("i", quoted("p"))
    plan = Compiler(Mapping((m, PRODUCER)), read, Options(dedup=False)).graph_of()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "Python" not in plan and "Exchange" not in plan


def test_streams(spark, tmp_path):
    spark.createDataFrame([("1", "x"), ("2", None)], "id string, n string").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, n string").json(str(tmp_path / "in"))
    m = TriplesMap("m", C, template("c/{id}")).pom("n", reference("n")).pom("is", quoted("p"))
    out = stream_statements(Mapping((m, PRODUCER)), {"c": stream})
    q = out.writeStream.format("memory").queryName("statements").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("statements").count() == 4
