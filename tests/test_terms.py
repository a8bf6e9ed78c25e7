"""Terms against hand-worked rows."""

import urllib.parse

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadloom.functions import terms
from quadloom.operators.compiler import Compiler, Options
from quadloom.plans.model import LogicalSource, Mapping, TriplesMap, constant, reference, template

SRC = LogicalSource("t", "table")


def objects(spark, values, term, subject=None, base="", **columns):
    """The object (or the subject, if one is given) for each value of the column v."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    for name, value in columns.items():
        rows = rows.withColumn(name, F.lit(value))
    m = TriplesMap("m", SRC, subject or template("s{i}")).pom("p", term if subject is None else reference("i"))
    out = Compiler(Mapping((m,), base), lambda s: rows).graph_of().collect()
    found = {int(r.object.strip('"')): r.subject for r in out} if subject is not None else {int(r.subject[2:-1]): r.object for r in out}
    return [found.get(i) for i in range(len(values))]


CASES = [
    ("http://ex/{v}", None, "", [("a b", "<http://ex/a%20b>"), (" x ", "<http://ex/%20x%20>"), ("é", "<http://ex/%C3%A9>"), ("a/b#c:d~e", "<http://ex/a/b#c:d~e>"), ("50%", "<http://ex/50%25>"), ("10.50", "<http://ex/10.5>"), ("007.10", "<http://ex/7.1>"), ("10", "<http://ex/10>"), ("1e5", "<http://ex/1e5>"), ("http://q/x y", "<http://ex/http://q/x y>"), ("", None), ("  ", None), ("nan", None), ("N/A", None), ("None", None), ("|", None), (None, None), ("NA", "<http://ex/NA>"), ("-0.0", "<http://ex/-0.0>"), ("10.00", "<http://ex/10.0>")]),
    ("k-{v}", None, "", [(" x ", "<k-x>"), (" y\n", "<k-y>")]),
    ("http://ex/{v}", "IRI", "", [("a b", "<http://ex/a%2520b>")]),
    ("k-{v}", "IRI", "http://b/", [("a b", "<http://b/k-a b>")]),
    ("n-{v}", "BlankNode", "", [("a b", "_:n-a20b"), ("a.b", "_:n-a2Eb"), ("a/b", "_:n-a2Fb")]),
    ("n-{v}", "Literal", "", [("a", None)]),
]


@pytest.mark.parametrize(("text", "kind", "base", "rows"), CASES)
def test_subject_templates(spark, text, kind, base, rows):
    assert objects(spark, [v for v, _ in rows], None, template(text, term_type=kind), base) == [t for _, t in rows]


@pytest.mark.parametrize(("kind", "rows"), [("IRI", [("x", "<http://b/x>"), ("x y", None), ("http://q", "<http://q>")]), (None, [("x", "<http://b/x>")]), ("BlankNode", [("x", "_:x")])])
def test_subject_references(spark, kind, rows):
    assert objects(spark, [v for v, _ in rows], None, reference("v", term_type=kind), "http://b/") == [t for _, t in rows]


OBJECTS = [
    (reference("v"), [('He said "hi"', '"He said \\\\\'hi\\\\\'"'), ("it's", '"it\\\\\'s"'), ("a\\b", '"a\\\\b"'), ("a\nb", '"a\\nb"'), (" x ", '"x"'), ("10.50", '"10.50"'), ("\t", None), ("a\tb\rc", '"a\tb\rc"')]),
    (reference("v", datatype="D", language="en", term_type="IRI"), [("5", '"5"^^<D>')]),
    (reference("v", term_type="IRI"), [("http://a/b", "<http://a/b>"), ("a b", None), ("a?x=1", "<a%3Fx%3D1>"), ("it's", "<it%27s>")]),
    (reference("v", term_type="BlankNode"), [("x", "_:x")]),
    (template("n-{v}", term_type="BlankNode"), [("a b", "_:n-a%20b"), ("a/b.c", "_:n-a2Fb2Ec")]),
    (template("k {v}", term_type="Literal"), [("a", '"k a"'), ("2.50", '"k 2.5"')]),
    (template("k {v}", term_type="Literal", datatype="D"), [("a", '"k a"^^<D>')]),
    (template("http://x/{v}"), [("a b", "<http://x/a%20b>")]),
    (template("{v}{w}-\\{x\\}"), [("http://h/", "<http://h/a%20b-{x}>"), ("q", "<qa b-{x}>")]),
    (reference("v", language_map="w"), [("x", '"x"@a b')]),
    (reference("missing"), [("x", None)]),
    (reference("v[w=1]"), [("x", '"x"')]),
]


@pytest.mark.filterwarnings("ignore:the source has no attribute")
@pytest.mark.parametrize(("term", "rows"), OBJECTS)
def test_objects(spark, term, rows):
    assert objects(spark, [v for v, _ in rows], term, w="a b") == [t for _, t in rows]


@pytest.mark.parametrize(("value", "datatype", "term"), [("http://x/y", None, "<http://x/y>"), ("a/b", None, "<a/b>"), ("abc", None, '"abc"'), ("http://x/y", "D", '"http://x/y"^^<D>')])
def test_constants(spark, value, datatype, term):
    assert objects(spark, ["x"], constant(value, datatype=datatype)) == [term]


@pytest.mark.parametrize(("language", "tag"), [("en", "@en"), ("english", "@en"), ("es", "@es"), ("spanish", "@es"), ("fr", "@fr"), ("de-AT", ""), ("est", "@es")])
def test_language_tags(language, tag):
    assert terms.language_suffix(language) == tag


def test_null_language_column(spark):
    rows = spark.createDataFrame([("a", "x", "fr"), ("b", "y", None)], "i string, v string, l string")
    m = TriplesMap("m", SRC, template("{i}")).pom("p", reference("v", language_map="l"))
    assert sorted(r.object for r in Compiler(Mapping((m,)), lambda s: rows).graph_of().collect()) == ['"x"@fr', '"y"']


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=("Cs",), exclude_characters="\0"), max_size=12), min_size=30, max_size=60))
def test_encode_any_text(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in rows.select("t", terms.encode(F.col("t")).alias("e")).collect():
        assert r.e == urllib.parse.quote(r.t, safe="~#/:")


@settings(max_examples=10, deadline=None)
@given(st.lists(st.from_regex(r"\A-?[0-9]{1,25}\.[0-9]{1,25}\Z"), min_size=20, max_size=40))
def test_decimals_as_floats(spark, texts):
    rows = spark.createDataFrame([(t,) for t in [*texts, "0.0", "-0.00", "00.00012", "0.000012", "123456789012345678.5", "0.1234567890123456789", "12.", ".5", "1.2.3"]], "t string")
    for r in rows.select("t", terms.normal_decimal(F.col("t")).alias("d")).collect():
        assert r.d == (repr(float(r.t)) if r.t.count(".") == 1 and r.t.strip("-")[0] != "." and r.t[-1] != "." else r.t)


EXTREMES = [0.0, -0.0, 1.0, 0.1, 1e-12, 0.1234567890123, 1e21, 1e22, 1e23, 1e16, 9999999999999998.0, 1e15, 12345678.9, 1e7, 9.999e6, 1e-3, 9.99e-4, 1e-4, 9.99e-5, 5e-324, 1.5e-310, 2.2250738585072014e-308, 1.7976931348623157e308, 2.0**-44, 2.0e-3, 2.0**70, 1 / 3, 8.41e21, 4.35e17, 10024.04 * 1e14, 1.0024040000000001e18]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), min_size=20, max_size=40))
def test_doubles_as_text(spark, numbers):
    rows = spark.createDataFrame([(x,) for n in [*numbers, *EXTREMES] for x in (n, -n)], "x double")
    for r in rows.select("x", terms.float_text(F.col("x")).alias("t")).collect():
        assert r.t == repr(r.x)


def test_special_doubles(spark):
    rows = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),), (None,)], "x double")
    assert [r.t for r in rows.select(terms.float_text(F.col("x")).alias("t")).collect()] == ["inf", "-inf", None, None]
    narrow = spark.createDataFrame([(0.1,), (1e10,), (1e-7,)], "x float")
    assert [r.t for r in narrow.select(terms.float_text(F.col("x")).alias("t")).collect()] == ["0.1", "10000000000.0", "1e-07"]


def test_valid_literals(spark):
    rows = spark.createDataFrame([("1", 'He said "it\'s"\n a\\b\r ')], "i string, v string")
    m = TriplesMap("m", SRC, template("{i}")).pom("p", reference("v")).pom("q", template("x {v}", term_type="Literal")).pom("r", constant('a"b'))
    out = {r.predicate: r.object for r in Compiler(Mapping((m,)), lambda s: rows, Options(legacy_escapes=False)).graph_of().collect()}
    assert out == {"<p>": '"He said \\"it\'s\\"\\n a\\\\b"', "<q>": '"x He said \\"it\'s\\"\\n a\\\\b"', "<r>": '"a\\"b"'}


def test_small_functions(spark):
    row = spark.createDataFrame([("x", 1)], "a string, b int").select(
        terms.base36(F.lit(46655)).alias("n"), terms.composite_key(F.lit("a"), F.lit(None).cast("string"), F.lit("b")).alias("k"), terms.clean_suffix(F.lit("a b/c\\(1)?é")).alias("c"), terms.clean_suffix(F.lit("http://x/y z")).alias("u"),
        F.array(*[terms.file_stem(F.lit(x)) for x in ("/x/y.tar.csv", "/d/a.b.csv", "name", "a.b", "/x/.h")]).alias("f"),
        terms.equal_fields({"a": F.lit(1), "b": F.lit(2)}, {"a": F.lit(1), "b": F.lit(3), "c": F.lit(0)}).alias("e"), terms.row_map(["a", "b"]).alias("m"),
    ).first()
    assert (row.n, row.k, row.f, row.c, row.u, row.e, row.m) == ("ZZZ", "a_b", ["y", "a", "name", "a", ""], "ab-c-(1)é", "http://x/y z", 1, {"a": "x", "b": "1"})
    assert terms.placeholder_count("{a}-{b}\\{c\\}") == 2 and terms.brace_count("{a}-{b}\\{c\\}") == 3
    assert terms.key_name(["id", "i", "name", "am", "x"]) == "id_name_x" and terms.has_columns(["a"], ["b", "a"]) and not terms.has_columns(["a", "c"], ["a"])


def test_nested_values(spark):
    rows = spark.read.json(spark.sparkContext.parallelize(['{"i": "1", "a": {"b": "x"}, "l": [{"f": "1", "g": "p"}, {"f": "2", "g": "q"}, {"f": "2", "g": "r"}]}', '{"i": "2", "a": null, "l": []}']))
    m = TriplesMap("m", SRC, template("{i}")).pom("p", reference("a.b")).pom("q", reference("l[?(@.f==2)].g")).pom("r", reference("l[?(@.f!=2)].g"))
    out = Compiler(Mapping((m,)), lambda s: rows).graph_of().collect()
    assert sorted((r.subject, r.predicate, r.object) for r in out) == [("<1>", "<p>", '"x"'), ("<1>", "<q>", '"r"'), ("<1>", "<r>", '"p"')]
    with pytest.raises(ValueError, match="structure"):
        Compiler(Mapping((TriplesMap("m", SRC, template("{i}")).pom("p", reference("a")),)), lambda s: rows).graph_of()
