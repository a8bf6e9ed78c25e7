"""The Turtle reader, mapping documents, and the planner."""

import json
import time

import pytest

from quadloom.plans.document import parse_mapping
from quadloom.plans.model import LogicalSource, Mapping, TriplesMap, constant, quoted, reference, template
from quadloom.plans.planner import GENERAL, aliases, order_sources, plan, predicate_counts, reuse_strength, statement_shape
from quadloom.plans.turtle import TurtleError, read_turtle

DOC = r"""
@prefix rml: <http://w3id.org/rml/> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .
@base <http://base/> .
PREFIX ex: <http://ex/>
# a comment
<#person> a rml:AssertedTriplesMap ; rml:logicalSource [ rml:source "file:///data/p.csv" ; rml:referenceFormulation <http://semweb.mmlab.be/ns/ql#CSV> ] ;
  rml:subjectMap [ rml:template "http://ex/{id}" ; rml:class ex:Person, ex:Agent ; rml:graphMap [ rml:template "http://g/{id}" ] ] ;
  rml:predicateObjectMap [ rml:predicate ex:knows ; rml:objectMap [ rml:parentTriplesMap <#org> ; rml:joinCondition [ rml:child "a" ; rml:parent "b" ], [ rml:child "c" ; rml:parent "d" ] ] ;
    ] , [ rml:predicate ex:name, ex:label ; rml:objectMap [ rml:reference "name" ; rml:language "en" ], [ rml:constant "x" ; rml:datatype ex:dt ] ; rml:graph ex:g ] ;
  rml:predicateObjectMap [ rml:predicateMap [ rml:template "http://p/{q}" ] ; rml:object "y" ] .
<#org> a rml:NonAssertedTriplesMap ; rml:logicalSource [ rml:source "o.tsv" ] ; rml:subjectMap [ rml:quotedTriplesMap <#base> ; rml:joinCondition [ rml:child "k" ; rml:parent "k" ] ] ;
  rml:predicateObjectMap [ rml:predicate ex:p ; rml:objectMap [ rml:reference "v" ; rml:languageMap [ rml:reference "l" ] ; rml:termType rml:Literal ] ] .
<#base> rml:logicalSource [ rml:source "j.json" ; rml:referenceFormulation rml:JSONPath ; rml:iterator "$.a[*]" ] ; rml:subjectMap [ rml:reference "r" ; rml:termType rml:BlankNode ] .
"""


def test_document():
    m = parse_mapping(DOC)
    assert m.base == "http://base/" and [x.id for x in m.maps] == ["http://base/#person", "http://base/#org", "http://base/#base"]
    person, org, base = m.maps
    assert person.source == LogicalSource("/data/p.csv", "csv") and person.classes == ("http://ex/Person", "http://ex/Agent") and person.graphs == ("http://g/{id}",) and person.asserted
    assert [(p.predicate.value, p.object.kind, p.object.value) for p in person.poms] == [("http://ex/name", "reference", "name"), ("http://ex/name", "constant", "x"), ("http://ex/label", "reference", "name"), ("http://ex/label", "constant", "x"), ("http://p/{q}", "constant", "y"), ("http://ex/knows", "parent", "http://base/#org")]
    assert person.poms[0].graphs == ("http://ex/g",) and person.poms[-1].object.joins == (("a", "b"), ("c", "d")) and person.poms[1].object.datatype == "http://ex/dt"
    assert not org.asserted and org.source.format == "tsv" and org.subject.joins == (("k", "k"),) and org.poms[0].object.language_map == "l"
    assert base.source == LogicalSource("j.json", "json", "$.a[*]") and base.subject.term_type.endswith("BlankNode")


def test_turtle():
    g = read_turtle("""@prefix : <http://x/> . :a :b "l\\u00e9\\n"@fr-CA , '''two
lines''' , 4.5 , true , "1"^^:int ; :c ( :d [ :e _:z ] ) ; . [] :b :c. :a.b :c :d .""")
    assert g.all("http://x/a", "http://x/b") == ["lé\n", "two\nlines", "4.5", "true", "1"] and "http://x/a.b" in g.triples
    for bad in ("<a> <b> .", "x:a <b> <c> .", "<a> <b> <c>", "<a> <b> {"):
        with pytest.raises(TurtleError):
            read_turtle(bad)


def maps():
    c, o = LogicalSource("c"), LogicalSource("o")
    return Mapping((TriplesMap("a", c, template("{i}"), asserted=False).pom("n", reference("n")), TriplesMap("b", c, quoted("a")).pom("x", constant("1")), TriplesMap("d", o, quoted("b", ("k", "i"))).pom("x", constant("1")), TriplesMap("w", c, template("{i}")).pom("n", reference("n")).pom("m", reference("m"))))


def test_plan(tmp_path):
    made = plan(maps())
    assert made.levels == [["a", "w"], ["b"], ["d"]] and made.order == ["a", "w", "b", "d"]
    assert {k: v.role for k, v in made.maps.items()} == {"a": "quoted_support", "b": "quoted_consumer", "d": "quoted_consumer", "w": "asserted_base"}
    assert {k: v.last_level for k, v in made.maps.items()} == {"a": 2, "b": 2, "d": 2, "w": 0}
    assert (made.maps["a"].cache, made.maps["b"].cache, made.maps["w"].cache) == ("row", "join", "none") and made.maps["b"].signatures == [("k",)]
    assert aliases(maps()) == {"a": ("w", 0)} and made.batches() == [("c", ["w", "b"]), ("o", ["d"])]
    assert "3 levels" in made.summary() and "a is statement 0 of w" in made.summary()
    made.write(str(tmp_path / "plan.json"))
    assert json.loads((tmp_path / "plan.json").read_text())["levels"] == made.levels
    assert order_sources(maps())[0][0] == "o"


def test_reuse_strength():
    assert [reuse_strength(*x) for x in (("none", 0, 0, 0), ("row", 3, 0, 0), ("join", 2, 2, 1), ("join", 2, 2, 2), ("join", 3, 1, 1), ("join", 2, 1, 1), ("join", 4, 3, 3))] == ["none", "none", "high", "medium", "medium", "low", "low"]


def test_long_chains_are_planned_fast():
    c, began = LogicalSource("c"), time.perf_counter()
    chain = [TriplesMap("m0", c, template("{i}")).pom("n", reference("n"))] + [TriplesMap(f"m{k}", c, quoted(f"m{k - 1}")).pom("n", quoted(f"m{max(0, k - 2)}")) for k in range(1, 60)]
    made = plan(Mapping(tuple(chain)))
    assert made.maps["m0"].last_level == 59 and time.perf_counter() - began < 5


def test_shapes_tell_tables_and_conditions_apart():
    one = lambda table, value="n": TriplesMap("x", LogicalSource("db", "jdbc", table=table), template("{i}")).pom("n", reference(value))
    shape = lambda m: statement_shape(m, m.poms[0])
    assert shape(one("t")) == shape(one("t")) != shape(one("u")) and shape(one("t", "n[a=1]")) != shape(one("t"))


def test_alias_groups_and_counts():
    made = plan(maps())
    assert made.alias_groups() == {("w", 0): (["a"], 2)}
    m = Mapping((TriplesMap("m", LogicalSource("c"), template("{i}"), classes=("C",)).pom("n", reference("n")).pom(GENERAL[1], template("{x}")).pom(GENERAL[1], template("{x}")),))
    assert predicate_counts(m) == {"n": 1, f"{GENERAL[1]}_{{x}}": 2, "http://www.w3.org/1999/02/22-rdf-syntax-ns#type_<C>": 1}


def test_database_in_a_document():
    m = parse_mapping('''@prefix r: <http://w3id.org/rml/> . @prefix d: <http://www.wiwiss.fu-berlin.de/suhl/bizer/D2RQ/0.1#> . @base <http://b/> .
    <db> a d:Database ; d:jdbcDSN "jdbc:x:y" ; d:jdbcDriver "x.Driver" ; d:username "u" ; d:password "p" .
    <m> r:logicalSource [ r:source <db> ; r:tableName "t" ] ; r:subjectMap [ r:template "{i}" ] .''')
    assert m.maps[0].source == LogicalSource("http://b/db", "jdbc", table="t", connection=(("url", "jdbc:x:y"), ("driver", "x.Driver"), ("user", "u"), ("password", "p")))


def test_levels_grow():
    made = plan(maps())
    assert all(made.maps[q].level < m.level for m in made.maps.values() for q in m.quotes)
