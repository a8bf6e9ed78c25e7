"""From a mapping document to the model."""

from __future__ import annotations

from pathlib import Path

from .model import LogicalSource, Mapping, PredicateObjectMap, TermMap, TriplesMap, constant, parent, quoted, reference, template
from .turtle import RDF, Graph, read_turtle

RML = "http://w3id.org/rml/"
#: The properties of a database and the options that they stand for.
DATABASE = {"http://www.wiwiss.fu-berlin.de/suhl/bizer/D2RQ/0.1#" + k: v for k, v in (("jdbcDSN", "url"), ("jdbcDriver", "driver"), ("username", "user"), ("password", "password"))}
#: Names of reference formulations and the formats that they read.
FORMATS = {"csv": "csv", "tsv": "tsv", "jsonpath": "json", "json": "json", "jsonl": "jsonl", "xpath": "xml", "xml": "xml", "sql2008table": "jdbc", "sql2008query": "jdbc", "parquet": "parquet", "table": "table"}


def _r(*names: str) -> tuple[str, ...]:
    return tuple(RML + n for n in names)


def _source(g: Graph, node: str) -> LogicalSource:
    name = g.one(node, *_r("source")) or ""
    formulation = (g.one(node, *_r("referenceFormulation")) or "CSV").replace("#", "/").rsplit("/", 1)[-1].lower()
    kind = FORMATS.get(formulation, formulation)
    connection = tuple((option, str(value)) for p, option in DATABASE.items() if (value := g.one(name, p)) is not None)
    if connection:
        return LogicalSource(str(name), "jdbc", None, g.one(node, *_r("tableName")), g.one(node, *_r("query")), connection=connection)
    name = name.removeprefix("file://")
    if kind == "csv" and name and ".csv" not in name and "." in name:
        kind = "tsv"  # files of other names hold tabs
    return LogicalSource(name, kind, g.one(node, *_r("iterator")), g.one(node, *_r("tableName")), g.one(node, *_r("query")), encoding=g.one(node, *_r("encoding")))


def _joins(g: Graph, node: str) -> tuple[tuple[str, str], ...]:
    pairs = [(g.one(j, *_r("child")), g.one(j, *_r("parent"))) for j in g.all(node, *_r("joinCondition"))]
    return tuple(dict.fromkeys((c, p) for c, p in pairs if c not in (None, "None") and p not in (None, "None")))


def _short(g: Graph, node: str, *names: str) -> str | None:
    """A property that is a value, or a map with a constant or reference."""
    value = g.one(node, *_r(*names))
    return None if value is None else g.one(value, *_r("reference", "constant", "template")) or str(value)


def _options(g: Graph, node: str) -> dict:
    found = {"term_type": g.one(node, *_r("termType")), "datatype": _short(g, node, "datatype"), "language": g.one(node, *_r("language"))}
    language_map = g.one(node, *_r("languageMap"))
    if language_map is not None:
        found["language_map"] = g.one(language_map, *_r("reference")) or str(language_map)
    return {k: str(v) for k, v in found.items() if v is not None}


def _subject(g: Graph, node: str) -> TermMap:
    options = {k: v for k, v in _options(g, node).items() if k == "term_type"}
    for name, make in (("template", template), ("reference", reference), ("constant", constant)):
        if (value := g.one(node, *_r(name))) is not None:
            return make(str(value), **options)
    if (value := g.one(node, *_r("quotedTriplesMap"))) is not None:
        return quoted(str(value), *_joins(g, node))
    raise ValueError("a subject map has no template, reference, constant or quoted triples map")


def _object(g: Graph, node: str) -> TermMap | None:
    options = _options(g, node)
    if (value := g.one(node, *_r("constant"))) is not None:
        return constant(str(value), datatype=options.get("datatype"))
    if (value := g.one(node, *_r("template"))) is not None:
        return template(str(value), **options)
    if (value := g.one(node, *_r("reference"))) is not None:
        return reference(str(value), **options)
    if (value := g.one(node, *_r("quotedTriplesMap"))) is not None:
        return quoted(str(value), *_joins(g, node))
    if (value := g.one(node, *_r("parentTriplesMap"))) is not None:
        return parent(str(value), *_joins(g, node), **options)
    return None


def _predicate(g: Graph, node: str) -> TermMap | None:
    for name, make in (("constant", constant), ("template", template), ("reference", reference)):
        if (value := g.one(node, *_r(name))) is not None:
            return make(str(value))
    return None


def _graphs(g: Graph, node: str) -> tuple[str, ...]:
    found = [str(x) for x in g.all(node, *_r("graph"))]
    found += [str(v) for m in g.all(node, *_r("graphMap")) for v in g.all(m, *_r("constant", "template"))]
    return tuple(dict.fromkeys(x for x in found if "defaultGraph" not in x))


def mapping_from_graph(g: Graph) -> Mapping:
    """Every node that has a logical source and a subject map, in document order. Plain maps come first, then parent joins, then quoted objects."""
    maps = []
    for node in g.triples:
        source, subject = g.one(node, *_r("logicalSource")), g.one(node, *_r("subjectMap"))
        if source is None or subject is None:
            continue
        poms: list[PredicateObjectMap] = []
        for p in g.all(node, *_r("predicateObjectMap")):
            predicates = [x for x in (_predicate(g, m) for m in g.all(p, *_r("predicateMap"))) if x] + [constant(str(x)) for x in g.all(p, *_r("predicate"))]
            objects = [x for x in (_object(g, m) for m in g.all(p, *_r("objectMap"))) if x] + [constant(str(x)) for x in g.all(p, *_r("object"))]
            poms += [PredicateObjectMap(a, b, _graphs(g, p)) for a in predicates for b in objects]
        poms.sort(key=lambda p: {"parent": 1, "quoted": 2}.get(p.object.kind, 0))
        classes = tuple(dict.fromkeys(str(c) for c in g.all(subject, *_r("class"))))
        asserted = RML + "NonAssertedTriplesMap" not in g.all(node, RDF + "type")
        maps.append(TriplesMap(str(node), _source(g, source), _subject(g, subject), tuple(poms), classes, _graphs(g, subject), asserted))
    return Mapping(tuple(maps), g.base)


def parse_mapping(text: str) -> Mapping:
    return mapping_from_graph(read_turtle(text))


def load_mapping(path: str) -> Mapping:
    return parse_mapping(Path(path).read_text(encoding="utf-8"))
