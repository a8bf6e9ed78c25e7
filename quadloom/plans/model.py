"""The mapping model: sources, term maps, predicate-object maps and triples maps."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

Join = tuple[str, str]  # child column, parent column


@dataclass(frozen=True)
class LogicalSource:
    name: str
    format: str = "csv"  # csv, tsv, json, xml, jdbc, parquet or table
    iterator: str | None = None
    table: str | None = None
    query: str | None = None
    delimiter: str | None = None
    encoding: str | None = None
    #: options of a database, as pairs
    connection: tuple[tuple[str, str], ...] = ()
    #: what a reader is asked for: the attributes that the mapping mentions
    columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class TermMap:
    """How one term is made. ``kind``: constant, template, reference, quoted (``value`` is a triples map's id) or parent."""

    kind: str
    value: str
    term_type: str | None = None
    datatype: str | None = None
    language: str | None = None
    language_map: str | None = None
    joins: tuple[Join, ...] = ()
    condition: str = ""


@dataclass(frozen=True)
class PredicateObjectMap:
    predicate: TermMap
    object: TermMap
    graphs: tuple[str, ...] = ()


@dataclass(frozen=True)
class TriplesMap:
    id: str
    source: LogicalSource
    subject: TermMap
    poms: tuple[PredicateObjectMap, ...] = ()
    classes: tuple[str, ...] = ()
    graphs: tuple[str, ...] = ()
    asserted: bool = True

    def pom(self, predicate: str | TermMap, obj: TermMap, *graphs: str) -> TriplesMap:
        """This map with one more predicate-object map."""
        made = predicate if isinstance(predicate, TermMap) else constant(predicate)
        return replace(self, poms=(*self.poms, PredicateObjectMap(made, obj, graphs)))

    def references(self) -> list[tuple[TermMap, str]]:
        """The maps that point to another triples map, and where: ``subject`` or ``object``."""
        found = [(self.subject, "subject")] if self.subject.kind == "quoted" else []
        return found + [(p.object, "object") for p in self.poms if p.object.kind in ("quoted", "parent")]


@dataclass(frozen=True)
class Mapping:
    maps: tuple[TriplesMap, ...]
    base: str = ""
    index: dict[str, TriplesMap] = field(init=False, compare=False, repr=False)

    def __post_init__(self):
        object.__setattr__(self, "index", {m.id: m for m in self.maps})
        if len(self.index) != len(self.maps):
            raise ValueError("two triples maps have the same id")
        for m in self.maps:
            for term, _ in m.references():
                if term.value not in self.index:
                    raise ValueError(f"{m.id} refers to {term.value}, which the mapping does not have")


def _split_condition(value: str) -> tuple[str, str]:
    """A bracketed condition is kept aside; it only tells some term rules apart and filters nothing."""
    at = value.find("[")
    return (value, "") if at < 0 or "[?(" in value else (value[:at] + value[value.rfind("]") + 1 :], value[at + 1 : value.rfind("]")])


def constant(value: str, **options) -> TermMap:
    return TermMap("constant", value, **options)


def template(value: str, **options) -> TermMap:
    text, condition = _split_condition(value)
    return TermMap("template", text, condition=condition, **options)


def reference(value: str, **options) -> TermMap:
    text, condition = _split_condition(value)
    return TermMap("reference", text, condition=condition, **options)


def quoted(map_id: str, *joins: Join) -> TermMap:
    return TermMap("quoted", map_id, joins=tuple(joins))


def parent(map_id: str, *joins: Join, **options) -> TermMap:
    return TermMap("parent", map_id, joins=tuple(joins), **options)
