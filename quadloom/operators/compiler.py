"""Compiles a mapping to one DataFrame of statements: ``subject, predicate, object, graph``.

Whatever depends on one row alone is one array expression over that row: the statements of a map, and of every map on
the same source that it quotes, at any depth. Joins appear only for parents and quoted maps of other rows. The result of
a map is the union of a few branches, each a frame (the source, with the columns that joins have added) and an array of
statements over it.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import terms
from ..plans.model import LogicalSource, Mapping, TermMap, TriplesMap
from ..plans.planner import Plan, plan, statement_shape
from ..plans.turtle import RDF

COLUMNS = ["subject", "predicate", "object", "graph"]
_FILTER = re.compile(r"^(.+?)\[\?\(@\.(.+?)\s*(==|!=)\s*(.+?)\)\](?:\.(.+))?$")


@dataclass(frozen=True)
class Options:
    """``dedup``: distinct statements. ``graph_in_key``: two graphs make two statements. ``legacy_composite_key``: composite
    keys are equal if their joined text is. ``legacy_escapes``: literals have apostrophes for double quotes, with two
    backslashes before them; else they are escaped as N-Triples asks. ``persist``: keep inputs that several consumers join."""

    dedup: bool = True
    graph_in_key: bool = True
    legacy_composite_key: bool = False
    legacy_escapes: bool = True
    persist: bool = False


@dataclass(frozen=True)
class Branch:
    """Statements (an array of structs s, p, o, g) over the rows of a frame."""

    frame: DataFrame
    statements: Column


@dataclass(frozen=True)
class Terms:
    """Alternatives for one position of a statement: one term, or an array of quoted statements, over a frame."""

    frame: DataFrame
    value: Column
    many: bool = False


def field_of(frame: DataFrame, name: str) -> Column:
    """A source value as text: a column, a dotted path into it, or the last element of a list that a filter matches."""
    name = name.strip()
    if name in frame.columns:
        return _as_text(F.col(f"`{name}`"), frame.schema[name].dataType, name)
    if m := _FILTER.match(name):
        path, inner, sign, wanted, rest = m.groups()
        column, kind = _walk(frame, path)
        if column is not None and isinstance(kind, T.ArrayType):
            wanted = wanted.strip("'\"")
            test = (lambda x: x.getField(inner).cast("string") == wanted) if sign == "==" else (lambda x: x.getField(inner).cast("string") != wanted)
            found = F.try_element_at(F.filter(column, test), F.lit(-1))
            for part in (rest or "").split(".") if rest else ():
                found = found.getField(part)
            return found.cast("string")
    column, kind = _walk(frame, name.split("[", 1)[0])
    if column is None:
        warnings.warn(f"the source has no attribute {name}", stacklevel=2)
        return F.lit(None).cast("string")
    return _as_text(column, kind, name)


def _walk(frame: DataFrame, path: str) -> tuple[Column | None, T.DataType | None]:
    if path in frame.columns:
        return F.col(f"`{path}`"), frame.schema[path].dataType
    head, *rest = path.split(".")
    if head not in frame.columns:
        return None, None
    column, kind = F.col(f"`{head}`"), frame.schema[head].dataType
    for part in rest:
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return None, None
        column, kind = column.getField(part), kind[part].dataType
    return column, kind


def _as_text(column: Column, kind: T.DataType, name: str) -> Column:
    if isinstance(kind, T.StructType):
        raise ValueError(f"{name} is a structure; a field of it must be named")
    if isinstance(kind, T.DoubleType | T.FloatType):
        return terms.float_text(column)
    return column if isinstance(kind, T.StringType) else column.cast("string")


class Compiler:
    """Turns triples maps into DataFrames. ``read`` gives the DataFrame of a logical source; it is called once for each."""

    def __init__(self, mapping: Mapping, read: Callable[[LogicalSource], DataFrame], options: Options | None = None):
        self.plan: Plan = plan(mapping)  # rejects circles
        self.mapping, self.read, self.options = mapping, read, options or Options()
        self.frames: dict[LogicalSource, DataFrame] = {}
        self.values: dict[tuple[LogicalSource, str], terms.Value] = {}
        self.producers: dict[tuple, DataFrame] = {}
        self.held: list[DataFrame] = []
        self.fresh = count()

    # sources and terms

    def source(self, source: LogicalSource) -> DataFrame:
        """The rows of a source, with each form of the values that some map uses as a column; what is not used is pruned."""
        if source not in self.frames:
            names = list(dict.fromkeys(n for m in self.mapping.maps for n in self.names(m, source)))
            raw = self.read(replace(source, columns=tuple(names)))
            steps: dict[str, dict[str, Column]] = {form: {} for form, _ in terms.FORMS}
            for at, name in enumerate(names):
                column, made = field_of(raw, name), {}
                numeric = name in raw.columns and isinstance(raw.schema[name].dataType, T.IntegralType | T.DoubleType | T.FloatType)
                for form, make in terms.FORMS:
                    title = f"__{form}_{at}"
                    if numeric and (form != "encoded" or isinstance(raw.schema[name].dataType, T.IntegralType)):  # digits are the same in every form, but for the sign of an exponent
                        title = f"__key_{at}"
                        steps["key"][title] = column
                    else:
                        steps[form][title] = make({"raw": column, **made})
                    made[form] = F.col(title)
                self.values[source, name] = terms.Value(**made)
            for step in steps.values():
                raw = raw.withColumns(step) if step else raw
            self.frames[source] = raw
        return self.frames[source]

    def names(self, m: TriplesMap, source: LogicalSource) -> list[str]:
        """The attributes of a source that a map mentions: its own, and those of parents and producers on that source."""
        found: list[str] = []
        if m.source == source:
            every = [m.subject, *(t for p in m.poms for t in (p.predicate, p.object))]
            texts = [t.value for t in every if t.kind == "template"] + [*m.graphs, *(g for p in m.poms for g in p.graphs)]
            found += [name for text in texts for name, is_name in terms.template_parts(text) if is_name]
            found += [t.value for t in every if t.kind == "reference"] + [t.language_map for t in every if t.language_map]
            found += [c for t in every for c, _ in t.joins]
        return found + [p for t, _ in m.references() if self.mapping.index[t.value].source == source for _, p in t.joins]

    def value(self, source: LogicalSource, name: str) -> terms.Value:
        self.source(source)
        return self.values[source, name]

    def template(self, source: LogicalSource, text: str) -> Column:
        return terms.template(text, lambda name: self.value(source, name))

    def subject(self, m: TriplesMap) -> Column:
        """The subject of a map that quotes nothing there."""
        s = m.subject
        if s.kind == "constant":
            return F.lit(f"<{s.value}>")
        if s.kind == "template":
            return terms.subject_template(self.template(m.source, s.value), s.term_type, self.mapping.base, bool(s.condition))
        return terms.subject_reference(self.value(m.source, s.value).reference, s.term_type, self.mapping.base)

    def predicate(self, t: TermMap, source: LogicalSource) -> Column:
        if t.kind == "constant":
            return F.lit(f"<{t.value}>")
        return terms.iri(self.template(source, t.value) if t.kind == "template" else self.value(source, t.value).reference)

    def object(self, t: TermMap, source: LogicalSource) -> Column:
        if t.kind == "constant":
            return F.lit(terms.object_constant(t.value, t.datatype, self.options.legacy_escapes))
        suffix, legacy = None, self.options.legacy_escapes
        if t.language:
            suffix = F.lit(terms.language_suffix(t.language)) if t.kind == "reference" else None
        elif t.language_map:
            suffix = terms.language_column(self.value(source, t.language_map).reference)
        if t.kind == "template":
            return terms.object_template(self.template(source, t.value), t.term_type, t.datatype, suffix, legacy)
        value = self.value(source, t.value)
        return terms.object_reference(value.reference if legacy else value.plain, t.term_type, t.datatype, suffix, legacy)

    def graph(self, text: str, source: LogicalSource) -> Column:
        return terms.iri(self.template(source, text))

    # statements

    def branches(self, m: TriplesMap, frame: DataFrame) -> list[Branch]:
        """All statements of a map over the rows of ``frame``."""
        plain = m.subject.kind != "quoted"
        graphs = [self.graph(g, m.source) for g in m.graphs] or [F.lit(None).cast("string")]
        subjects = [Terms(frame, self.subject(m))] if plain else self.quoted_terms(m, m.subject, frame)
        out: list[Branch] = []
        for s in subjects:
            here: list[Column] = []
            if plain and m.classes:
                here.append(F.array(*[_statement(s.value, F.lit(f"<{RDF}type>"), F.lit(f"<{c}>"), g) for c in m.classes for g in graphs]))
            for pom in m.poms:
                p = self.predicate(pom.predicate, m.source)
                # a map's own graphs hold all its statements; a predicate's graph holds one more
                gs = graphs + [self.graph(g, m.source) for g in pom.graphs]
                if pom.object.kind == "parent":
                    objects = self.parent_terms(m, pom.object, s.frame) if plain else []
                elif pom.object.kind == "quoted":
                    objects = self.quoted_terms(m, pom.object, s.frame)
                else:
                    objects = [Terms(s.frame, self.object(pom.object, m.source))]
                for o in objects:
                    made = _combine(s, p, o, gs)
                    if o.frame is s.frame:
                        here.append(made)
                    else:
                        out.append(Branch(o.frame, made))
            if here:
                out.append(Branch(s.frame, here[0] if len(here) == 1 else F.concat(*here)))
        return out

    def quoted_terms(self, m: TriplesMap, t: TermMap, frame: DataFrame) -> list[Terms]:
        producer = self.mapping.index[t.value]
        if producer.source == m.source and not t.joins:  # the same row: no join
            return [Terms(b.frame, F.transform(_whole(b.statements), lambda x: terms.quoted(x.s, x.p, x.o)), True) for b in self.branches(producer, frame)]
        if not t.joins:  # another source without a condition gives nothing
            return []
        made = self.producer(producer, tuple(p for _, p in t.joins))
        joined, column = self.join(frame, made, m.source, [c for c, _ in t.joins])
        return [Terms(joined, F.array(column), True)]

    def parent_terms(self, m: TriplesMap, t: TermMap, frame: DataFrame) -> list[Terms]:
        other = self.mapping.index[t.value]
        if other.subject.kind == "quoted":
            return []
        if other.source == m.source and all(c == p for c, p in t.joins):  # the same row
            return [Terms(frame, self.subject(other))]
        if not t.joins:
            return []
        rows = self.source(other.source)
        keys = self.keys(other.source, [p for _, p in t.joins])
        made = rows.select(*[k.alias(f"k{i}") for i, k in enumerate(keys)], self.subject(other).alias("term")).where("term is not null").distinct()
        joined, column = self.join(frame, made, m.source, [c for c, _ in t.joins])
        return [Terms(joined, column)]

    def keys(self, source: LogicalSource, names: list[str]) -> list[Column]:
        columns = [self.value(source, n).key for n in names]
        return [terms.composite_key(*columns)] if self.options.legacy_composite_key and len(columns) > 1 else columns

    def producer(self, m: TriplesMap, key_names: tuple[str, ...]) -> DataFrame:
        """``k0.., term``: the distinct quoted statements of a map under each key. Maps of equal statements share one."""
        shape = (tuple(statement_shape(m, p) for p in m.poms), m.classes, m.subject, m.source, key_names)
        if shape not in self.producers:
            rows = self.source(m.source)
            parts = []
            for b in self.branches(m, rows):
                keys = self.keys(m.source, list(key_names))
                flat = b.frame.select(*[k.alias(f"k{i}") for i, k in enumerate(keys)], F.explode(b.statements).alias("x")).where("x.s is not null and x.p is not null and x.o is not null")
                parts.append(flat.select(*[f"k{i}" for i in range(len(keys))], terms.quoted(F.col("x.s"), F.col("x.p"), F.col("x.o")).alias("term")))
            made = reduce(DataFrame.unionByName, parts).distinct()
            if self.options.persist and m.id in self.plan.shared():
                made = made.persist()
                self.held.append(made)
            self.producers[shape] = made
        return self.producers[shape]

    def join(self, frame: DataFrame, made: DataFrame, source: LogicalSource, child: list[str]) -> tuple[DataFrame, Column]:
        """Inner equality join of the rows of a frame with the terms under their key; which strategy is Spark's choice."""
        n = next(self.fresh)
        keys = self.keys(source, child)
        right = made.toDF(*[f"__k{n}_{i}" for i in range(len(keys))], f"__t{n}")
        same = reduce(lambda a, b: a & b, [k == F.col(f"__k{n}_{i}") for i, k in enumerate(keys)])
        joined = frame.join(right, same, "inner").drop(*[f"__k{n}_{i}" for i in range(len(keys))])
        return joined, F.col(f"__t{n}")

    def statements(self, m: TriplesMap) -> DataFrame:
        """The statements of one map, with repeats."""
        parts = []
        for b in self.branches(m, self.source(m.source)):
            flat = b.frame.select(F.explode(b.statements).alias("x")).where("x.s is not null and x.p is not null and x.o is not null")
            parts.append(flat.select(F.col("x.s").alias("subject"), F.col("x.p").alias("predicate"), F.col("x.o").alias("object"), F.col("x.g").alias("graph")))
        if not parts:
            spark = self.source(m.source).sparkSession
            return spark.createDataFrame([], ", ".join(f"{c} string" for c in COLUMNS))
        return reduce(DataFrame.unionByName, parts)

    def graph_of(self, maps: list[TriplesMap] | None = None) -> DataFrame:
        """The statements of all asserted maps."""
        chosen = self.plan.asserted() if maps is None else maps
        if not chosen:
            raise ValueError("the mapping asserts nothing")
        whole = reduce(DataFrame.unionByName, [self.statements(m) for m in chosen])
        return distinct_statements(whole, self.options.graph_in_key) if self.options.dedup else whole

    def release(self) -> None:
        """Free what was kept for reuse."""
        for df in self.held:
            df.unpersist()
        self.held.clear()


def distinct_statements(df: DataFrame, graph_in_key: bool = True) -> DataFrame:
    """Each statement once; without the graph in the key, a statement of several graphs keeps the least of them (none first)."""
    if graph_in_key:
        return df.distinct()
    plain = F.max(F.col("graph").isNull())
    return df.groupBy("subject", "predicate", "object").agg(F.when(~plain, F.min("graph")).alias("graph"))


def _statement(s: Column, p: Column, o: Column, g: Column) -> Column:
    return F.struct(s.alias("s"), p.alias("p"), o.alias("o"), g.alias("g"))


def _whole(statements: Column) -> Column:
    return F.filter(statements, lambda x: x.s.isNotNull() & x.p.isNotNull() & x.o.isNotNull())


def _combine(s: Terms, p: Column, o: Terms, graphs: list[Column]) -> Column:
    """Statements of all alternatives of subject and object, in each graph."""
    if not s.many and not o.many:
        return F.array(*[_statement(s.value, p, o.value, g) for g in graphs])
    if s.many and not o.many:
        return F.flatten(F.transform(s.value, lambda x: F.array(*[_statement(x, p, o.value, g) for g in graphs])))
    if o.many and not s.many:
        return F.flatten(F.transform(o.value, lambda y: F.array(*[_statement(s.value, p, y, g) for g in graphs])))
    return F.flatten(F.transform(s.value, lambda x: F.flatten(F.transform(o.value, lambda y: F.array(*[_statement(x, p, y, g) for g in graphs])))))


def compile_mapping(mapping: Mapping, read: Callable[[LogicalSource], DataFrame], options: Options | None = None) -> DataFrame:
    return Compiler(mapping, read, options).graph_of()
