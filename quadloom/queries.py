"""Queries over the driver's tables, each a mapping, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import terms
from .operators.compiler import Compiler, Options
from .plans.model import LogicalSource, Mapping, TermMap, TriplesMap, constant, parent, quoted, reference, template
from .sources import sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
EX = "http://ex/"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(column: str) -> F.Column:
    """A double as text of a fixed scale."""
    return F.col(column).cast("decimal(18,2)").cast("string")


def source(name: str) -> LogicalSource:
    return LogicalSource(name, "parquet")


def tm(id: str, table_name: str, subject: TermMap, *poms: tuple, **options) -> TriplesMap:
    m = TriplesMap(id, source(table_name), subject, **options)
    for predicate, obj, *graphs in poms:
        m = m.pom(predicate, obj, *graphs)
    return m


#: Tables with added text columns, by the name that mappings use.
DERIVED: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "orders_text": ("orders", lambda d: d.withColumn("price", money("o_totalprice")).withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))),
    "lineitem_text": ("lineitem", lambda d: d.withColumn("price", money("l_extendedprice")).withColumn("padded", F.concat(F.lit("00"), money("l_quantity")))),
    "events_nulls": ("events", lambda d: d.withColumn("kind", F.when(F.col("event_type") == "error", "N/A").when(F.col("event_type") == "click", " | ").when(F.col("event_type") == "view", "nan").otherwise(F.col("event_type"))).withColumn("who", F.when(F.col("user_id") % 7 != 0, F.col("user_id")))),
    "lineitem_view": ("lineitem", lambda d: d.select(F.col("l_orderkey").alias("ok"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"))),
    "lineitem_doubles": ("lineitem", lambda d: d.withColumns({f"x{k}": x for k, x in enumerate((F.col("l_extendedprice"), F.col("l_extendedprice") * 1e-12, F.col("l_extendedprice") / 7, F.col("l_extendedprice") * 1e9, F.col("l_extendedprice") * 1e14, F.col("l_extendedprice") / 1e9))})),
    "orders_nested": ("orders", lambda d: d.withColumn("inner", F.struct(F.col("o_custkey").alias("customer"))).withColumn("a.b", F.col("o_orderpriority")).withColumn("parts", F.array(*[F.struct(f.alias("f"), g.cast("string").alias("g")) for f, g in ((F.lit("F"), F.col("o_orderkey")), (F.lit("x"), F.col("o_custkey")), (F.col("o_orderstatus"), F.col("o_orderpriority")))]))),
    "few_customers": ("customer", lambda d: d.where(F.col("c_mktsegment") == "BUILDING")),
}


def read_tables(spark: SparkSession, sf_dir: str):
    def read(s: LogicalSource) -> DataFrame:
        base, change = DERIVED.get(s.name, (s.name, lambda d: d))
        return change(table(spark, sf_dir, base))

    return read


def add(name: str, *maps: TriplesMap, sql: str | None, dedup: bool = True, base: str = "", graph: bool = False, **options) -> None:
    """Registers the query of a mapping. ``sql`` gives subject, predicate, object (and graph)."""
    mapping = Mapping(maps, base)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        whole = Compiler(mapping, read_tables(spark, sf_dir), Options(dedup=dedup, **options)).graph_of()
        return whole if graph else whole.drop("graph")

    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = sql


def enc(x: str) -> str:
    for old, new in (("%7E", "~"), ("%2F", "/"), ("%23", "#"), ("%3A", ":")):
        x = f"replace({x}, '{old}', '{new}')" if old != "%7E" else f"url_encode({x})"
    return x


def lit(x: str) -> str:
    """A literal's text by the escape rules."""
    x = f"""replace(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), '"', '''')"""
    x = f"replace(replace(replace({x}, '\\', '\\\\'), '''', '\\\\'''), chr(10), '\\n')"
    return f"""'"' || {x} || '"'"""


def iri(prefix: str, x: str) -> str:
    return f"'<{prefix}' || {x} || '>'"


def rows(table_name: str, *statements: tuple[str, str, str], distinct: bool = True, where: str = "") -> str:
    """Statements of one table, united."""
    parts = [f"SELECT {s} AS subject, {p} AS predicate, {o} AS object FROM {table_name}{' WHERE ' + where if where else ''}" for s, p, o in statements]
    return (" UNION " if distinct else " UNION ALL ").join(parts) if len(parts) > 1 else parts[0].replace("SELECT", "SELECT DISTINCT", 1) if distinct else parts[0]


def cls(name: str) -> tuple[str, str]:
    return "'<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>'", f"'<{EX}{name}>'"


def quote(s: str, p: str, o: str) -> str:
    return f"'<< ' || {s} || ' ' || {p} || ' ' || {o} || ' >>'"


NATION, REGION, CUST, ORDER = (template(f"{EX}{n}/{{{c}}}") for n, c in (("nation", "n_nationkey"), ("region", "r_regionkey"), ("customer", "c_custkey"), ("order", "o_orderkey")))
LINE = template(f"{EX}line/{{l_orderkey}}/{{l_linenumber}}")
s_nation, s_region, s_cust, s_order = (iri(f"{EX}{n}/", c) for n, c in (("nation", "n_nationkey"), ("region", "r_regionkey"), ("customer", "c_custkey"), ("order", "o_orderkey")))
s_line = f"'<{EX}line/' || l_orderkey || '/' || l_linenumber || '>'"
P = {k: f"'<{EX}{k}>'" for k in "name key type of in by from says seen size price kind label at part note source held sees told is was lines home".split()}


def p(k: str) -> str:
    return f"{EX}{k}"


add("scan_project_nation", tm("n", "nation", NATION, (p("name"), reference("n_name")), (p("key"), template("k-{n_nationkey}", term_type="Literal")), (p("of"), template(f"{EX}region/{{n_regionkey}}")), classes=(p("Nation"),)), sql=rows("nation", (s_nation, P["name"], lit("n_name")), (s_nation, P["key"], "'\"k-' || n_nationkey || '\"'"), (s_nation, P["of"], iri(f"{EX}region/", "n_regionkey")), (s_nation, *cls("Nation"))))
add("class_triples", tm("n", "nation", NATION, classes=(p("Nation"), p("Place"))), tm("r", "region", REGION, classes=(p("Place"),)), sql=" UNION ".join([rows("nation", (s_nation, *cls("Nation")), (s_nation, *cls("Place"))), rows("region", (s_region, *cls("Place")))]))
s_part = iri(f"{EX}part/", enc("p_name"))
add("iri_template_encoded", tm("x", "part", template(f"{EX}part/{{p_name}}"), (p("type"), template(f"{EX}type/{{p_type}}"))), sql=rows("part", (s_part, P["type"], iri(f"{EX}type/", enc("p_type")))))
twice = enc(f"('{EX}part/' || {enc('p_name')})")
add("iri_template_double_encoded", tm("x", "part", template(f"{EX}part/{{p_name}}", term_type="IRI"), (p("size"), reference("p_size"))), sql=rows("part", (iri("", twice), P["size"], "'\"' || p_size || '\"'")))
add("iri_template_base", tm("n", "nation", template("n-{n_nationkey}", term_type="IRI"), (p("name"), reference("n_name"))), base="http://base/", sql=rows("nation", ("'<http://base/n-' || n_nationkey || '>'", P["name"], lit("n_name"))))
add("blank_node_subject", tm("e", "events", template("e/{event_type}.{user_id}", term_type="BlankNode"), (p("kind"), reference("event_type"))), sql=rows("events", ("'_:e2F' || event_type || '2E' || user_id", P["kind"], lit("event_type"))))
add("blank_node_object", tm("x", "part", template(f"{EX}part/{{p_partkey}}"), (p("is"), template("t/{p_type}", term_type="BlankNode"))), sql=rows("part", (iri(f"{EX}part/", "p_partkey"), P["is"], "replace(replace(" + enc("('_:t/' || p_type)") + ", '/', '2F'), '.', '2E')")))
add("reference_subject_iri", tm("n", "nation", reference("n_name", term_type="IRI"), (p("key"), reference("n_nationkey"))), base="http://base/", sql=rows("nation", ("'<http://base/' || n_name || '>'", P["key"], "'\"' || n_nationkey || '\"'"), where="NOT contains(n_name, ' ')"))
add("constant_terms", tm("r", "region", constant(p("world")), (p("of"), constant("http://ex/space")), (p("label"), constant("abc")), (p("price"), constant("http://ex/y", datatype="http://ex/dt")), (p("in"), template(f"{EX}region/{{r_regionkey}}"))), sql=rows("region", (f"'<{EX}world>'", P["of"], "'<http://ex/space>'"), (f"'<{EX}world>'", P["label"], "'\"abc\"'"), (f"'<{EX}world>'", P["price"], "'\"http://ex/y\"^^<http://ex/dt>'"), (f"'<{EX}world>'", P["in"], s_region)))
s_user = iri(f"{EX}user/", "user_id")
add("predicate_template", tm("e", "events", template(f"{EX}user/{{user_id}}"), (template(f"{EX}did/{{event_type}}"), template(f"{EX}event/{{event_id}}"))), sql=rows("events", (s_user, iri(f"{EX}did/", "event_type"), iri(f"{EX}event/", "event_id"))))
add("predicate_reference", tm("e", "events", template(f"{EX}user/{{user_id}}"), (reference("event_type"), template(f"{EX}event/{{event_id}}"))), sql=rows("events", (s_user, iri("", "event_type"), iri(f"{EX}event/", "event_id"))))
add("literal_escape", tm("d", "documents", template(f"{EX}doc/{{doc_id}}"), (p("says"), reference("text"))), tm("c", "conversations", template(f"{EX}turn/{{conv_id}}/{{turn}}"), (p("says"), reference("text"))), sql=" UNION ".join([rows("documents", (iri(f"{EX}doc/", "doc_id"), P["says"], lit("text"))), rows("conversations", (f"'<{EX}turn/' || conv_id || '/' || turn || '>'", P["says"], lit("text")))]))
add("literal_datatype", tm("o", "orders_text", ORDER, (p("at"), reference("day", datatype="http://www.w3.org/2001/XMLSchema#date")), (p("price"), reference("price", datatype="http://www.w3.org/2001/XMLSchema#decimal")), (p("kind"), constant("order", datatype="http://ex/kind"))), sql=rows("orders", (s_order, P["at"], "'\"' || strftime(o_orderdate, '%Y-%m-%d') || '\"^^<http://www.w3.org/2001/XMLSchema#date>'"), (s_order, P["price"], "'\"' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || '\"^^<http://www.w3.org/2001/XMLSchema#decimal>'"), (s_order, P["kind"], "'\"order\"^^<http://ex/kind>'")))
s_doc = iri(f"{EX}doc/", "doc_id")
add("literal_lang_const", tm("d", "documents", template(f"{EX}doc/{{doc_id}}"), (p("source"), reference("source", language="fr")), (p("label"), reference("source", language="de-AT")), (p("note"), reference("source", language="english"))), sql=rows("documents", (s_doc, P["source"], lit("source") + " || '@fr'"), (s_doc, P["label"], lit("source")), (s_doc, P["note"], lit("source") + " || '@en'")))
add("literal_lang_column", tm("d", "documents", template(f"{EX}doc/{{doc_id}}"), (p("source"), reference("source", language_map="lang"))), sql=rows("documents", (s_doc, P["source"], lit("source") + " || '@' || lang")))
add("object_iri_reference", tm("w", "pages", template(f"{EX}page/{{page_id}}"), (p("at"), reference("url", term_type="IRI"))), sql=rows("pages", (iri(f"{EX}page/", "page_id"), P["at"], iri("", enc("url")))))
add("object_blank_reference", tm("n", "nation", NATION, (p("in"), reference("n_regionkey", term_type="BlankNode"))), sql=rows("nation", (s_nation, P["in"], "'_:' || n_regionkey")))
add("null_rejection", tm("e", "events_nulls", template(f"{EX}user/{{who}}"), (p("kind"), reference("kind")), (p("seen"), template(f"{EX}event/{{event_id}}"))), sql=" UNION ".join([rows("events", (s_user, P["kind"], lit("event_type")), where="user_id % 7 <> 0 AND event_type NOT IN ('error', 'click', 'view')"), rows("events", (s_user, P["seen"], iri(f"{EX}event/", "event_id")), where="user_id % 7 <> 0")]))
dec = "regexp_replace(regexp_replace('00' || CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR), '^(-?)0+([0-9])', '\\1\\2'), '(\\.[0-9]+?)0+$', '\\1')"
add("decimal_normalise", tm("l", "lineitem_text", LINE, (p("size"), template("q {padded}", term_type="Literal")), (p("price"), reference("padded"))), sql=rows("lineitem", (s_line, P["size"], f"'\"q ' || {dec} || '\"'"), (s_line, P["price"], "'\"00' || CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR) || '\"'")))
add("multi_placeholder_template", tm("l", "lineitem", LINE, (p("note"), template("{l_returnflag}{l_linestatus}-{l_suppkey}", term_type="Literal", datatype="http://ex/code"))), sql=rows("lineitem", (s_line, P["note"], "'\"' || l_returnflag || l_linestatus || '-' || l_suppkey || '\"^^<http://ex/code>'")))

doubles = [f"l_extendedprice{x}" for x in ("", " * 1e-12", " / 7", " * 1e9", " * 1e14", " / 1e9")]
add("double_reference", tm("l", "lineitem_doubles", LINE, *[(p("price"), template(f"{k} {{x{k}}}", term_type="Literal")) for k in range(len(doubles))], (p("size"), reference("x2"))), sql=rows("lineitem", *[(s_line, P["price"], f"'\"{k} ' || CAST({x} AS VARCHAR) || '\"'") for k, x in enumerate(doubles)], (s_line, P["size"], f"'\"' || CAST({doubles[2]} AS VARCHAR) || '\"'")))
add("nested_path", tm("o", "orders_nested", ORDER, (p("by"), reference("inner.customer")), (p("kind"), reference("a.b"))), sql=rows("orders", (s_order, P["by"], "'\"' || o_custkey || '\"'"), (s_order, P["kind"], lit("o_orderpriority"))))
add("array_filter", tm("o", "orders_nested", ORDER, (p("seen"), reference("parts[?(@.f==F)].g")), (p("told"), reference("parts[?(@.f!='F')].g"))), sql=rows("orders", (s_order, P["seen"], "'\"' || CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE CAST(o_orderkey AS VARCHAR) END || '\"'"), (s_order, P["told"], "'\"' || CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority ELSE CAST(o_custkey AS VARCHAR) END || '\"'")))
add("subject_types", tm("a", "nation", template("n-{n_nationkey}", term_type="Literal"), (p("name"), reference("n_name"))), tm("b", "nation", template("o-{n_nationkey}", term_type="Other"), (p("name"), reference("n_name"))), tm("c", "nation", reference("n_nationkey", term_type="BlankNode"), (p("name"), reference("n_name"))), sql=rows("nation", ("'<o-' || n_nationkey || '>'", P["name"], lit("n_name")), ("'_:' || n_nationkey", P["name"], lit("n_name"))))
add("template_escapes", tm("n", "nation", NATION, (p("note"), template("\\{x\\}-{n_nationkey}\\{", term_type="Literal"))), sql=rows("nation", (s_nation, P["note"], "'\"{x}-' || n_nationkey || '{\"'")))
ntriples = r"""replace(replace(replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\', '\\'), '"', '\"'), chr(10), '\n')"""
add("valid_literals", tm("c", "conversations", template(f"{EX}turn/{{conv_id}}/{{turn}}"), (p("says"), reference("text"))), legacy_escapes=False, sql=rows("conversations", (f"'<{EX}turn/' || conv_id || '/' || turn || '>'", P["says"], f"""'"' || {ntriples} || '"'""")))

QUAD = "SELECT DISTINCT {} AS subject, {} AS predicate, {} AS object, {} AS graph FROM {}"
add("graph_constant", tm("o", "orders", ORDER, (p("by"), template(f"{EX}customer/{{o_custkey}}")), classes=(p("Order"),), graphs=(p("g"),)), graph=True, sql=" UNION ".join([QUAD.format(s_order, P["by"], iri(f"{EX}customer/", "o_custkey"), f"'<{EX}g>'", "orders"), QUAD.format(s_order, *cls("Order"), f"'<{EX}g>'", "orders")]))
add("graph_template", tm("c", "customer", CUST, (p("name"), reference("c_name")), graphs=(f"{EX}g/{{c_mktsegment}}",)), graph=True, sql=QUAD.format(s_cust, P["name"], lit("c_name"), iri(f"{EX}g/", enc("c_mktsegment")), "customer"))
add("pom_graph", tm("c", "customer", CUST, (p("name"), reference("c_name"), p("names")), (p("in"), template(f"{EX}nation/{{c_nationkey}}"), f"{EX}g/{{c_nationkey}}")), graph=True, sql=" UNION ".join(QUAD.format(s_cust, a, o, g, "customer") for a, o, gs in ((P["name"], lit("c_name"), ("CAST(NULL AS VARCHAR)", f"'<{EX}names>'")), (P["in"], iri(f"{EX}nation/", "c_nationkey"), ("CAST(NULL AS VARCHAR)", iri(f"{EX}g/", "c_nationkey")))) for g in gs))
add("graph_outside_dedup_key", tm("a", "customer", template(f"{EX}nation/{{c_nationkey}}"), (p("seen"), reference("c_mktsegment")), graphs=(f"{EX}g/{{c_mktsegment}}",)), graph=True, graph_in_key=False, sql=f"SELECT {iri(EX + 'nation/', 'c_nationkey')} AS subject, {P['seen']} AS predicate, {lit('c_mktsegment')} AS object, min({iri(EX + 'g/', enc('c_mktsegment'))}) AS graph FROM customer GROUP BY 1, 2, 3")
segment = (p("is"), template(f"{EX}segment/{{c_mktsegment}}"))
triples_segment = (f"'<{EX}customers>'", P["is"], iri(f"{EX}segment/", enc("c_mktsegment")))
add("dedup_triples", tm("c", "customer", constant(p("customers")), segment), sql=rows("customer", triples_segment))
add("bag_triples", tm("c", "customer", constant(p("customers")), segment), dedup=False, sql=rows("customer", triples_segment, distinct=False))
add("union_triples_maps", tm("n", "nation", NATION, (p("name"), reference("n_name"))), tm("r", "region", REGION, (p("name"), reference("r_name"))), tm("s", "supplier", template(f"{EX}supplier/{{s_suppkey}}"), (p("name"), reference("s_name"))), sql=" UNION ".join([rows("nation", (s_nation, P["name"], lit("n_name"))), rows("region", (s_region, P["name"], lit("r_name"))), rows("supplier", (iri(f"{EX}supplier/", "s_suppkey"), P["name"], lit("s_name")))]))

region_map = tm("r", "region", REGION, asserted=False)
add("parent_join_single", tm("n", "nation", NATION, (p("of"), parent("r", ("n_regionkey", "r_regionkey")))), region_map, sql=rows("nation JOIN region ON n_regionkey = r_regionkey", (s_nation, P["of"], s_region)))
add("parent_join_no_match", tm("o", "orders", ORDER, (p("by"), parent("c", ("o_custkey", "c_custkey")))), tm("c", "few_customers", CUST, asserted=False), sql=rows("orders JOIN customer ON o_custkey = c_custkey AND c_mktsegment = 'BUILDING'", (s_order, P["by"], s_cust)))
view_map = tm("v", "lineitem_view", template(f"{EX}supplier/{{sk}}"), asserted=False)
add("parent_join_composite", tm("l", "lineitem", LINE, (p("from"), parent("v", ("l_orderkey", "ok"), ("l_partkey", "pk")))), view_map, sql=rows("lineitem JOIN (SELECT DISTINCT l_orderkey AS ok, l_partkey AS pk, l_suppkey AS sk FROM lineitem) ON l_orderkey = ok AND l_partkey = pk", (s_line, P["from"], iri(f"{EX}supplier/", "sk"))))
add("parent_join_legacy_key", tm("l", "lineitem", LINE, (p("from"), parent("v", ("l_orderkey", "ok"), ("l_partkey", "pk")))), view_map, legacy_composite_key=True, sql=rows("lineitem JOIN (SELECT DISTINCT l_orderkey AS ok, l_partkey AS pk, l_suppkey AS sk FROM lineitem) ON l_orderkey || '_' || l_partkey = ok || '_' || pk", (s_line, P["from"], iri(f"{EX}supplier/", "sk"))))
add("parent_join_self", tm("a", "nation", NATION, (p("sees"), parent("b", ("n_nationkey", "n_regionkey")))), tm("b", "nation", template(f"{EX}land/{{n_name}}"), asserted=False), sql="SELECT DISTINCT '<http://ex/nation/' || a.n_nationkey || '>' AS subject, " + P["sees"] + " AS predicate, " + iri(f"{EX}land/", enc("b.n_name")) + " AS object FROM nation a JOIN nation b ON a.n_nationkey = b.n_regionkey")
add("parent_same_row", tm("o", "orders", ORDER, (p("by"), parent("k", ("o_custkey", "o_custkey")))), tm("k", "orders", template(f"{EX}customer/{{o_custkey}}"), asserted=False), sql=rows("orders", (s_order, P["by"], iri(f"{EX}customer/", "o_custkey"))))

line_fact = tm("q", "lineitem", LINE, (p("part"), template(f"{EX}part/{{l_partkey}}")), asserted=False)
q_line = quote(s_line, P["part"], iri(f"{EX}part/", "l_partkey"))
add("quoted_subject_same_row", tm("o", "lineitem", quoted("q"), (p("from"), template(f"{EX}supplier/{{l_suppkey}}"))), line_fact, sql=rows("lineitem", (q_line, P["from"], iri(f"{EX}supplier/", "l_suppkey"))))
order_fact = tm("q", "orders", ORDER, (p("by"), template(f"{EX}customer/{{o_custkey}}")), asserted=False)
q_order = quote(s_order, P["by"], iri(f"{EX}customer/", "o_custkey"))
add("quoted_object_same_row", tm("o", "orders", template(f"{EX}clerk/{{o_orderpriority}}"), (p("told"), quoted("q"))), order_fact, sql=rows("orders", (iri(f"{EX}clerk/", enc("o_orderpriority")), P["told"], q_order)))
state_fact = tm("t", "orders", ORDER, (p("is"), reference("o_orderstatus")), classes=(p("Order"),), asserted=False)
q_state, q_class = quote(s_order, P["is"], lit("o_orderstatus")), quote(s_order, *cls("Order"))
add("quoted_both", tm("o", "orders", quoted("q"), (p("was"), quoted("t"))), order_fact, state_fact, sql=rows("orders", (q_order, P["was"], q_state), (q_order, P["was"], q_class)))
name_fact = tm("a", "customer", CUST, (p("name"), reference("c_name")), asserted=False)
q_name = quote(s_cust, P["name"], lit("c_name"))
add("quoted_nested", tm("c", "customer", quoted("b"), (p("note"), constant("sure"))), tm("b", "customer", quoted("a"), (p("from"), template(f"{EX}nation/{{c_nationkey}}")), asserted=False), name_fact, sql=rows("customer", (quote(q_name, P["from"], iri(f"{EX}nation/", "c_nationkey")), P["note"], "'\"sure\"'")))
multi_fact = tm("a", "customer", CUST, (p("name"), reference("c_name")), (p("in"), template(f"{EX}nation/{{c_nationkey}}")), classes=(p("Customer"),), asserted=False)
add("quoted_multi_pom_producer", tm("o", "customer", quoted("a"), (p("source"), constant("crm"))), multi_fact, sql=rows("customer", *[(q, P["source"], "'\"crm\"'") for q in (q_name, quote(s_cust, P["in"], iri(f"{EX}nation/", "c_nationkey")), quote(s_cust, *cls("Customer")))]))
joined = "orders JOIN customer ON o_custkey = c_custkey"
add("quoted_subject_join", tm("o", "orders", quoted("a", ("o_custkey", "c_custkey")), (p("from"), ORDER)), multi_fact, sql=rows(joined, *[(q, P["from"], s_order) for q in (q_name, quote(s_cust, P["in"], iri(f"{EX}nation/", "c_nationkey")), quote(s_cust, *cls("Customer")))]))
add("quoted_object_join", tm("o", "orders", ORDER, (p("sees"), quoted("a", ("o_custkey", "c_custkey")))), name_fact, sql=rows(joined, (s_order, P["sees"], q_name)))
view_fact = tm("v", "lineitem_view", template(f"{EX}part/{{pk}}"), (p("from"), template(f"{EX}supplier/{{sk}}")), asserted=False)
add("quoted_join_composite", tm("l", "lineitem", LINE, (p("sees"), quoted("v", ("l_orderkey", "ok"), ("l_partkey", "pk")))), view_fact, sql=rows("lineitem JOIN (SELECT DISTINCT l_orderkey AS ok, l_partkey AS pk, l_suppkey AS sk FROM lineitem) ON l_orderkey = ok AND l_partkey = pk", (s_line, P["sees"], quote(iri(f"{EX}part/", "pk"), P["from"], iri(f"{EX}supplier/", "sk")))))
nation_fact = tm("n", "nation", NATION, (p("name"), reference("n_name")), asserted=False)
add("quoted_join_both_sides", tm("c", "customer", quoted("n", ("c_nationkey", "n_nationkey")), (p("home"), quoted("x", ("c_custkey", "o_custkey")))), nation_fact, tm("x", "orders", ORDER, (p("is"), reference("o_orderstatus")), asserted=False), sql=rows("customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey", (quote(s_nation, P["name"], lit("n_name")), P["home"], q_state)))
add("quoted_nested_join", tm("o", "orders", quoted("b", ("o_custkey", "c_custkey")), (p("from"), ORDER)), tm("b", "customer", quoted("n", ("c_nationkey", "n_nationkey")), (p("home"), CUST), asserted=False), nation_fact, sql=rows("orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey", (quote(quote(s_nation, P["name"], lit("n_name")), P["home"], s_cust), P["from"], s_order)))
add("quoted_subject_parent_object", tm("o", "nation", quoted("n2"), (p("of"), parent("r", ("n_regionkey", "r_regionkey"))), (p("note"), constant("ok"))), tm("n2", "nation", NATION, (p("name"), reference("n_name")), asserted=False), region_map, sql=rows("nation", (quote(s_nation, P["name"], lit("n_name")), P["note"], "'\"ok\"'")))
add("non_asserted_hidden", tm("s", "supplier", template(f"{EX}supplier/{{s_suppkey}}"), (p("name"), reference("s_name"))), tm("h", "supplier", template(f"{EX}hidden/{{s_suppkey}}"), (p("name"), reference("s_name")), asserted=False), sql=rows("supplier", (iri(f"{EX}supplier/", "s_suppkey"), P["name"], lit("s_name"))))
add("statement_equivalence", tm("full", "customer", CUST, (p("name"), reference("c_name")), (p("in"), template(f"{EX}nation/{{c_nationkey}}"))), name_fact, tm("o", "orders", quoted("a", ("o_custkey", "c_custkey")), (p("from"), ORDER)), sql=" UNION ".join([rows("customer", (s_cust, P["name"], lit("c_name")), (s_cust, P["in"], iri(f"{EX}nation/", "c_nationkey"))), rows(joined, (q_name, P["from"], s_order))]))

flagship = tm("o", "orders", quoted("a", ("o_custkey", "c_custkey")), (p("from"), ORDER)), multi_fact, tm("n", "nation", NATION, (p("name"), reference("n_name")), classes=(p("Nation"),))


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


@query(f"SELECT DISTINCT {s_order} || ' ' || {P['by']} || ' ' || {iri(EX + 'customer/', 'o_custkey')} || ' <{EX}g>.' AS value FROM orders UNION SELECT DISTINCT {s_order} || ' ' || {cls('Order')[0]} || ' ' || {cls('Order')[1]} || ' <{EX}g> .' FROM orders")
def nquads_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.to_lines(Compiler(Mapping((tm("o", "orders", ORDER, (p("by"), template(f"{EX}customer/{{o_custkey}}")), classes=(p("Order"),), graphs=(p("g"),)),)), read_tables(spark, sf_dir)).graph_of())


@query("SELECT DISTINCT event_type, user_id FROM events")
def row_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_type", "user_id").distinct()


@query("SELECT n_nationkey, CASE WHEN n_nationkey < 10 THEN chr(48 + n_nationkey) ELSE chr(55 + n_nationkey) END AS id FROM nation")
def base36_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", terms.base36(F.col("n_nationkey")).alias("id"))


@query("""SELECT n_nationkey, n_name || '_' || n_regionkey AS key, CAST(n_nationkey = n_regionkey AS INT) + 1 AS same,
    CASE WHEN n_nationkey % 3 = 0 THEN 'http://x/' || n_name || ' (1)' ELSE regexp_replace(n_name, '[^A-Za-z0-9_()-]', '', 'g') || '-b-c(1)' END AS cleaned,
    CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE 'a' END AS stem, n_nationkey || '/' || n_name AS whole, 'n_name_n_nationkey' AS key_name, n_nationkey % 2 = 0 AS held, 3 AS braces FROM nation""")
def helper_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    same = terms.equal_fields({"a": F.col("n_nationkey"), "b": F.col("n_name")}, {"a": F.col("n_regionkey"), "b": F.col("n_name")})
    third = F.col("n_nationkey") % 3 == 0
    address = F.when(third, F.concat(F.lit("http://x/"), "n_name", F.lit(" (1)"))).otherwise(F.concat("n_name", F.lit("/b\\c (1)!")))
    path = F.when(third, F.concat(F.lit("/data/"), "n_name", F.lit(".tar.csv"))).otherwise(F.concat(F.lit("/d.x/a."), "n_name"))
    row = terms.row_map(["n_nationkey", "n_name"])
    held = F.when(F.col("n_nationkey") % 2 == 0, terms.has_columns(["n_name"], n.columns)).otherwise(terms.has_columns(["n_name", "other"], n.columns))
    return n.select(
        "n_nationkey", terms.composite_key(F.col("n_name"), F.col("n_regionkey").cast("string")).alias("key"), same.alias("same"), terms.clean_suffix(address).alias("cleaned"), terms.file_stem(path).alias("stem"),
        F.concat(row["n_nationkey"], F.lit("/"), row["n_name"]).alias("whole"), F.lit(terms.key_name(["n_name", "name", "n_nationkey", "n_nat"])).alias("key_name"), held.alias("held"), F.lit(terms.brace_count("{a}-{b}\\{c\\}")).alias("braces"),
    )


def flagship_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Compiler(Mapping(flagship), read_tables(spark, sf_dir)).graph_of()
