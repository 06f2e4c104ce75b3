"""Registered queries over namespaces, documents and the rules by which RDF is read, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.catalog import PROV, XSD
from ..operators import names, triples
from ..operators import records as R
from . import lift
from .queries import iso, query

# namespaces

_HOST = "regexp_extract(url, '://([^/?#]*)', 1)"
_ZONE, _LABEL = "regexp_extract({0}, '([a-z]*)$', 1)", "'h' || regexp_replace(regexp_extract({0}, '^([^.]*)', 1), '[^A-Za-z0-9]', '')"
_LABEL_SQL = _LABEL[:-1] + ", 'g')"


@query(f"""
WITH h AS (SELECT page_id, lower({_HOST}) AS host FROM pages WHERE url IS NOT NULL),
last AS (SELECT {_ZONE.format("host")} AS doc, max(page_id) + 1 AS n FROM h GROUP BY 1),
declared AS (
  SELECT {_ZONE.format("host")} AS doc, page_id AS seq, {_LABEL_SQL.format("host")} AS prefix, 'http://' || host || '/' AS uri FROM h
  UNION ALL SELECT {_ZONE.format("host")}, page_id + n, {_LABEL_SQL.format("host")}, 'https://' || host || '/' FROM h JOIN last ON last.doc = {_ZONE.format("host")}),
firsts AS (SELECT doc, uri, prefix, min(seq) AS seq FROM declared GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc, prefix ORDER BY seq, uri) - 1 AS n FROM firsts)
SELECT doc AS doc_id, CAST(seq AS BIGINT) AS seq, CASE WHEN n = 0 THEN prefix ELSE prefix || '_' || n END AS prefix, uri FROM numbered
""")
def namespace_union(spark, sf):
    """Hosts as namespaces named by their first label, then the same hosts of another scheme:
    clashing prefixes are renamed in order of registration."""
    h = lift.table(spark, sf, "pages").where("url is not null").select("page_id", F.lower(F.expr(_HOST)).alias("host"))

    def declared(scheme: str):
        return h.select(F.expr(_ZONE.format("host")).alias("doc_id"), F.lit("").alias("scope"), F.col("page_id").alias("seq"), F.expr(_LABEL.format("host")).alias("prefix"), F.concat(F.lit(scheme), "host", F.lit("/")).alias("uri"))

    spaces, _ = names.union(declared("http://"), declared("https://"))
    return spaces.select("doc_id", "seq", "prefix", "uri")


@query(f"""
SELECT 'nation' || c_nationkey AS doc_id, 'agent(at:' || c_custkey || ', [ex:in=''at:' || c_nationkey || '''])' AS text FROM customer
UNION ALL SELECT 'nation' || s_nationkey, 'agent(at_1:' || s_suppkey || ', [ex:in=''at:' || s_nationkey || '''])' FROM supplier
""")
def combined_names(spark, sf):
    """Documents of customers updated with documents of suppliers, which use one prefix for another namespace."""
    from ..operators import render

    def agents(table, key, nation, space):
        t = lift.table(spark, sf, table)
        doc = F.concat(F.lit("nation"), F.col(nation).cast("string"))
        here = V.name("at", f"{lift.BASE}{space}/", F.col(key).cast("string"))
        other = V.name("at" if space == "cust" else "other", f"{lift.BASE}cust/", F.col(nation).cast("string"))
        return R.agent(t, F.col(key), here, doc=doc, attrs=[(lift.ex("in"), V.v_qname(other))]), t.select(doc.alias("doc_id")).distinct()

    def spaces(docs, pairs):
        return docs.select("doc_id", F.lit("").alias("scope"), F.inline(F.array(*[F.struct(F.lit(i).cast("long").alias("seq"), F.lit(p).alias("prefix"), F.lit(u).alias("uri")) for i, (p, u) in enumerate(pairs)])))

    one, docs = agents("customer", "c_custkey", "c_nationkey", "cust")
    two, docs2 = agents("supplier", "s_suppkey", "s_nationkey", "supp")
    # each nation has both documents, so that the first one's prefixes are taken
    every = docs.unionByName(docs2).distinct()
    records, _ = names.combine(one, spaces(every, [("at", f"{lift.BASE}cust/"), ("ex", f"{lift.BASE}ex/")]), two, spaces(docs2, [("at", f"{lift.BASE}supp/"), ("ex", f"{lift.BASE}ex/"), ("other", f"{lift.BASE}cust/")]))
    return records.select("doc_id", render.record_text(records).alias("text"))


# RDF


def _quads(df, *rows):
    """Quads (s, p, o) of each row of df, o a term."""
    made = F.array(*[F.struct(s.cast(triples.TERM).alias("s"), F.lit(p).alias("p"), o.cast(triples.TERM).alias("o")) for s, p, o in rows])
    return df.select(F.lit("doc").alias("doc_id"), F.lit(None).cast("string").alias("graph"), F.inline(made))


def _iri(prefix, key):
    return triples.iri(F.concat(F.lit(f"{lift.BASE}{prefix}/"), F.col(key).cast("string") if isinstance(key, str) else key))


_TYPE = triples.RDF + "type"


@query(f"""
WITH l AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s, l_partkey AS p FROM lineitem),
nodes AS (SELECT o, s, p, 'known' AS told FROM l WHERE p % 2 = 0),
open AS (SELECT o, max('{lift.BASE}node/' || o || '-' || s || '-' || p) AS node FROM l WHERE p % 2 = 1 GROUP BY o),
binary_ AS (SELECT DISTINCT o, s FROM l WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.o = l.o AND n.s = l.s))
SELECT '{lift.BASE}node/' || o || '-' || s || '-' || p AS id, '{lift.BASE}order/' || o AS activity, '{lift.BASE}supp/' || s AS agent FROM nodes
UNION ALL SELECT '{lift.BASE}node/' || l.o || '-' || l.s || '-' || l.p, '{lift.BASE}order/' || l.o, '{lift.BASE}supp/' || b.s
  FROM l LEFT JOIN open ON open.node = '{lift.BASE}node/' || l.o || '-' || l.s || '-' || l.p LEFT JOIN binary_ b ON b.o = l.o AND open.node IS NOT NULL WHERE p % 2 = 1
UNION ALL SELECT NULL, '{lift.BASE}order/' || b.o, '{lift.BASE}supp/' || b.s FROM binary_ b WHERE b.o NOT IN (SELECT o FROM open)
""")
def qualified_preference(spark, sf):
    """Lines as associations of their order with suppliers, told by binary properties and by a
    node each; the nodes of odd parts don't name their agent."""
    l = lift.table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey").distinct()
    node = _iri("node", F.concat_ws("-", "l_orderkey", "l_suppkey", "l_partkey"))
    order, supplier = _iri("order", "l_orderkey"), _iri("supp", "l_suppkey")
    every = _quads(l, (order, PROV + "wasAssociatedWith", supplier), (order, PROV + "qualifiedAssociation", node), (node, _TYPE, triples.iri(F.lit(PROV + "Association"))))
    named = _quads(l.where("l_partkey % 2 = 0"), (node, PROV + "agent", supplier))
    out = triples.from_quads(every.unionByName(named).distinct())
    return out.select(F.col("id.uri").alias("id"), F.col("arg1.uri").alias("activity"), F.col("arg2.uri").alias("agent"))


def _shipments(spark, sf):
    """Each order as the generation of its papers, at the dates of its lines."""
    t = lift.table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", V.time_of(F.col("l_shipdate"))["lex"].alias("t"))
    node = _iri("order", "l_orderkey")
    rows = [(_iri("papers", "l_orderkey"), PROV + "qualifiedGeneration", node), (node, _TYPE, triples.iri(F.lit(PROV + "Generation"))), (node, PROV + "atTime", triples.literal(F.col("t"), F.lit(XSD + "dateTime")))]
    return _quads(t, *rows)


_SHIPPED = f"SELECT l_orderkey, count(DISTINCT {iso('l_shipdate')}) AS n, min({iso('l_shipdate')}) AS t FROM lineitem GROUP BY 1"


@query(f"SELECT '{lift.BASE}order/' || l_orderkey AS id, 'Generation' AS rtype, 'time' AS formal, n FROM ({_SHIPPED}) WHERE n > 1")
def rdf_conflicts(spark, sf):
    """Orders whose lines were sent at several times: a node has one time."""
    return triples.conflicts(_shipments(spark, sf)).select("id", "rtype", "formal", "n")


@query(f"SELECT '{lift.BASE}order/' || l_orderkey AS id, t FROM ({_SHIPPED}) WHERE n = 1")
def rdf_single_times(spark, sf):
    """The others are read as generations."""
    out = triples.from_quads(_shipments(spark, sf)).where("rtype = 'Generation'")
    return out.select(F.col("id.uri").alias("id"), F.col("t1.lex").alias("t"))


_FORMS = "CASE event_id % 9 WHEN 0 THEN '2020Z' WHEN 1 THEN '0' || (100 + user_id % 800) WHEN 2 THEN '-0044' WHEN 3 THEN '20' WHEN 4 THEN '2020-0' || (1 + user_id % 9) || '+01:00' WHEN 5 THEN '2020-3' WHEN 6 THEN 'aGVs bG8=' WHEN 7 THEN 'a' ELSE 'x' || user_id END"
_FORM_TYPES = "CASE WHEN event_id % 9 < 4 THEN 'gYear' WHEN event_id % 9 < 6 THEN 'gYearMonth' WHEN event_id % 9 < 8 THEN 'base64Binary' ELSE 'int' END"


@query(f"""
SELECT event_id AS k, '{XSD}' || {_FORM_TYPES} AS datatype,
  CASE event_id % 9 WHEN 0 THEN '2020' WHEN 1 THEN CAST(100 + user_id % 800 AS VARCHAR) WHEN 2 THEN '-44' WHEN 3 THEN '20' WHEN 4 THEN '2020-0' || (1 + user_id % 9) WHEN 5 THEN '2020-3' WHEN 6 THEN 'aGVsbG8=' WHEN 7 THEN 'a' ELSE 'x' || user_id END AS lex,
  CASE event_id % 9 WHEN 3 THEN 'no year' WHEN 5 THEN 'no year and month' WHEN 7 THEN 'no base64' WHEN 8 THEN 'no whole number' END AS detail
FROM events
""")
def lexical_forms(spark, sf):
    """Years, months, packed bytes and numbers, good and bad ones, as they are kept."""
    t = lift.table(spark, sf, "events").select("event_id", F.expr(_FORMS).alias("given"), F.concat(F.lit(XSD), F.expr(_FORM_TYPES)).alias("datatype"))
    return t.select(F.col("event_id").alias("k"), "datatype", triples.plain_form(F.col("given"), F.col("datatype")).alias("lex"), triples.lexical_error(F.col("given"), F.col("datatype")).alias("detail"))


@query(f"""
SELECT 'Generation' AS rtype, '{lift.BASE}line/' || l_orderkey || '-' || l_linenumber AS arg1, '{lift.BASE}order/' || l_orderkey AS arg2 FROM lineitem
UNION ALL SELECT 'Attribution', '{lift.BASE}line/' || l_orderkey || '-' || l_linenumber, '{lift.BASE}supp/' || l_suppkey FROM lineitem
""")
def own_properties(spark, sf):
    """Properties of another vocabulary, read as relations by a table that names their kinds."""
    t = lift.table(spark, sf, "lineitem")
    line = _iri("line", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    q = _quads(t, (line, lift.BASE + "ex/partOf", _iri("order", "l_orderkey")), (line, lift.BASE + "ex/from", _iri("supp", "l_suppkey")))
    kinds = spark.createDataFrame([(lift.BASE + "ex/partOf", "Generation"), (lift.BASE + "ex/from", "Attribution")], "p string, kind string")
    return triples.from_quads(q, relation_map=kinds).select("rtype", F.col("arg1.uri").alias("arg1"), F.col("arg2.uri").alias("arg2"))


# whole documents


def _nation_documents(spark, sf):
    """A document for each nation: its customers as agents on its behalf, and its suppliers in a bundle."""
    c, s = lift.table(spark, sf, "customer"), lift.table(spark, sf, "supplier")
    doc = lambda key: F.concat(F.lit("nation"), F.col(key).cast("string"))
    stock = F.concat(F.lit(f"{lift.BASE}stock/"), F.col("s_nationkey").cast("string"))
    records = R.agent(c, F.col("c_custkey"), lift.name("cust", "c_custkey"), doc=doc("c_nationkey"))
    records = records.unionByName(R.delegation(c, F.col("c_custkey"), lift.name("cust", "c_custkey"), lift.name("nation", "c_nationkey"), doc=doc("c_nationkey")))
    records = records.unionByName(R.agent(s, F.col("s_suppkey"), lift.name("supp", "s_suppkey"), doc=doc("s_nationkey"), scope=stock))
    docs = lift.table(spark, sf, "nation").select(doc("n_nationkey").alias("doc_id"))
    pairs = [(p, f"{lift.BASE}{p}/") for p in ("cust", "nation", "stock", "supp", "ex")]
    spaces = docs.select("doc_id", F.lit("").alias("scope"), F.inline(F.array(*[F.struct(F.lit(i).cast("long").alias("seq"), F.lit(p).alias("prefix"), F.lit(u).alias("uri")) for i, (p, u) in enumerate(pairs)])))
    return records, spaces


_DRAWN = f"""
WITH a AS (SELECT c_nationkey AS k, c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer),
na AS (SELECT k, count(*) AS c FROM a GROUP BY k),
s AS (SELECT s_nationkey AS k, s_suppkey AS id, coalesce(c, 0) + row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier LEFT JOIN na ON na.k = s_nationkey),
ns AS (SELECT k, count(*) AS c FROM s GROUP BY k),
agents AS (SELECT k, string_agg('n' || n || ' [label="cust:' || id || '", URL="{lift.BASE}cust/' || id || '", shape=house, style=filled, fillcolor="#FED37F"];', chr(10) ORDER BY n) AS t FROM a GROUP BY k),
clusters AS (SELECT k, 'subgraph cluster_c1 {{' || chr(10) || 'URL="{lift.BASE}stock/' || k || '";' || chr(10) || 'label="stock:' || k || '";' || chr(10)
  || string_agg('n' || n || ' [label="supp:' || id || '", URL="{lift.BASE}supp/' || id || '", shape=house, style=filled, fillcolor="#FED37F"];', chr(10) ORDER BY n) || chr(10) || '}}' AS t FROM s GROUP BY k),
acts AS (SELECT a.k, string_agg('b' || n || ' [label="", shape=point, color=gray];' || chr(10)
  || CASE WHEN n = 1 THEN 'n' || (na.c + coalesce(ns.c, 0) + 1) || ' [label="nation:' || a.k || '", URL="{lift.BASE}nation/' || a.k || '", shape=house, style=filled, fillcolor=lightgray, color=dimgray];' || chr(10) ELSE '' END
  || 'n' || n || ' -> b' || n || ' [arrowhead=none, label="actedOnBehalfOf", fontsize="10.0", color="#FED37F"];' || chr(10)
  || 'b' || n || ' -> n' || (na.c + coalesce(ns.c, 0) + 1) || ' [fontsize="10.0", color="#FED37F"];', chr(10) ORDER BY n) AS t FROM a JOIN na ON na.k = a.k LEFT JOIN ns ON ns.k = a.k GROUP BY a.k)
SELECT 'nation' || k AS doc_id, 'digraph {{' || chr(10) || 'rankdir=BT;' || chr(10) || 'charset="utf-8";' || chr(10) || concat_ws(chr(10), agents.t, clusters.t, acts.t) || chr(10) || '}}' AS text
FROM (SELECT k FROM na UNION SELECT k FROM ns) LEFT JOIN agents USING (k) LEFT JOIN clusters USING (k) LEFT JOIN acts USING (k)
"""


@query(_DRAWN)
def dot_document(spark, sf):
    from ..operators import dot

    records, spaces = _nation_documents(spark, sf)
    return dot.dot_document(records, spaces)


@query(f"""
SELECT 'nation' || k AS doc_id, '{lift.BASE}' || scope || '/' || k AS scope, side FROM (
  SELECT n_nationkey AS k, 'empty' AS scope, 'right' AS side FROM nation WHERE n_nationkey % 2 = 0
  UNION ALL SELECT n_nationkey, 'stock', 'left' FROM nation WHERE n_nationkey % 3 = 0 AND n_nationkey IN (SELECT s_nationkey FROM supplier))
""")
def bundle_differences(spark, sf):
    """Two versions of each nation's document: the second lacks some bundles and has empty ones more."""
    from ..operators import setops

    records, _ = _nation_documents(spark, sf)
    n = lift.table(spark, sf, "nation")
    other = records.join(n.where("n_nationkey % 3 = 0").select(F.concat(F.lit("nation"), F.col("n_nationkey").cast("string")).alias("doc_id"), F.lit(True).alias("less")), "doc_id", "left").where("scope = '' or less is null").drop("less")
    empty = n.where("n_nationkey % 2 = 0").select(F.concat(F.lit("nation"), F.col("n_nationkey").cast("string")).alias("doc_id"), F.concat(F.lit(f"{lift.BASE}empty/"), F.col("n_nationkey").cast("string")).alias("scope"))
    return setops.bundle_differences(records, other, None, empty)


def _every_kind(spark, sf, kinds):
    """For each customer a statement of each kind, with all it can have, in its nation's document or a bundle of it."""
    from ..functions.catalog import ELEMENTS, argument_names, time_names
    from ..operators.triples import PLAIN

    t = lift.table(spark, sf, "customer")
    key, spare = F.col("c_custkey").cast("string"), F.col("c_custkey") % 2 == 0
    doc = F.concat(F.lit("nation"), F.col("c_nationkey").cast("string"))
    scope = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(f"{lift.BASE}stock/"), F.col("c_nationkey").cast("string"))).otherwise("")
    out = None
    for i, kind in enumerate(kinds):
        own = lift.ex(F.concat(F.lit(f"{kind.lower()}-"), key))
        formals = {n: lift.ex(F.concat(F.lit(f"{kind.lower()}-{n}-"), key)) for n in argument_names(kind)}
        formals |= {n: V.time_of(F.lit("1998-01-01 10:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.col("c_custkey").cast("int"))) for n in time_names(kind)}
        attrs = [] if kind in PLAIN else [(V.prov("label"), V.v_str(F.col("c_name"))), (lift.ex("balance"), V.v_float(F.col("c_acctbal"))), (lift.ex("nation"), V.v_int(F.col("c_nationkey"))), (lift.ex("like"), V.v_qname(lift.name("cust", "c_custkey")))]
        ident = own if kind in ELEMENTS else V.no_name() if kind in PLAIN else F.when(spare, own)
        one = R.record(t, kind, F.col("c_custkey") * 32 + i, doc=doc, scope=scope, id=ident, attrs=attrs, **formals)
        out = one if out is None else out.unionByName(one)
    return out


def _kinds_back(format: str, kinds):
    def run(spark, sf):
        """Statements of all kinds written, read again, and counted where an equal one is in the same bundle."""
        from ..operators import setops
        from ..operators.scratch import settle
        from ..sources.read import from_content
        from ..sources.write import serialize

        records = _every_kind(spark, sf, kinds)
        _, spaces = _nation_documents(spark, sf)
        texts = settle(serialize(records, format, spaces), "texts")
        back = from_content(texts, "rdf" if format == "trig" else format)
        key = lambda df: df.select("doc_id", "scope", "rtype", setops.record_key(df).alias("k"))
        same = key(back).join(key(records).distinct(), ["doc_id", "scope", "rtype", "k"], "left_semi")
        return same.groupBy("rtype", (F.col("scope") != "").alias("in_bundle")).agg(F.count("*").alias("n"))

    return run


def _register_kinds() -> None:
    from ..functions.catalog import KINDS

    for format in ("json", "jsonld", "xml", "rdf", "trig"):
        # a mention has no form in JSON-LD
        kinds = [k for k in KINDS if format != "jsonld" or k != "Mention"]
        values = ", ".join(f"('{k}')" for k in kinds)
        query(f"SELECT rtype, c_custkey % 3 = 0 AS in_bundle, count(*) AS n FROM customer, (VALUES {values}) v(rtype) GROUP BY ALL", f"{format}_kinds_roundtrip")(_kinds_back(format, kinds))


_register_kinds()


@query("SELECT 'nation' || c_nationkey AS doc_id, rtype, count(*) AS n FROM customer, (VALUES ('Agent'), ('Delegation')) v(rtype) GROUP BY ALL UNION ALL SELECT 'nation' || s_nationkey, 'Supplier', count(*) FROM supplier GROUP BY ALL")
def format_source(spark, sf):
    """Each nation's document as a file, written and read through the data source."""
    import uuid

    from ..operators.scratch import shared_dir
    from ..sources import formats, write

    formats.register(spark)
    records, spaces = _nation_documents(spark, sf)
    path = f"{shared_dir(spark)}/nations-{uuid.uuid4().hex}"
    write.serialize(records, "json", spaces).write.format("provenance").option("notation", "json").mode("append").save(path)
    back = formats.records(spark.read.format("provenance").option("notation", "json").load(path))
    kind = F.when(F.col("scope") != "", "Supplier").otherwise(F.col("rtype"))
    return back.groupBy("doc_id", kind.alias("rtype")).agg(F.count("*").alias("n"))


def _flat_events(spark, sf):
    """Events as flat rows of a document for each type: an activity with times that are none,
    attributes of unknown prefixes and bad numbers; usages of two things."""
    t = lift.table(spark, sf, "events")
    k = F.col("event_id")
    key = k.cast("string")
    cell = lambda x: (F.lit(x) if x is None or isinstance(x, (str, int)) else x)

    def row(when, what, rtype, seq, pos, id=None, attr=None, form=None, lex=None, datatype=None):
        cells = {"what": what, "rtype": rtype, "seq": seq.cast("long"), "id": id, "attr": attr, "pos": pos, "form": form, "lex": lex, "datatype": datatype}
        types = {"seq": "long", "pos": "long"}
        return F.when(when, F.struct(*[cell(v).cast(types.get(c, "string")).alias(c) for c, v in cells.items()]))

    every = F.lit(True)
    event, usage = k * 2, k * 2 + 1
    made = F.array(
        row(every, "statement", "Activity", event, 0, id=F.concat(F.lit("ex:e"), key)),
        row(every, "attribute", "Activity", event, 1, id=F.concat(F.lit("ex:e"), key), attr="prov:startTime", form="str", lex=F.when(k % 4 == 0, F.lit("yesterday")).otherwise("2020-01-01T00:00:00")),
        row(k % 5 == 0, "attribute", "Activity", event, 2, id=F.concat(F.lit("ex:e"), key), attr=F.concat(F.lit("zz:k"), F.col("user_id").cast("string")), form="str", lex="v"),
        row(k % 7 < 2, "attribute", "Activity", event, 3, id=F.concat(F.lit("ex:e"), key), attr="ex:n", form="typed", lex=F.when(k % 7 == 0, F.concat(F.lit("x"), key)).otherwise(key), datatype="xsd:int"),
        row(every, "statement", "Usage", usage, 0),
        row(every, "attribute", "Usage", usage, 1, attr="prov:activity", form="str", lex=F.concat(F.lit("ex:e"), key)),
        row(every, "attribute", "Usage", usage, 2, attr="prov:entity", form="str", lex="ex:thing"),
        row(k % 3 == 0, "attribute", "Usage", usage, 3, attr="prov:entity", form="str", lex=F.concat(F.lit("ex:u"), F.col("user_id").cast("string"))),
    )
    rows = t.select(F.col("event_type").alias("doc_id"), F.lit("").alias("scope"), F.inline(F.array_compact(made)))
    spaces = t.select(F.col("event_type").alias("doc_id")).distinct().select("doc_id", F.lit("").alias("scope"), F.lit("binding").alias("what"), F.lit("ex").alias("attr"), F.lit(0).cast("long").alias("pos"), F.lit(f"{lift.BASE}ex/").alias("lex"))
    return rows.unionByName(spaces, allowMissingColumns=True).withColumn("lang", F.lit(None).cast("string"))


@query("""
SELECT event_type AS doc_id, CAST(event_id * 2 AS BIGINT) AS seq, 'time' AS kind, 'yesterday' AS detail FROM events WHERE event_id % 4 = 0
UNION ALL SELECT event_type, event_id * 2, 'name', 'zz:k' || user_id FROM events WHERE event_id % 5 = 0
UNION ALL SELECT event_type, event_id * 2, 'value', 'x' || event_id FROM events WHERE event_id % 7 = 0
UNION ALL SELECT event_type, event_id * 2 + 1, 'repeated', 'entity' FROM events WHERE event_id % 3 = 0
""")
def statement_violations(spark, sf):
    """Bad times, unknown names, bad numbers and repeated formal attributes, by document and place."""
    from ..sources import statements

    return statements.violations(_flat_events(spark, sf)).select("doc_id", "seq", "kind", "detail")


@query(f"""
SELECT CAST(o_orderkey AS BIGINT) AS seq, 'repeated' AS kind, 'agent' AS detail FROM orders WHERE o_custkey % 5 <> o_orderkey % 5
""")
def repeated_formals(spark, sf):
    """Attributions that got their agent as an attribute once more, the same or another one."""
    t = lift.table(spark, sf, "orders")
    one = R.attribution(t, F.col("o_orderkey"), lift.name("order", "o_orderkey"), lift.ex((F.col("o_custkey") % 5).cast("string")))
    own = t.select(F.col("o_orderkey").cast("long").alias("seq"), (F.col("o_orderkey") % 5).cast("string").alias("other"))
    joined = one.join(own, "seq")
    more = R.add_attributes(joined, (V.prov("agent"), V.v_qname(lift.ex(F.col("other")))))
    return R.repeated_formals(more).select("seq", "kind", "detail")


@query(f"SELECT k, base FROM (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'Plan' WHEN 1 THEN 'Person' WHEN 2 THEN 'Revision' ELSE p_type END AS kind FROM part), LATERAL (SELECT CASE kind WHEN 'Plan' THEN 'Entity' WHEN 'Person' THEN 'Agent' WHEN 'Revision' THEN 'Derivation' END AS base)")
def base_type_of_parts(spark, sf):
    """Kinds of parts by the subtype that they are told as; null for what is none."""
    kind = F.when(F.col("p_partkey") % 4 == 0, "Plan").when(F.col("p_partkey") % 4 == 1, "Person").when(F.col("p_partkey") % 4 == 2, "Revision").otherwise(F.col("p_type"))
    return lift.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), V.base_kind(kind).alias("base"))
