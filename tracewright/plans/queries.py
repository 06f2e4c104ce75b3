"""Registered queries over the driver's tables, with the same results in DuckDB SQL.

Every query returns plain columns. SQL is written from the tables on, not from the plans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.catalog import PROV
from ..operators import graph, select, setops, unify
from ..operators import records as R
from . import lift

QUERIES: dict = {}
SQL: dict[str, str] = {}

BASE = lift.BASE


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return add


def uri(prefix: str, key: str) -> str:
    return f"('{BASE}{prefix}/' || ({key}))"


def iso(ts: str) -> str:
    return f"regexp_replace(strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f'), '\\.000000$', '')"


def flat_sql(rtype: str, source: str, seq: str, id: str | None = None, args: tuple = (), times: tuple = (), attrs: str = "0", scope: str = "''", where: str = "true") -> str:
    null = "CAST(NULL AS VARCHAR)"
    cells = [f"'doc' AS doc_id", f"{scope} AS scope", f"CAST({seq} AS BIGINT) AS seq", f"'{rtype}' AS rtype", f"{id or null} AS id"]
    cells += [f"{args[i] if i < len(args) and args[i] else null} AS arg{i + 1}" for i in range(5)]
    cells += [f"{times[i] if i < len(times) and times[i] else null} AS t{i + 1}" for i in range(2)]
    return f"SELECT {', '.join(cells)}, CAST({attrs} AS BIGINT) AS n_attrs FROM {source} WHERE {where}"


LINE = uri("line", "l_orderkey || '-' || l_linenumber")
LINE_SEQ = "l_orderkey * 8 + l_linenumber"
ORDER_OF_LINE, PART_OF_LINE = uri("order", "l_orderkey"), uri("part", "l_partkey")

LIFTS = {
    "entity": flat_sql("Entity", "part", "p_partkey", uri("part", "p_partkey"), attrs="3"),
    "activity": flat_sql("Activity", "orders", "o_orderkey", uri("order", "o_orderkey"), times=(iso("o_orderdate"),), attrs="2"),
    "agent": flat_sql("Agent", "customer", "c_custkey", uri("cust", "c_custkey"), attrs="2"),
    "generation": flat_sql("Generation", "lineitem", LINE_SEQ, args=(LINE, ORDER_OF_LINE), times=(iso("l_shipdate"),)),
    "usage": flat_sql("Usage", "lineitem", LINE_SEQ, args=(ORDER_OF_LINE, PART_OF_LINE), attrs="1"),
    "start": flat_sql("Start", "events", "event_id", args=(uri("user", "user_id"), uri("event", "event_id")), times=(iso("ts"),)),
    "end": flat_sql("End", "events", "event_id", args=(uri("user", "user_id"), uri("event", "event_id"), uri("type", "event_type")), times=(iso("ts"),)),
    "invalidation": flat_sql("Invalidation", "lineitem", LINE_SEQ, args=(LINE, ORDER_OF_LINE), times=(iso("l_shipdate"),), where="l_returnflag = 'R'"),
    "communication": flat_sql("Communication", "(SELECT DISTINCT conv_id, turn FROM conversations) a SEMI JOIN conversations b ON b.conv_id = a.conv_id AND b.turn + 1 = a.turn", "a.conv_id * 1000 + a.turn", args=(uri("turn", "a.conv_id || '-' || a.turn"), uri("turn", "a.conv_id || '-' || (a.turn - 1)"))),
    "attribution": flat_sql("Attribution", "lineitem", LINE_SEQ, args=(LINE, uri("supp", "l_suppkey"))),
    "association": flat_sql("Association", "orders", "o_orderkey", args=(uri("order", "o_orderkey"), uri("cust", "o_custkey"), uri("plan", "substr(o_orderpriority, 1, 1)"))),
    "delegation": flat_sql("Delegation", "customer", "c_custkey", args=(uri("cust", "c_custkey"), uri("nation", "c_nationkey"))),
    "influence": flat_sql("Influence", "supplier", "s_suppkey", args=(uri("supp", "s_suppkey"), uri("nation", "s_nationkey"))),
    "derivation": flat_sql("Derivation", "lineitem", LINE_SEQ, args=(LINE, PART_OF_LINE, ORDER_OF_LINE)),
    "specialization": flat_sql("Specialization", "lineitem", LINE_SEQ, args=(LINE, PART_OF_LINE)),
    "alternate": flat_sql("Alternate", "(SELECT l_orderkey, l_linenumber, lead(l_linenumber) OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber) AS after FROM lineitem)", LINE_SEQ, args=(LINE, uri("line", "l_orderkey || '-' || after")), where="after IS NOT NULL"),
    "mention": flat_sql("Mention", "documents", "doc_id", args=(uri("doc", "doc_id"), uri("text", "doc_id"), uri("source", "source")), where="source IS NOT NULL"),
    "collection": flat_sql("Entity", "(SELECT p_brand, min(p_partkey) AS k FROM part GROUP BY p_brand)", "k", uri("brand", "replace(p_brand, '#', '_')"), attrs="1"),
    "membership": flat_sql("Membership", "part", "p_partkey", args=(uri("brand", "replace(p_brand, '#', '_')"), uri("part", "p_partkey"))),
}

for _kind in LIFTS:
    query(LIFTS[_kind], f"lift_{_kind}")(lambda spark, sf, k=_kind: select.flat(lift.KINDS[k](spark, sf)))

for _subtype, _make in (("revision", R.revision), ("quotation", R.quotation), ("primary_source", R.primary_source)):
    _name = "".join(p.capitalize() for p in _subtype.split("_"))
    query(
        f"SELECT CAST({LINE_SEQ} AS BIGINT) AS seq, {LINE} AS arg1, {PART_OF_LINE} AS arg2, '{PROV}{_name}' AS type FROM lineitem",
        f"subtype_{_subtype}",
    )(lambda spark, sf, make=_make: lift.derivations(spark, sf, make=make).select("seq", F.col("arg1.uri").alias("arg1"), F.col("arg2.uri").alias("arg2"), select.attribute_values(F.col("attrs"), PROV + "type")[0]["cmp"].alias("type")))


def twice_asserted(spark: SparkSession, sf: str) -> DataFrame:
    """Orders asserted as activities by their own table (start) and by their lines (end)."""
    return lift.activities_started(spark, sf).unionByName(lift.activities_ended(spark, sf))


@query(f"""
WITH ended AS (SELECT l_orderkey, max(l_shipdate) AS last, count(*) AS n FROM lineitem GROUP BY 1)
SELECT {uri("order", "coalesce(o_orderkey, l_orderkey)")} AS id, {iso("o_orderdate")} AS start_time, {iso("last")} AS end_time,
       CAST((o_orderkey IS NOT NULL)::INT * 2 + (l_orderkey IS NOT NULL)::INT AS BIGINT) AS n_attrs
FROM orders FULL JOIN ended ON o_orderkey = l_orderkey
""")
def unify_activities(spark, sf):
    out = unify.unify(twice_asserted(spark, sf))
    return out.select(F.col("id.uri").alias("id"), F.col("t1.lex").alias("start_time"), F.col("t2.lex").alias("end_time"), F.size("attrs").cast("long").alias("n_attrs"))


_SEGMENTS = f"(SELECT '{BASE}segment/' || c_mktsegment AS scope, o_custkey, o_orderkey, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey)"


@query(f"""
SELECT scope, {uri("cust", "o_custkey")} AS id, CAST(min(o_orderkey) AS BIGINT) AS seq, {iso("arg_min(o_orderdate, o_orderkey)")} AS start_time, count(DISTINCT o_orderkey) AS n_attrs
FROM {_SEGMENTS} GROUP BY scope, o_custkey
""")
def unify_per_bundle(spark, sf):
    """Orders of a customer merged in each bundle; the start time is the first one's."""
    out = unify.unify(lift.region_scope(spark, sf))
    return out.select("scope", F.col("id.uri").alias("id"), "seq", F.col("t1.lex").alias("start_time"), F.size("attrs").cast("long").alias("n_attrs"))


@query(f"""
WITH two AS (SELECT o_custkey, o_orderdate, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT {uri("cust", "o_custkey")} AS id, count(DISTINCT o_orderkey) AS n_attrs, CAST(count(DISTINCT o_orderdate) > 1 AS INT) AS conflict FROM two GROUP BY o_custkey
""")
def flatten_then_unify(spark, sf):
    flat = setops.flatten(lift.region_scope(spark, sf))
    bad = unify.conflicts(flat).select("id", F.lit(1).alias("conflict"))
    out = unify.unify(flat).select(F.col("id.uri").alias("id"), F.size("attrs").cast("long").alias("n_attrs"))
    return out.join(bad, "id", "left").fillna(0, ["conflict"])


@query(f"""
SELECT scope, {uri("cust", "o_custkey")} AS id, 'Activity' AS rtype, 'startTime' AS attribute
FROM {_SEGMENTS} GROUP BY scope, o_custkey HAVING count(DISTINCT o_orderdate) > 1
""")
def unify_conflicts(spark, sf):
    return unify.conflicts(lift.region_scope(spark, sf)).drop("doc_id")


def _shared_ids(spark, sf):
    """Order keys as activities, part keys as entities and supplier keys as agents, under one identifier for equal keys."""
    t = lift.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    one = R.activity(t, F.col("k"), lift.name("key", "k"))
    two = R.entity(lift.table(spark, sf, "part").select(F.col("p_partkey").alias("k")), F.col("k"), lift.name("key", "k"))
    three = R.agent(lift.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k")), F.col("k"), lift.name("key", "k"))
    rel = lift.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    four = R.influence(rel, F.col("k"), lift.name("cust", "k"), lift.name("nation", "k"), id=lift.name("key", "k"))
    return one.unionByName(two).unionByName(three).unionByName(four)


@query(f"""
WITH k AS (
  SELECT o_orderkey AS k, 'Activity' AS t FROM orders UNION SELECT p_partkey, 'Entity' FROM part UNION SELECT s_suppkey, 'Agent' FROM supplier
  UNION SELECT c_custkey, 'Influence' FROM customer),
g AS (SELECT k, list_sort(list(DISTINCT t)) AS ts FROM k GROUP BY k)
SELECT {uri("key", "k")} AS id, array_to_string(ts, ',') AS kinds FROM g
WHERE (list_contains(ts, 'Activity') AND list_contains(ts, 'Entity')) OR (list_contains(ts, 'Influence') AND len(ts) > 1)
""")
def type_incompatibility(spark, sf):
    return unify.type_incompatibilities(_shared_ids(spark, sf)).select("id", "kinds")


@query(f"""
WITH k AS (
  SELECT o_orderkey AS k, 'Activity' AS t FROM orders UNION SELECT p_partkey, 'Entity' FROM part UNION SELECT s_suppkey, 'Agent' FROM supplier
  UNION SELECT c_custkey, 'Influence' FROM customer),
g AS (SELECT k, list_sort(list(DISTINCT t)) AS ts FROM k GROUP BY k)
SELECT {uri("key", "k")} AS id, array_to_string(ts, ',') AS kinds FROM g
WHERE (list_contains(ts, 'Activity') AND list_contains(ts, 'Entity')) OR (list_contains(ts, 'Influence') AND len(ts) > 1)
""")
def type_incompatibility_whole(spark, sf):
    """The same, under the name that it had beside a sampled one."""
    return type_incompatibility(spark, sf)


def _part_facts(spark, sf):
    """Brand, size and type facts of parts, asserted on one entity for each brand."""
    t = lift.table(spark, sf, "part")
    return R.entity(t, F.col("p_partkey"), lift.name("brand", F.translate("p_brand", "#", "_")), attrs=[(lift.ex("type"), V.v_str(F.col("p_type"))), (lift.ex("size"), V.v_int(F.col("p_size"))), (lift.ex("size"), V.v_str(F.col("p_size").cast("string")))])


_FACTS = """(SELECT p_brand, p_partkey AS seq, 0 AS pos, 'type' AS name, 'str' AS kind, p_type AS lex FROM part
 UNION ALL SELECT p_brand, p_partkey, 1, 'size', 'int', CAST(p_size AS VARCHAR) FROM part
 UNION ALL SELECT p_brand, p_partkey, 2, 'size', 'str', CAST(p_size AS VARCHAR) FROM part)"""


@query(f"""
WITH f AS (SELECT *, row_number() OVER (PARTITION BY p_brand, name, kind, lex ORDER BY seq, pos) AS rn FROM {_FACTS})
SELECT {uri("brand", "replace(p_brand, '#', '_')")} AS id, row_number() OVER (PARTITION BY p_brand ORDER BY seq, pos) - 1 AS position, name, kind, lex FROM f WHERE rn = 1
""")
def extras_union_first_wins(spark, sf):
    out = select.extra_attributes(unify.unify(_part_facts(spark, sf)))
    return out.select(F.col("id.uri").alias("id"), F.col("position").cast("long").alias("position"), F.col("name.local").alias("name"), F.col("value.kind").alias("kind"), F.col("value.lex").alias("lex"))


@query(f"""
SELECT {uri("brand", "replace(p_brand, '#', '_')")} AS id, name, kind, lex, min(seq) AS first_seq FROM {_FACTS} GROUP BY p_brand, name, kind, lex
""")
def typed_value_set(spark, sf):
    out = unify.typed_values(select.extra_attributes(_part_facts(spark, sf)))
    return out.select(F.col("id.uri").alias("id"), F.col("name.local").alias("name"), F.col("value.kind").alias("kind"), F.col("value.lex").alias("lex"), F.col("seq").alias("first_seq"))


@query(f"SELECT rtype, count(*) AS n, sum(seq)::BIGINT AS seqs FROM ({LIFTS['usage']} UNION ALL {LIFTS['delegation']}) GROUP BY rtype")
def records_by_type(spark, sf):
    """Only the tables of the kinds asked for are read."""
    out = select.of_kinds(lift.document(spark, sf), "Usage", "Delegation")
    return out.groupBy("rtype").agg(F.count("*").alias("n"), F.sum(F.expr(f"seq & {(1 << 44) - 1}")).alias("seqs"))


@query(LIFTS["activity"] + " AND o_orderkey = 7")
def record_by_id(spark, sf):
    """The filter on the key reaches the scan; the one on the identifier settles it."""
    return select.flat(select.by_id(lift.activities_started(spark, sf, where="o_orderkey = 7"), f"{BASE}order/7"))


@query(f"SELECT rtype, count(*) AS n FROM ({LIFTS['specialization']} UNION ALL {LIFTS['mention']}) GROUP BY rtype")
def specialization_includes_mention(spark, sf):
    return select.of_kinds(lift.document(spark, sf), "Specialization").groupBy("rtype").agg(F.count("*").alias("n"))


@query(f"SELECT CASE WHEN rtype IN ('Entity', 'Activity', 'Agent') THEN 'element' ELSE 'relation' END AS class, count(*) AS n FROM ({' UNION ALL '.join(LIFTS.values())}) GROUP BY 1")
def elements_and_relations(spark, sf):
    doc = lift.document(spark, sf)
    n = lambda df, c: df.agg(F.count("*").alias("n")).select(F.lit(c).alias("class"), "n")
    return n(select.elements(doc), "element").unionByName(n(select.relations(doc), "relation"))


@query(f"""
WITH ended AS (SELECT l_orderkey, max(l_shipdate) AS last FROM lineitem GROUP BY 1)
SELECT {uri("order", "o_orderkey")} AS id, {iso("coalesce(last, o_orderdate)")} AS start_time, {iso("last")} AS end_time FROM orders LEFT JOIN ended ON o_orderkey = l_orderkey
""")
def set_time_overwrite(spark, sf):
    """Start times are overwritten by the last ship date, where there is one."""
    ended = lift.activities_ended(spark, sf).select(F.col("id.uri").alias("uri"), F.col("t2").alias("last"))
    one = lift.activities_started(spark, sf)
    out = R.set_time(one.join(ended, F.col("id.uri") == F.col("uri"), "left"), start=F.col("last"), end=F.col("last"))
    return out.select(F.col("id.uri").alias("id"), F.col("t1.lex").alias("start_time"), F.col("t2.lex").alias("end_time"))


@query(f"""
SELECT {uri("part", "p_partkey")} AS id, u.position, u.name, u.kind, u.lex FROM part, LATERAL (VALUES (CAST(0 AS BIGINT), 'label', 'str', p_name), (1, 'size', 'int', CAST(p_size AS VARCHAR)), (2, 'brand', 'str', p_brand)) u(position, name, kind, lex)
""")
def extra_attributes(spark, sf):
    out = select.extra_attributes(lift.entities(spark, sf))
    return out.select(F.col("id.uri").alias("id"), F.col("position").cast("long").alias("position"), F.col("name.local").alias("name"), F.col("value.kind").alias("kind"), F.col("value.lex").alias("lex"))


@query(f"""
SELECT seq, u.position, u.name, u.uri, u.lex FROM ({LIFTS['end']}) e, LATERAL (VALUES (CAST(0 AS BIGINT), 'activity', arg1, NULL), (1, 'trigger', arg2, NULL), (2, 'ender', arg3, NULL), (3, 'time', NULL, t1)) u(position, name, uri, lex)
""")
def formal_attributes(spark, sf):
    return select.formal_attributes(lift.ends(spark, sf)).select("seq", F.col("position").cast("long").alias("position"), "name", "uri", "lex")


@query(f"""
SELECT seq, 'formal' AS part, u.name, u.uri AS text FROM ({LIFTS['usage']}) e, LATERAL (VALUES ('activity', arg1), ('entity', arg2)) u(name, uri)
UNION ALL SELECT {LINE_SEQ}, 'extra', 'quantity', CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) FROM lineitem
""")
def attributes_exploded(spark, sf):
    use = lift.usages(spark, sf)
    one = select.formal_attributes(use).where("uri is not null").select("seq", F.lit("formal").alias("part"), "name", F.col("uri").alias("text"))
    return one.unionByName(select.extra_attributes(use).select("seq", F.lit("extra").alias("part"), F.col("name.local").alias("name"), F.col("value.lex").alias("text")))


@query(f"""
SELECT {uri("cust", "c_custkey")} AS id, c_name AS label FROM customer UNION ALL SELECT {uri("order", "o_orderkey")}, 'order:' || o_orderkey FROM orders
""")
def label_fallback(spark, sf):
    doc = lift.agents(spark, sf).unionByName(lift.activities_started(spark, sf))
    return doc.select(F.col("id.uri").alias("id"), select.label(doc).alias("label"))


@query(f"""SELECT DISTINCT {uri("brand", "replace(p_brand, '#', '_')")} AS id, '{PROV}Collection' AS type FROM part""")
def asserted_types(spark, sf):
    return select.asserted_types(lift.collections(spark, sf)).select("id", "type")


@query(f"""
WITH r AS (SELECT scope, o_orderkey AS seq, {uri("cust", "o_custkey")} AS id FROM {_SEGMENTS}),
e AS (SELECT scope, max(seq) + 1 AS n FROM r GROUP BY scope),
s AS (SELECT scope, coalesce(sum(n) OVER (ORDER BY scope ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM e)
SELECT '' AS scope, CAST(seq + shift AS BIGINT) AS seq, id FROM r JOIN s USING (scope)
""")
def flatten(spark, sf):
    return setops.flatten(lift.region_scope(spark, sf)).select("scope", "seq", F.col("id.uri").alias("id"))


@query(f"""
SELECT scope, seq, id FROM ({LIFTS['agent']}) UNION ALL
SELECT '', CAST(seq + (SELECT max(c_custkey) + 1 FROM customer) AS BIGINT), id FROM ({LIFTS['entity']}) UNION ALL
SELECT scope, CAST(o_orderkey AS BIGINT), {uri("cust", "o_custkey")} FROM {_SEGMENTS}
""")
def update_documents(spark, sf):
    other = lift.entities(spark, sf).unionByName(lift.region_scope(spark, sf))
    return setops.update(lift.agents(spark, sf), other).select("scope", "seq", F.col("id.uri").alias("id"))


@query(f"""
WITH r AS (SELECT scope, o_orderkey AS seq, {uri("cust", "o_custkey")} AS id FROM {_SEGMENTS})
SELECT scope, count(*) AS n, count(DISTINCT seq) AS n_seq, max(seq)::BIGINT AS last FROM (
  SELECT scope, seq, id FROM r UNION ALL SELECT scope, seq + (SELECT max(seq) + 1 FROM r x WHERE x.scope = r.scope), id FROM r) GROUP BY scope
""")
def update_bundles(spark, sf):
    r = lift.region_scope(spark, sf)
    return setops.update(r, r).groupBy("scope").agg(F.count("*").alias("n"), F.countDistinct("seq").alias("n_seq"), F.max("seq").alias("last"))


@query(f"""
SELECT 'left' AS side, {uri("cust", "c_custkey")} AS id FROM customer WHERE c_custkey % 5 = 0
UNION ALL SELECT 'right', {uri("cust", "c_custkey")} FROM customer WHERE c_custkey % 5 = 1
""")
def record_diff(spark, sf):
    left, right = lift.agents(spark, sf, where="c_custkey % 5 <> 1"), lift.agents(spark, sf, where="c_custkey % 5 <> 0")
    return setops.differences(left, right).select("side", F.col("id.uri").alias("id"))


@query("SELECT true AS same, false AS other FROM region LIMIT 1")
def document_equality(spark, sf):
    """A document against itself asserted twice, and against itself without a record."""
    one, rest = lift.agents(spark, sf), lift.agents(spark, sf, where="c_custkey > 1")
    none = lambda a, b: setops.differences(a, b).agg((F.count("*") == 0).alias("x"))
    return none(one, one.unionByName(one)).withColumnRenamed("x", "same").join(none(one, rest).withColumnRenamed("x", "other"))


_GRAPH = ("agent", "activity", "generation", "association", "delegation", "influence")


@query(f"""
SELECT {uri("cust", "c_custkey")} AS uri, 'Agent' AS rtype, false AS inferred FROM customer
UNION ALL SELECT {uri("order", "o_orderkey")}, 'Activity', false FROM orders
UNION ALL SELECT DISTINCT {LINE}, 'Entity', true FROM lineitem
UNION ALL SELECT DISTINCT {uri("nation", "c_nationkey")}, 'Agent', true FROM customer
""")
def graph_nodes(spark, sf):
    """Lines and nations are never declared; their kinds follow from their roles. Orders are declared, as are customers."""
    return graph.nodes(lift.document(spark, sf, *_GRAPH)).select("uri", "rtype", "inferred")


@query(f"SELECT uri, rtype FROM ({SQL['graph_nodes']}) WHERE inferred")
def inferred_nodes(spark, sf):
    return graph.nodes(lift.document(spark, sf, *_GRAPH)).where("inferred").select("uri", "rtype")


@query(f"SELECT rtype, arg1 AS src, arg2 AS dst FROM ({LIFTS['generation']} UNION ALL {LIFTS['association']} UNION ALL {LIFTS['delegation']})")
def graph_edges(spark, sf):
    """Influence names suppliers, which nothing declares or types: those edges are left out."""
    return graph.edges(lift.document(spark, sf, *_GRAPH)).select("rtype", "src", "dst")


@query(f"SELECT rtype, count(*) AS n FROM ({' UNION ALL '.join(LIFTS[k] for k in _GRAPH if k != 'influence')}) GROUP BY rtype")
def graph_roundtrip(spark, sf):
    return graph.to_records(lift.document(spark, sf, *_GRAPH)).groupBy("rtype").agg(F.count("*").alias("n"))


@query(f"""
SELECT uri, '"' || uri || '" [' || CASE rtype WHEN 'Agent' THEN 'shape=house, style=filled, fillcolor="#FED37F"' WHEN 'Entity' THEN 'shape=oval, style=filled, fillcolor="#FFFC87"' ELSE 'shape=box, style=filled, fillcolor="#9FB1FC"' END
  || CASE WHEN inferred THEN ', style=dashed' ELSE '' END || '];' AS line FROM ({SQL['graph_nodes']})
""")
def dot_nodes(spark, sf):
    return graph.dot_nodes(lift.document(spark, sf, *_GRAPH)).select("uri", "line")


@query(f"SELECT src, dst, CASE rtype WHEN 'Generation' THEN 'wasGeneratedBy' WHEN 'Association' THEN 'wasAssociatedWith' ELSE 'actedOnBehalfOf' END AS label FROM ({SQL['graph_edges']})")
def dot_edges(spark, sf):
    return graph.dot_edges(lift.document(spark, sf, *_GRAPH)).select("src", "dst", "label")


@query(f"""
WITH r AS ({LIFTS['association']})
SELECT seq, 0 AS part, arg1 AS head, 'b' || seq AS tail FROM r UNION ALL SELECT seq, 1, 'b' || seq, arg2 FROM r UNION ALL SELECT seq, 2, 'b' || seq, arg3 FROM r WHERE arg3 IS NOT NULL
""")
def dot_nary(spark, sf):
    return graph.dot_nary(lift.associations(spark, sf)).select("seq", "part", "head", "tail")
