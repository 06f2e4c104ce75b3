"""Registered queries of scalar functions, names, text and triples, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.catalog import BASE_KIND, PROV
from ..operators import names, render, select, setops, triples
from ..operators import records as R
from ..sources.write import instances
from . import lift
from .queries import LIFTS, LINE, PART_OF_LINE, iso, query, uri

_ESC = r"regexp_replace({0}, '([=''(),:;\[\]])', '\\\1', 'g')"


@query("SELECT page_id, " + _ESC.format("url") + " AS escaped FROM pages")
def qname_escape(spark, sf):
    return lift.table(spark, sf, "pages").select("page_id", V.escape_local(F.col("url")).alias("escaped"))


_QUOTE = r"""CASE WHEN contains({0}, chr(10)) THEN '\"\"\"' || replace(replace({0}, '\', '\\'), '"', '\"') || '\"\"\"' ELSE '"' || replace(replace({0}, '\', '\\'), '"', '\"') || '"' END""".replace('\\"\\"\\"', '"""')


@query("SELECT doc_id, sha256(" + _QUOTE.format("text") + ") AS quoted FROM documents WHERE text IS NOT NULL")
def provn_quote(spark, sf):
    return lift.table(spark, sf, "documents").where("text is not null").select("doc_id", F.sha2(V.quote(F.col("text")), 256).alias("quoted"))


@query(f"""
SELECT 'time' AS form, event_id AS id, '"' || {iso("ts")} || '" %% xsd:dateTime' AS text FROM events
UNION ALL SELECT 'int', event_id, CAST(user_id AS VARCHAR) FROM events
UNION ALL SELECT 'long', event_id, '"' || (3000000000 + event_id) || '" %% xsd:long' FROM events
UNION ALL SELECT 'bool', event_id, CASE WHEN event_id % 2 = 0 THEN '"1" %% xsd:boolean' ELSE '"0" %% xsd:boolean' END FROM events
UNION ALL SELECT 'str', event_id, '"' || event_type || '"' FROM events
UNION ALL SELECT 'iri', event_id, '"http://example.org/' || event_id || '" %% xsd:anyURI' FROM events
""")
def provn_value(spark, sf):
    t = lift.table(spark, sf, "events")
    forms = {
        "time": V.v_datetime(V.time_of(F.col("ts"))), "int": V.v_int(F.col("user_id")), "long": V.v_int(F.col("event_id") + 3000000000),
        "bool": V.v_bool(F.col("event_id") % 2 == 0), "str": V.v_str(F.col("event_type")), "iri": V.v_iri(F.concat(F.lit("http://example.org/"), F.col("event_id").cast("string"))),
    }
    made = F.array(*[F.struct(F.lit(k).alias("form"), F.col("event_id").alias("id"), V.provn_value(v).alias("text")) for k, v in forms.items()])
    return t.select(F.inline(made))


@query(f"""
SELECT 'Generation' AS rtype, CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS seq,
  'wasGeneratedBy(line:' || l_orderkey || '-' || l_linenumber || ', order:' || l_orderkey || ', ' || {iso("l_shipdate")} || ')' AS text FROM lineitem
UNION ALL SELECT 'Agent', c_custkey, 'agent(cust:' || c_custkey || ', [prov:label="' || c_name || '", ex:segment="' || c_mktsegment || '"])' FROM customer
UNION ALL SELECT 'Delegation', c_custkey, 'actedOnBehalfOf(cust:' || c_custkey || ', nation:' || c_nationkey || ', -)' FROM customer
UNION ALL SELECT 'Activity', o_orderkey, 'activity(order:' || o_orderkey || ', ' || {iso("o_orderdate")} || ', -, [ex:status="' || o_orderstatus || '", ex:priority="' || o_orderpriority || '"])' FROM orders
""")
def provn_record(spark, sf):
    parts = [lift.KINDS[k](spark, sf) for k in ("generation", "agent", "delegation", "activity")]
    one = parts[0]
    for p in parts[1:]:
        one = one.unionByName(p)
    return one.select("rtype", "seq", render.record_text(one).alias("text"))


@query("""
SELECT o_orderkey AS k, CASE WHEN v BETWEEN -2147483648 AND 2147483647 THEN 'xsd:int' WHEN v BETWEEN -9223372036854775808 AND 9223372036854775807 THEN 'xsd:long' ELSE 'xsd:integer' END AS type
FROM (SELECT o_orderkey, CAST(o_orderkey AS HUGEINT) * (CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN -100000000 WHEN 2 THEN 100000000000000000 ELSE -1000000000000000000 END) AS v FROM orders)
""")
def canonical_xsd(spark, sf):
    """Whole numbers of many sizes, as texts."""
    zeros = F.when(F.col("o_orderkey") % 4 == 0, "").when(F.col("o_orderkey") % 4 == 1, "00000000").when(F.col("o_orderkey") % 4 == 2, "00000000000000000").otherwise("000000000000000000")
    sign = F.when(F.col("o_orderkey") % 2 == 1, "-").otherwise("")
    return lift.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), V.canonical_xsd(F.concat(sign, F.col("o_orderkey").cast("string"), zeros)).alias("type"))


_BOOLS = "CASE event_id % 6 WHEN 0 THEN 'TRUE' WHEN 1 THEN '0' WHEN 2 THEN 'yes' WHEN 3 THEN '1' WHEN 4 THEN 'False' ELSE 't' END"


@query(f"SELECT event_id AS k, CASE WHEN lower(b) IN ('true', '1') THEN true WHEN lower(b) IN ('false', '0') THEN false END AS parsed FROM (SELECT event_id, {_BOOLS} AS b FROM events)")
def parse_boolean(spark, sf):
    return lift.table(spark, sf, "events").select(F.col("event_id").alias("k"), V.parse_boolean(F.expr(_BOOLS)).alias("parsed"))


@query(f"""
WITH d AS (SELECT o_orderkey AS k, o_orderkey % 5 AS f, o_orderdate AS t, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%H:%M:%S') AS clock FROM orders)
SELECT k, CASE f WHEN 0 THEN {iso("t")} WHEN 1 THEN regexp_replace(strftime(t + INTERVAL 123456 MICROSECOND, '%Y-%m-%dT%H:%M:%S.%f'), '\\.000000$', '') WHEN 2 THEN day || 'T' || clock || '+00:00'
  WHEN 3 THEN strftime(CAST(day AS TIMESTAMP) + INTERVAL 1 DAY, '%Y-%m-%dT%H:%M:%S') END AS lex, CASE f WHEN 4 THEN NULL ELSE f = 2 END AS aware FROM d
""")
def parse_xsd_datetime(spark, sf):
    """Plain, long fractions, zulu, hour 24, and bare dates, which are no date-times."""
    day, clock = F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "HH:mm:ss")
    f = F.col("o_orderkey") % 5
    text = F.when(f == 0, F.concat(day, F.lit("T"), clock)).when(f == 1, F.concat(day, F.lit("T"), clock, F.lit(".1234569"))).when(f == 2, F.concat(day, F.lit("T"), clock, F.lit("Z"))).when(f == 3, F.concat(day, F.lit("T24:00:00"))).otherwise(day)
    return lift.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), V.parse_datetime(text).alias("t")).select("k", F.col("t.lex").alias("lex"), F.col("t.aware").alias("aware"))


_KINDS = sorted(BASE_KIND) + ["Nothing"]


@query(f"""
WITH line AS (SELECT l_orderkey AS k, l_linenumber AS line, (l_orderkey + l_linenumber) % {len(_KINDS)} AS i FROM lineitem),
kinds AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{k}', {'NULL' if k not in BASE_KIND else repr(BASE_KIND[k])})" for i, k in enumerate(_KINDS))}) t(i, kind, base))
SELECT k, line, kind, base FROM line JOIN kinds USING (i)
""")
def base_type(spark, sf):
    """Each line of an order as a statement of some kind or subtype, and the kind that it is based on."""
    of = F.array(*map(F.lit, _KINDS))[((F.col("l_orderkey") + F.col("l_linenumber")) % len(_KINDS)).cast("int")]
    lines = lift.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), of.alias("kind"))
    return lines.withColumn("base", V.base_kind(F.col("kind")))


_NS = [("com", "http://www."), ("ex", "http://example.org/"), ("http", "http://"), ("https", "https://"), ("blog", "https://blog."), ("any", "http")]


def _namespaces(spark):
    return spark.createDataFrame([("doc", "", i, p, u) for i, (p, u) in enumerate(_NS)], names.SCHEMA)


_NS_SQL = "(VALUES " + ", ".join(f"({i}, '{p}', '{u}')" for i, (p, u) in enumerate(_NS)) + ") n(seq, prefix, uri)"


def _match_sql(order: str) -> str:
    return f"""SELECT page_id, prefix AS ns_prefix, substr(url, length(uri) + 1) AS local FROM (
      SELECT page_id, url, n.prefix, n.uri, row_number() OVER (PARTITION BY page_id ORDER BY {order}) AS rn FROM pages LEFT JOIN {_NS_SQL} ON starts_with(url, n.uri)) WHERE rn = 1"""


@query(_match_sql("seq"))
def namespace_first_match(spark, sf):
    return names.first_match(lift.table(spark, sf, "pages"), _namespaces(spark), "url").select("page_id", "ns_prefix", "local")


@query(_match_sql("length(uri) DESC, seq"))
def namespace_longest_match(spark, sf):
    return names.longest_match(lift.table(spark, sf, "pages"), _namespaces(spark), "url").select("page_id", "ns_prefix", "local")


@query(f"""
SELECT k, prefix, local, uri FROM (SELECT page_id AS k, 'ex' AS prefix, CAST(page_id AS VARCHAR) AS local, 'http://example.org/' || page_id AS uri FROM pages
UNION ALL SELECT page_id, '', 'p' || page_id, 'http://default.org/p' || page_id FROM pages
UNION ALL SELECT page_id, 'prov', 'Plan', '{PROV}Plan' FROM pages
UNION ALL SELECT page_id, NULL, NULL, NULL FROM pages UNION ALL SELECT page_id, NULL, NULL, NULL FROM pages)
""")
def resolve_names(spark, sf):
    """Prefixed, default, whole-uri, unknown and blank names against the namespaces of one document."""
    spaces = spark.createDataFrame([("doc", "", 0, "ex", "http://example.org/"), ("doc", "", 1, "", "http://default.org/")], names.SCHEMA)
    k = F.col("page_id").cast("string")
    texts = F.array(F.concat(F.lit("ex:"), k), F.concat(F.lit("p"), k), F.lit(PROV + "Plan"), F.concat(F.lit("zz:"), k), F.concat(F.lit("_:b"), k))
    rows = lift.table(spark, sf, "pages").select(F.col("page_id").alias("k"), F.explode(texts).alias("t"), F.lit("doc").alias("doc_id"))
    found = rows.join(names.tables(spaces).select("doc_id", "own"), "doc_id").select("k", names.resolve(F.col("t"), F.col("own")).alias("n"))
    return found.select("k", F.col("n.prefix").alias("prefix"), F.col("n.local").alias("local"), F.col("n.uri").alias("uri"))


@query(f"""
SELECT {uri("part", "p_partkey")} AS id, 'prov:label,prov:type,prov:value,ex:brand,ex:size' AS names, p_name || '|' || p_type || '|' || p_partkey || '|' || p_brand || '|' || p_size AS lexes FROM part
""")
def sorted_attributes(spark, sf):
    t = lift.table(spark, sf, "part")
    one = R.entity(t, F.col("p_partkey"), lift.name("part", "p_partkey"), attrs=[(lift.ex("size"), V.v_int(F.col("p_size"))), (V.prov("value"), V.v_int(F.col("p_partkey"))), (lift.ex("brand"), V.v_str(F.col("p_brand"))), (V.prov("type"), V.v_str(F.col("p_type"))), (V.prov("label"), V.v_str(F.col("p_name")))])
    made = one.select(F.col("id.uri").alias("id"), select.sorted_attributes(F.col("attrs")).alias("a"))
    return made.select("id", F.array_join(F.transform("a", lambda a: V.name_text(a["name"])), ",").alias("names"), F.array_join(F.transform("a", lambda a: a["value"]["lex"]), "|").alias("lexes"))


@query(f"""
WITH r AS (SELECT DISTINCT o_custkey, o_orderkey FROM orders), f AS (SELECT o_custkey, min(o_orderkey) AS first FROM r GROUP BY 1),
n AS (SELECT o_custkey, row_number() OVER (ORDER BY first) AS n FROM f)
SELECT CAST(o_orderkey AS BIGINT) AS seq, '_:id' || n AS anon FROM r JOIN n USING (o_custkey)
""")
def anon_ids(spark, sf):
    """Anonymous statements that are equal (same customer and no more) share an identifier."""
    t = lift.table(spark, sf, "orders")
    one = R.attribution(t, F.col("o_orderkey"), lift.name("thing", F.lit("all")), lift.name("cust", "o_custkey"))
    return render.anonymous_ids(one, setops.record_key(one)).select("seq", "anon")


@query("""
SELECT 'activity' AS keyword, 'cust:' || o_custkey AS id, count(*) AS n, count(DISTINCT o_orderstatus) AS bodies, min(o_orderkey)::BIGINT AS first FROM orders GROUP BY 2
""")
def json_group_instances(spark, sf):
    """Statements of one keyword and identifier are filed together, as the JSON writer does it."""
    t = lift.table(spark, sf, "orders")
    one = R.activity(t, F.col("o_orderkey"), lift.name("cust", "o_custkey"), attrs=[(lift.ex("status"), V.v_str(F.col("o_orderstatus")))])
    filed = instances(one).groupBy("keyword", F.col("key").alias("id"))
    return filed.agg(F.count("*").alias("n"), F.countDistinct("body").alias("bodies"), F.min("seq").alias("first"))


@query("""
WITH g AS (SELECT l_orderkey AS k, list(DISTINCT l_partkey) AS ps, list(DISTINCT l_suppkey) AS ss FROM lineitem GROUP BY 1)
SELECT k, p, s FROM (SELECT k, unnest(ps) AS p, ss FROM g) a, LATERAL (SELECT unnest(ss) AS s) b
""")
def cartesian_expand(spark, sf):
    """A formal attribute with several values gives a statement for each combination."""
    return _combinations(lift.table(spark, sf, "lineitem"))


@query("""
WITH g AS (SELECT l_orderkey AS k, list(DISTINCT l_partkey) AS ps, list(DISTINCT l_suppkey) AS ss FROM lineitem GROUP BY 1)
SELECT k, p, s FROM (SELECT k, unnest(ps) AS p, ss FROM g) a, LATERAL (SELECT unnest(ss) AS s) b
""")
def cartesian_expand_whole(spark, sf):
    """The same, under the name that it had beside a sampled one."""
    return cartesian_expand(spark, sf)


def _combinations(lines):
    """Each order as an association told by a blank node with several agents and plans."""
    at = lambda prefix, key: triples.iri(F.concat(F.lit(f"{lift.BASE}{prefix}/"), F.col(key).cast("string")))
    node = triples.blank(F.concat(F.lit("n"), F.col("l_orderkey").cast("string")))
    rows = [(at("order", "l_orderkey"), "qualifiedAssociation", node), (node, "agent", at("supp", "l_suppkey")), (node, "hadPlan", at("part", "l_partkey"))]
    made = F.array(*[F.struct(s.cast(triples.TERM).alias("s"), F.lit(PROV + p).alias("p"), o.cast(triples.TERM).alias("o")) for s, p, o in rows])
    out = triples.from_quads(lines.select(F.lit("doc").alias("doc_id"), F.lit(None).cast("string").alias("graph"), F.inline(made)))
    number = lambda c, prefix: F.substr(F.col(f"{c}.uri"), F.lit(len(f"{lift.BASE}{prefix}/") + 1)).cast("long")
    return out.select(number("arg1", "order").alias("k"), number("arg3", "part").alias("p"), number("arg2", "supp").alias("s"))


_TYPE = triples.RDF + "type"


@query(f"""
SELECT s, p, o FROM (
  SELECT arg1 AS s, '{PROV}actedOnBehalfOf' AS p, arg2 AS o FROM ({LIFTS["delegation"]})
  UNION ALL SELECT arg1, '{PROV}specializationOf', arg2 FROM ({LIFTS["specialization"]})
  UNION ALL SELECT id, '{_TYPE}', '{PROV}Activity' FROM ({LIFTS["activity"]})
  UNION ALL SELECT id, '{PROV}startedAtTime', t1 FROM ({LIFTS["activity"]})
  UNION ALL SELECT {uri("order", "o_orderkey")}, 'http://example.org/ex/status', o_orderstatus FROM orders
  UNION ALL SELECT {uri("order", "o_orderkey")}, 'http://example.org/ex/priority', o_orderpriority FROM orders)
""")
def rdf_triples(spark, sf):
    doc = lift.delegations(spark, sf).unionByName(lift.specializations(spark, sf)).unionByName(lift.activities_started(spark, sf))
    return triples.quads(doc).select(F.col("s.lex").alias("s"), "p", F.col("o.lex").alias("o"))


@query(f"""
WITH r AS ({LIFTS["generation"]})
SELECT arg1 AS s, '{PROV}qualifiedGeneration' AS p, 'bgeneration' || seq AS o FROM r
UNION ALL SELECT 'bgeneration' || seq, '{_TYPE}', '{PROV}Generation' FROM r
UNION ALL SELECT 'bgeneration' || seq, '{PROV}activity', arg2 FROM r
UNION ALL SELECT 'bgeneration' || seq, '{PROV}atTime', t1 FROM r
""")
def rdf_qualified(spark, sf):
    """Generations with a time have a qualified node and no binary triple."""
    return triples.quads(lift.generations(spark, sf)).select(F.col("s.lex").alias("s"), "p", F.col("o.lex").alias("o"))


@query(f"""
SELECT '<' || {LINE} || '> <{PROV}specializationOf> <' || {PART_OF_LINE} || '> .' AS line FROM lineitem
""")
def nquads(spark, sf):
    return triples.nquads(triples.quads(lift.specializations(spark, sf))).select("line")


@query(f"SELECT count(*) AS n, count(DISTINCT arg1) AS subjects FROM ({LIFTS['delegation']})")
def nquads_roundtrip(spark, sf):
    """Delegations as N-Quads lines and back."""
    back = triples.from_quads(triples.read_nquads(triples.nquads(triples.quads(lift.delegations(spark, sf)))))
    return back.where("rtype = 'Delegation'").agg(F.count("*").alias("n"), F.countDistinct("arg1.uri").alias("subjects"))


_FLOATS = "CASE event_id % 8 WHEN 0 THEN 1.0 WHEN 1 THEN 1e16 WHEN 2 THEN -2.5e-5 WHEN 3 THEN 123456789.0 WHEN 4 THEN 0.0001 WHEN 5 THEN 1.5e300 WHEN 6 THEN 1234567890123456.0 ELSE 0.001 END"
_FLOAT_TEXTS = "CASE event_id % 8 WHEN 0 THEN '1.0' WHEN 1 THEN '1e+16' WHEN 2 THEN '-2.5e-05' WHEN 3 THEN '123456789.0' WHEN 4 THEN '0.0001' WHEN 5 THEN '1.5e+300' WHEN 6 THEN '1234567890123456.0' ELSE '0.001' END"


@query(f"SELECT event_id AS k, {_FLOAT_TEXTS} AS text FROM events")
def float_text(spark, sf):
    return lift.table(spark, sf, "events").select(F.col("event_id").alias("k"), V.float_text(F.expr(_FLOATS).cast("double")).alias("text"))


_DECIMALS = "CASE event_id % 6 WHEN 0 THEN '10' WHEN 1 THEN '10.00' WHEN 2 THEN '+1e1' WHEN 3 THEN '-0.0' WHEN 4 THEN '1e400' ELSE 'ten' END"


@query("SELECT event_id AS k, CASE event_id % 6 WHEN 0 THEN '1e1' WHEN 1 THEN '1e1' WHEN 2 THEN '1e1' WHEN 3 THEN '0' WHEN 4 THEN '1e400' END AS canon FROM events")
def canonical_decimal(spark, sf):
    return lift.table(spark, sf, "events").select(F.col("event_id").alias("k"), V.canonical_decimal(F.expr(_DECIMALS)).alias("canon"))


@query("SELECT page_id, url AS back FROM pages")
def ncname_escape(spark, sf):
    """Urls escaped as XML names and read again."""
    from ..sources.write import escape_name, unescape_name

    return lift.table(spark, sf, "pages").select("page_id", unescape_name(escape_name(F.col("url"))).alias("back"))


def _documents(spark, sf):
    """A small document for each nation: its customers as agents on its behalf."""
    t = lift.table(spark, sf, "customer")
    doc = F.concat(F.lit("nation"), F.col("c_nationkey").cast("string"))
    one = R.agent(t, F.col("c_custkey"), lift.name("cust", "c_custkey"), doc=doc, attrs=[(V.prov("label"), V.v_str(F.col("c_name"))), (lift.ex("balance"), V.v_float(F.col("c_acctbal")))])
    two = R.delegation(t, F.col("c_custkey") + (1 << 40), lift.name("cust", "c_custkey"), lift.name("nation", "c_nationkey"), doc=doc)
    spaces = spark.createDataFrame([(p, u) for p, u in (("cust", f"{lift.BASE}cust/"), ("ex", f"{lift.BASE}ex/"), ("nation", f"{lift.BASE}nation/"))], "prefix string, uri string")
    named = t.select(doc.alias("doc_id")).distinct().join(F.broadcast(spaces)).select("doc_id", F.lit("").alias("scope"), F.row_number().over(Window.partitionBy("doc_id").orderBy("prefix")).cast("long").alias("seq"), "prefix", "uri")
    return one.unionByName(two), named


def _round_trip(format: str):
    def run(spark, sf):
        """Written, read again and compared: the records of each kind that came back equal."""
        from ..sources.read import from_content
        from ..sources.write import serialize

        records, spaces = _documents(spark, sf)
        back = from_content(serialize(records, format, spaces), format)
        same = back.select("doc_id", "rtype", setops.record_key(back).alias("k")).join(records.select("doc_id", setops.record_key(records).alias("k")).distinct(), ["doc_id", "k"], "left_semi")
        return same.groupBy("rtype").agg(F.count("*").alias("n"))

    return run


for _format in ("json", "jsonld", "xml", "rdf"):
    query("SELECT 'Agent' AS rtype, count(*) AS n FROM customer UNION ALL SELECT 'Delegation', count(*) FROM customer", f"{_format}_roundtrip")(_round_trip(_format))

from . import document_queries  # noqa: E402  registers its queries

assert document_queries
