"""Provenance records of ordinary tables: each function makes the statements of one kind.

Native key columns are filtered before identifiers are built, so that filters reach the
Parquet scan; see `where`, a SQL condition on the source table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import records as R

BASE = "http://example.org/"


def table(spark: SparkSession, sf_dir: str, name: str, where: str | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.where(where) if where else df


def name(prefix: str, key: Column | str) -> Column:
    return V.name(prefix, f"{BASE}{prefix}/", F.col(key) if isinstance(key, str) else key)


def line() -> Column:
    return name("line", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))


def ex(local: str) -> Column:
    return V.name("ex", BASE + "ex/", local)


def line_seq() -> Column:
    return F.col("l_orderkey") * 8 + F.col("l_linenumber")


def agents(spark, sf, where=None):
    t = table(spark, sf, "customer", where)
    return R.agent(t, F.col("c_custkey"), name("cust", "c_custkey"), attrs=[(V.prov("label"), V.v_str(F.col("c_name"))), (ex("segment"), V.v_str(F.col("c_mktsegment")))])


def activities_started(spark, sf, where=None, scope=""):
    t = table(spark, sf, "orders", where)
    return R.activity(t, F.col("o_orderkey"), name("order", "o_orderkey"), startTime=V.time_of(F.col("o_orderdate")), scope=scope, attrs=[(ex("status"), V.v_str(F.col("o_orderstatus"))), (ex("priority"), V.v_str(F.col("o_orderpriority")))])


def activities_ended(spark, sf, where=None):
    t = table(spark, sf, "lineitem", where).groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"), F.count("*").alias("n"))
    return R.activity(t, F.lit(1 << 40) + F.col("l_orderkey"), name("order", "l_orderkey"), endTime=V.time_of(F.col("last")), attrs=[(ex("lines"), V.v_int(F.col("n")))])


def entities(spark, sf, where=None):
    t = table(spark, sf, "part", where)
    return R.entity(t, F.col("p_partkey"), name("part", "p_partkey"), attrs=[(V.prov("label"), V.v_str(F.col("p_name"))), (ex("size"), V.v_int(F.col("p_size"))), (ex("brand"), V.v_str(F.col("p_brand")))])


def generations(spark, sf, where=None):
    t = table(spark, sf, "lineitem", where)
    return R.generation(t, line_seq(), entity=line(), activity=name("order", "l_orderkey"), time=V.time_of(F.col("l_shipdate")))


def usages(spark, sf, where=None):
    t = table(spark, sf, "lineitem", where)
    return R.usage(t, line_seq(), activity=name("order", "l_orderkey"), entity=name("part", "l_partkey"), attrs=[(ex("quantity"), V.v_int(F.col("l_quantity").cast("long")))])


def starts(spark, sf, where=None):
    t = table(spark, sf, "events", where)
    return R.start(t, F.col("event_id"), activity=name("user", "user_id"), trigger=name("event", "event_id"), time=V.time_of(F.col("ts")))


def ends(spark, sf, where=None):
    t = table(spark, sf, "events", where)
    return R.end(t, F.col("event_id"), activity=name("user", "user_id"), trigger=name("event", "event_id"), ender=name("type", "event_type"), time=V.time_of(F.col("ts")))


def invalidations(spark, sf, where="l_returnflag = 'R'"):
    t = table(spark, sf, "lineitem", where)
    return R.invalidation(t, line_seq(), entity=line(), activity=name("order", "l_orderkey"), time=V.time_of(F.col("l_shipdate")))


def communications(spark, sf, where=None):
    """Each turn of a conversation was informed by the one before: an equi-join on the turn number."""
    t = table(spark, sf, "conversations", where).select("conv_id", "turn")
    prior = t.select("conv_id", (F.col("turn") + 1).alias("turn")).distinct()
    made = t.distinct().join(prior, ["conv_id", "turn"])
    turn = lambda n: name("turn", F.concat_ws("-", F.col("conv_id").cast("string"), n.cast("string")))
    return R.communication(made, F.col("conv_id") * 1000 + F.col("turn"), informed=turn(F.col("turn")), informant=turn(F.col("turn") - 1))


def attributions(spark, sf, where=None):
    t = table(spark, sf, "lineitem", where)
    return R.attribution(t, line_seq(), entity=line(), agent=name("supp", "l_suppkey"))


def associations(spark, sf, where=None):
    t = table(spark, sf, "orders", where)
    return R.association(t, F.col("o_orderkey"), activity=name("order", "o_orderkey"), agent=name("cust", "o_custkey"), plan=name("plan", F.substring("o_orderpriority", 1, 1)))


def delegations(spark, sf, where=None):
    t = table(spark, sf, "customer", where)
    return R.delegation(t, F.col("c_custkey"), delegate=name("cust", "c_custkey"), responsible=name("nation", "c_nationkey"))


def influences(spark, sf, where=None):
    t = table(spark, sf, "supplier", where)
    return R.influence(t, F.col("s_suppkey"), influencee=name("supp", "s_suppkey"), influencer=name("nation", "s_nationkey"))


def derivations(spark, sf, where=None, make=R.derivation):
    t = table(spark, sf, "lineitem", where)
    return make(t, line_seq(), line(), name("part", "l_partkey"), activity=name("order", "l_orderkey"))


def specializations(spark, sf, where=None):
    t = table(spark, sf, "lineitem", where)
    return R.specialization(t, line_seq(), line(), name("part", "l_partkey"))


def alternates(spark, sf, where=None):
    """Lines of one order with the same part, in the order of their numbers."""
    t = table(spark, sf, "lineitem", where).select("l_orderkey", "l_partkey", "l_linenumber")
    n = t.groupBy("l_orderkey", "l_partkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("n")).where("size(n) > 1")
    pairs = n.select("l_orderkey", F.posexplode(F.slice("n", 1, F.size("n") - 1)).alias("i", "a"), "n").select("l_orderkey", "a", F.get("n", F.col("i") + 1).alias("b"))
    of = lambda c: name("line", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col(c).cast("string")))
    return R.alternate(pairs, F.col("l_orderkey") * 8 + F.col("a"), of("a"), of("b"))


def mentions(spark, sf, where=None):
    t = table(spark, sf, "documents", where).where("source is not null").select("doc_id", "source")
    return R.mention(t, F.col("doc_id"), name("doc", "doc_id"), name("text", "doc_id"), name("source", "source"))


def collections(spark, sf, where=None):
    t = table(spark, sf, "part", where).groupBy("p_brand").agg(F.min("p_partkey").alias("k"))
    return R.collection(t, F.col("k"), name("brand", F.translate("p_brand", "#", "_")))


def memberships(spark, sf, where=None):
    t = table(spark, sf, "part", where)
    return R.membership(t, F.col("p_partkey"), name("brand", F.translate("p_brand", "#", "_")), name("part", "p_partkey"))


def region_scope(spark, sf, records_of=activities_started):
    """Started orders in a bundle for each market segment of their customers."""
    seg = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    t = table(spark, sf, "orders").join(seg, F.col("o_custkey") == F.col("c_custkey"))
    return R.activity(t, F.col("o_orderkey"), name("cust", "o_custkey"), startTime=V.time_of(F.col("o_orderdate")), scope=F.concat(F.lit(f"{BASE}segment/"), F.col("c_mktsegment")), attrs=[(ex("order"), V.v_int(F.col("o_orderkey")))])


KINDS = {
    "entity": entities, "activity": activities_started, "agent": agents, "generation": generations, "usage": usages, "start": starts, "end": ends,
    "invalidation": invalidations, "communication": communications, "attribution": attributions, "association": associations, "delegation": delegations,
    "influence": influences, "derivation": derivations, "specialization": specializations, "alternate": alternates, "mention": mentions,
    "collection": collections, "membership": memberships,
}


def document(spark, sf, *kinds: str) -> DataFrame:
    """One document of the kinds named; a filter on rtype prunes the other tables."""
    out = None
    for i, k in enumerate(kinds or KINDS):
        part = KINDS[k](spark, sf).withColumn("seq", F.col("seq") + (i << 44))
        out = part if out is None else out.unionByName(part)
    return out
