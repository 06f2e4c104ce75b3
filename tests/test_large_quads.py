from pyspark.sql import functions as F

from tracewright.functions.catalog import PROV
from tracewright.operators import triples


def quads(spark):
    """Quads exploded from a narrow table, whose size is estimated far too small."""
    key = F.col("id").cast("string")
    node, thing, agent = (triples.iri(F.concat(F.lit(f"http://e/{p}/"), key)) for p in "nta")
    rows = [(thing, PROV + "qualifiedAssociation", node), (node, PROV + "agent", agent), (thing, PROV + "wasAssociatedWith", agent)]
    made = F.array(*[F.struct(s.cast(triples.TERM).alias("s"), F.lit(p).alias("p"), o.cast(triples.TERM).alias("o")) for s, p, o in rows])
    return spark.range(20).select(F.lit("doc").alias("doc_id"), F.lit(None).cast("string").alias("graph"), F.inline(made))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_quads_are_never_sent_to_the_driver(spark):
    assert "Broadcast" not in plan(triples.conflicts(quads(spark)))
    assert "Broadcast" not in plan(triples.from_quads(quads(spark)))
    assert triples.from_quads(quads(spark)).count() == 20


def test_a_table_of_properties_does_not_deal_quads_by_property(spark):
    kinds = spark.createDataFrame([("http://e/made", "Generation")], "p string, kind string")
    read = triples.with_properties(quads(spark), triples.relation_properties(kinds))
    assert "BroadcastHashJoin" in plan(read) and "SortMergeJoin" not in plan(read)
