import pytest
from pyspark.sql import functions as F

from tracewright.functions import values as V
from tracewright.operators import graph, records as R, select, setops, unify


def name(c):
    return V.name("ex", "http://e/", F.col(c) if isinstance(c, str) else c)


def source(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_absent_unifies_and_conflicts_are_listed(spark):
    t = source(spark, [(1, "a", "2020-01-01T00:00:00", None), (2, "a", None, "2020-01-02T00:00:00"), (3, "b", "2020-01-01T00:00:00", None), (4, "b", "2020-01-03T00:00:00", None), (5, "a", "2020-01-01T00:00:00.0", None)], "k int, id string, s string, e string")
    r = R.activity(t, F.col("k"), name("id"), startTime=V.parse_datetime(F.col("s")), endTime=V.parse_datetime(F.col("e")))
    got = {x.id.local: (x.seq, x.t1.lex, x.t2 and x.t2.lex) for x in unify.unify(r).collect()}
    assert got == {"a": (1, "2020-01-01T00:00:00", "2020-01-02T00:00:00"), "b": (3, "2020-01-01T00:00:00", None)}
    assert [(x.id, x.attribute) for x in unify.conflicts(r).collect()] == [("http://e/b", "startTime")]
    with pytest.raises(Exception, match="cannot unify http://e/b"):
        unify.unify(r, strict=True).collect()


def test_anonymous_and_repeated_records_stay(spark):
    t = source(spark, [(1,), (2,)], "k int")
    r = R.attribution(t, F.col("k"), name(F.lit("e")), name(F.lit("g")))
    assert unify.unify(r).count() == 2
    assert setops.equal(r, r.where("seq = 1"))


@pytest.mark.parametrize("kinds, bad", [(("Entity", "Activity"), True), (("Entity", "Agent"), False), (("Agent", "Activity"), False), (("Agent", "Usage"), True), (("Usage", "Generation"), True), (("Derivation", "Generation"), False), (("Influence", "Derivation"), False), (("Entity", "Influence"), True)])
def test_type_rules(spark, kinds, bad):
    t = source(spark, [(1,)], "k int")
    out = R.empty(spark)
    for k in kinds:
        out = out.unionByName(R.record(t, k, F.col("k"), id=name(F.lit("x"))))
    assert (unify.type_incompatibilities(out).count() == 1) is bad


def test_bundles(spark):
    t = source(spark, [(0,), (1,)], "k int")
    doc = R.entity(t, F.col("k"), name(F.concat(F.lit("e"), F.col("k").cast("string"))))
    both = R.add_bundle(doc, doc, "http://e/b")
    assert both.count() == 4 and select.bundles(both).count() == 1
    flat = setops.flatten(both)
    assert sorted(r.seq for r in flat.collect()) == [0, 1, 2, 3] and flat.where("scope <> ''").isEmpty()
    assert not setops.equal(both, doc)
    with pytest.raises(Exception, match="exists"):
        R.add_bundle(both, doc, "http://e/b").collect()


def test_graph_infers_and_skips(spark):
    t = source(spark, [(1,)], "k int")
    gen = R.generation(t, F.col("k"), name(F.lit("e")), name(F.lit("a")))
    late = R.influence(t, F.col("k") + 1, name(F.lit("e")), name(F.lit("a")))
    early = R.influence(t, F.col("k") - 1, name(F.lit("e")), name(F.lit("a")))
    lone = R.usage(t, F.col("k") + 2, name(F.lit("a")))
    doc = gen.unionByName(late).unionByName(early).unionByName(lone)
    assert sorted((e.rtype, e.seq) for e in graph.edges(doc).collect()) == [("Generation", 1), ("Influence", 2)]
    assert sorted((n.uri, n.rtype, n.inferred) for n in graph.nodes(doc).collect()) == [("http://e/a", "Activity", True), ("http://e/e", "Entity", True)]


def test_constructors_check(spark):
    t = source(spark, [(1,)], "k int")
    with pytest.raises(ValueError):
        R.record(t, "Entity", F.col("k"))
    with pytest.raises(ValueError):
        R.record(t, "Usage", F.col("k"), agent=name(F.lit("a")))
    assert R.entity(t, F.col("k"), name(F.lit(None).cast("string"))).isEmpty()


def test_often_asserted_identifier(spark):
    """Attributes come in the order of their first assertion, once each; a record without attributes counts, too."""
    t = spark.range(3000).select(F.col("id").alias("k")).repartition(5)
    r = R.entity(t, F.col("k"), name(F.lit("hot")), attrs=[(name(F.lit("z")), V.v_str((F.col("k") % 3).cast("string"))), (name(F.lit("a")), V.v_str((F.col("k") % 2).cast("string")))])
    r = r.unionByName(R.entity(t.where("k < 2"), F.col("k") - 5, name(F.lit("hot")))).unionByName(R.entity(t.where("k = 7"), F.col("k"), name(F.lit("bare"))))
    got = {x.id.local: (x.seq, [(a.name.local, a.value.lex) for a in x.attrs]) for x in unify.unify(r).collect()}
    assert got == {"hot": (-5, [("z", "0"), ("a", "0"), ("z", "1"), ("a", "1"), ("z", "2")]), "bare": (7, [])}
    assert {x.uri: x.n for x in unify._merged(r).select("uri", "n").collect()} == {"http://e/hot": 3002, "http://e/bare": 1}


def test_typed_values_aggregate_by_hashing(spark):
    """The first of equal attributes by place, null keys and whole repeats included, without sorting all that a task reads."""
    t = source(spark, [(5, "a", "x"), (2, "a", "x"), (2, "a", "x"), (9, "z", "x"), (3, "a", "y")], "k long, id string, v string")
    r = R.entity(t, F.col("k"), name("id"), attrs=[(V.name("ex", "http://e/", F.lit("p")), V.v_str(F.col("v")))])
    out = unify.typed_values(select.extra_attributes(r).withColumn("id", F.when(F.col("seq") != 9, F.col("id"))))
    assert sorted((x.seq, x.id and x.id.local, x.value.lex) for x in out.collect()) == [(2, "a", "x"), (3, "a", "y"), (9, None, "x")]
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert any("HashAggregate(" in x and "ObjectHash" not in x and "partial_min(" in x for x in plan.split("\n")), plan
