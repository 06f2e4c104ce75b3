"""Queries over whole tables, against plain Python."""

from collections import defaultdict

import __spark_entry__

SF = "/root/testdata/sf0.001"


def read(spark, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*columns).collect()]


def test_cartesian_expand_whole(spark):
    parts, suppliers = defaultdict(set), defaultdict(set)
    for k, p, s in read(spark, "lineitem", "l_orderkey", "l_partkey", "l_suppkey"):
        parts[k].add(p)
        suppliers[k].add(s)
    want = sorted((k, p, s) for k in parts for p in parts[k] for s in suppliers[k])
    assert sorted(map(tuple, __spark_entry__.queries()["cartesian_expand_whole"](spark, SF).collect())) == want


def test_type_incompatibility_whole(spark):
    kinds = defaultdict(set)
    for table, column, kind in (("orders", "o_orderkey", "Activity"), ("part", "p_partkey", "Entity"), ("supplier", "s_suppkey", "Agent"), ("customer", "c_custkey", "Influence")):
        for (k,) in read(spark, table, column):
            kinds[k].add(kind)
    want = sorted(",".join(sorted(t)) for t in kinds.values() if {"Activity", "Entity"} <= t or "Influence" in t and len(t) > 1)
    got = __spark_entry__.queries()["type_incompatibility_whole"](spark, SF).collect()
    assert sorted(r.kinds for r in got) == want and len({r.id for r in got}) == len(got)
