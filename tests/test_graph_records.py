"""Which relations a document's graph keeps, and that only doubtful ones are looked up."""

import re

from tracewright.functions import values as V
from tracewright.operators import graph
from tracewright.operators import records as R
from pyspark.sql import functions as F


def n(local):
    return V.name("ex", "http://e/", local)


def test_only_relations_without_telling_roles_are_looked_up(spark):
    one = spark.range(1)
    parts = [
        R.entity(one, F.lit(0), n("e"), doc="d"),
        R.generation(one, F.lit(1), n("e"), n("a"), doc="d"),
        R.generation(one, F.lit(2), n("e"), doc="d"),
        R.influence(one, F.lit(3), n("e"), n("a"), doc="d"),
        R.influence(one, F.lit(4), n("e"), n("nowhere"), doc="d"),
        R.influence(one, F.lit(5), n("e"), n("late"), doc="d"),
        R.generation(one, F.lit(6), n("late"), n("a"), doc="d"),
    ]
    doc = parts[0]
    for more in parts[1:]:
        doc = doc.unionByName(more)
    out = graph.to_records(doc)
    assert sorted(r.seq for r in out.collect()) == [0, 1, 3, 6]
    assert sorted(r.seq for r in graph.edges(doc).collect()) == [1, 3, 6]
    # no join deals all relations by both their names
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Join \w+, \(.*src#.*dst#", plan)
