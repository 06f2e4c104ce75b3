"""Grouping by links: union-find as DataFrame rounds, and links between the members of
LSH buckets without emitting all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scratch import release
from .common import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); component is the smallest node
    that can be reached. Links with a null end are ignored; without links, no rows.

    Each round hooks every node to its smallest neighbour, halves the paths twice and
    contracts the links by the new parents. All steps are joins and aggregates with a
    map-side part, so a node with very many links makes no large group."""
    edges = materialize(links.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    first = True
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parent = materialize(both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("p")).select("u", F.least("u", "p").alias("p")), "parents")
        parent = materialize(_jump(_jump(parent)), "roots")
        if first:
            labels = parent.select(F.col("u").alias("node"), F.col("p").alias("component"))
        else:
            labels = materialize(labels.join(parent, labels["component"] == parent["u"], "left").select("node", F.coalesce("p", "component").alias("component")), "labels")
        one = edges.join(parent, edges["a"] == parent["u"]).select(F.col("p").alias("a"), "b")
        two = one.join(parent, one["b"] == parent["u"]).select("a", F.col("p").alias("b")).where("a <> b")
        edges = materialize(two.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        first = False
    return labels


def _jump(parent: DataFrame) -> DataFrame:
    up = parent.select(F.col("u").alias("v"), F.col("p").alias("q"))
    return parent.join(up, parent["p"] == up["v"]).select("u", F.col("q").alias("p"))


#: Members of buckets up to this size are all compared with each other.
SMALL = 8

#: Best-connected members of a large bucket that others are compared with.
SLOTS = 8

#: Members of a bucket that one task compares with as many others; larger buckets are cut into a grid.
GRID = 2000


def bucket_components(members: DataFrame, facts: DataFrame, verify: Callable[[DataFrame], DataFrame], condition: str = "true", name: str = "links", prepare: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """Components (node, component) of the links between nodes that share a bucket.

    members: bucket and node; facts: node and the columns that `condition` uses as x.col
    and y.col to rule out pairs cheaply, joined only to the members of shared buckets;
    verify keeps the true links of pairs (a, b); prepare, if given, is called once before with
    the nodes (node) that a pair may have.

    1. Every node is compared with one other: the best-connected hub of its buckets. A hub is
       the member with the most bucket mates; among near copies of one text that is the one
       with the fewest changes, which most others are linked with.
    2. Every node is compared with the hubs of its other buckets, in small buckets with all
       members, and outside the hub's component in large ones with the best-connected members of
       eight slots, where the two are not connected yet.
    3. Those that are still outside are compared with all members of other components; large
       buckets are cut into a grid for that, so that no task has more than a cell of it.

    So each pair of a bucket is compared, ruled out or already connected: the components
    are those of all links, and rounds 1 and 2 are linear in the members."""
    extra = [c for c in facts.columns if c != "node"]
    crowded = members.groupBy("bucket").agg(F.count("*").alias("mates")).where("mates > 1")
    plain = materialize(members.join(crowded, "bucket"), f"{name}-shared")
    degree = plain.groupBy("node").agg(F.sum("mates").alias("degree"))
    shared = materialize(plain.join(degree, "node").join(facts, "node"), f"{name}-ranked")
    release(plain)
    hubs = shared.groupBy("bucket").agg(F.max(F.struct("degree", "node", *extra)).alias("x")).select(F.col("bucket").alias("at"), "x")
    star = shared.alias("y").join(hubs, F.expr(f"y.bucket = at and x.node <> y.node and ({condition})"))
    star = materialize(star.select(F.col("y.node").alias("node"), F.col("x.node").alias("hub"), F.col("x.degree").alias("rank")).distinct(), f"{name}-star")
    pairs = materialize(_ordered(star.groupBy("node").agg(F.max_by("hub", F.struct("rank", "hub")).alias("hub")), "node", "hub"), f"{name}-pairs")
    if prepare:
        prepare(star.select("node").union(star.select("hub")).union(shared.where("mates > 2").select("node")).distinct())
    label = connected_components(materialize(verify(pairs), f"{name}-links"))

    few = shared.where(f"mates between 3 and {SMALL}")
    every = few.alias("x").join(few.alias("y"), F.expr(f"x.bucket = y.bucket and x.node < y.node and ({condition})"))
    for last in (False, True):
        large = shared.where(f"mates > {SMALL}").join(hubs.select(F.col("at").alias("bucket"), F.col("x.node").alias("hub")), "bucket")
        known = materialize(_component(_component(large, label, "node"), label, "hub"), f"{name}-known")
        other = known.where("node_component <> hub_component")
        if last:
            side = F.ceil(F.col("mates") / GRID).cast("int")
            own, lines = F.pmod(F.xxhash64("node"), side).cast("int"), F.explode(F.sequence(F.lit(0), side - 1))
            left, right = other.withColumn("row", own).withColumn("col", lines), known.withColumn("col", own).withColumn("row", lines)
            ordered = "(x.node < y.node or y.node_component = y.hub_component)"
            near = left.alias("x").join(right.alias("y"), F.expr(f"x.bucket = y.bucket and x.row = y.row and x.col = y.col and x.node_component <> y.node_component and {ordered} and ({condition})"))
            more = _ordered(near, "x.node", "y.node")
        else:
            best = known.groupBy("bucket", F.pmod(F.xxhash64("node"), F.lit(SLOTS)).alias("slot")).agg(F.max(F.struct("degree", "node", "node_component", *extra)).alias("y")).select(F.col("bucket").alias("at"), "y")
            near = other.alias("x").join(best, F.expr(f"x.bucket = at and x.node_component <> y.node_component and ({condition})"))
            rest = _ordered(star, "node", "hub").union(_ordered(every, "x.node", "y.node"))
            rest = _component(_component(rest, label, "a"), label, "b").where("a_component <> b_component").select("a", "b")
            more = _ordered(near, "x.node", "y.node").union(rest).distinct()
        more = materialize(more.join(pairs, ["a", "b"], "left_anti"), f"{name}-more")
        release(known)
        if more.isEmpty():
            continue
        pairs = pairs.union(more)
        label = _merge(label, materialize(verify(more), f"{name}-found"), name)
    release(shared, star)
    return label


def _ordered(df: DataFrame, one: str, two: str) -> DataFrame:
    """Distinct pairs (a, b) with a < b."""
    return df.select(F.least(one, two).alias("a"), F.greatest(one, two).alias("b")).distinct()


def _component(df: DataFrame, label: DataFrame, node: str) -> DataFrame:
    """df with the component of the column `node`; a node without links is its own."""
    own = label.select(F.col("node").alias(node), F.col("component").alias(f"{node}_component"))
    return df.join(own, node, "left").withColumn(f"{node}_component", F.coalesce(f"{node}_component", node))


def _merge(label: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """label with more links: components that these join become one."""
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    every = label.unionByName(ends.join(label, "node", "left_anti").withColumn("component", F.col("node")))
    joined = connected_components(_component(_component(links, label, "a"), label, "b").select(F.col("a_component").alias("a"), F.col("b_component").alias("b")))
    up = joined.select(F.col("node").alias("component"), F.col("component").alias("top"))
    return materialize(every.join(up, "component", "left").select("node", F.coalesce("top", "component").alias("component")), f"{name}-labels")
