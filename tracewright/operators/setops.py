"""Combining and comparing documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .records import ARGS, COLUMNS, TIMES


def flatten(records: DataFrame) -> DataFrame:
    """All records of a document at its own level: its own first, then each bundle's, by
    uri. Nothing is merged. Sequence numbers of a scope are moved behind those of the
    scopes before it; only one row for each scope is ordered, not the records."""
    ends = records.groupBy("doc_id", "scope").agg((F.max("seq") + 1).alias("n"))
    before = Window.partitionBy("doc_id").orderBy("scope").rowsBetween(Window.unboundedPreceding, -1)
    shift = ends.select("doc_id", "scope", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__shift"))
    moved = records.join(shift, ["doc_id", "scope"]).withColumn("seq", F.col("seq") + F.col("__shift"))
    return moved.withColumn("scope", F.lit("")).select(*COLUMNS)


def without_scope(records: DataFrame) -> DataFrame:
    """flatten() without a shuffle: sequence numbers of different scopes may be equal."""
    return records.withColumn("scope", F.lit(""))


def update(records: DataFrame, other: DataFrame) -> DataFrame:
    """The records of other after those of records, scope by scope; bundles with the same
    uri become one. Sequence numbers of other go on after the largest of the scope."""
    last = records.groupBy("doc_id", "scope").agg(F.max("seq").alias("__last"))
    moved = other.join(last, ["doc_id", "scope"], "left").withColumn("seq", F.col("seq") + F.coalesce(F.col("__last") + 1, F.lit(0)))
    return records.select(*COLUMNS).unionByName(moved.select(*COLUMNS))


def record_key(records: DataFrame, with_id: bool = True) -> Column:
    """Digest of what makes records equal: kind, identifier, formal values, set of attributes."""
    args = [F.coalesce(F.col(f"{a}.uri"), F.lit("")) for a in ARGS]
    times = [F.coalesce(F.concat(F.when(F.col(t)["aware"], "A").otherwise("N"), F.col(t)["micros"].cast("string")), F.lit("")) for t in TIMES]
    attrs = F.array_sort(F.array_distinct(F.transform("attrs", lambda a: F.concat_ws("\x1f", a["name"]["uri"], a["value"]["kind"], a["value"]["cmp"]))))
    own = [F.coalesce(F.col("id.uri"), F.lit(""))] if with_id else []
    return F.sha2(F.concat_ws("\x1e", F.col("rtype"), *own, *args, *times, F.concat_ws("\x1d", attrs)), 256)


def missing_from(left: DataFrame, right: DataFrame) -> DataFrame:
    """Records of left for which the same scope of the same document of right has no equal one."""
    keyed = left.withColumn("__k", record_key(left))
    other = right.select("doc_id", "scope", record_key(right).alias("__k")).distinct()
    return keyed.join(other, ["doc_id", "scope", "__k"], "left_anti").select(*COLUMNS)


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Records of either side that the other lacks, with `side` left or right."""
    return missing_from(left, right).withColumn("side", F.lit("left")).unionByName(missing_from(right, left).withColumn("side", F.lit("right")))


def all_bundles(records: DataFrame, bundles: DataFrame | None = None) -> DataFrame:
    """(doc_id, scope) of the bundles that have records and of those in `bundles` (doc_id, scope), which may be empty."""
    used = records.where("scope <> ''").select("doc_id", "scope")
    return (used if bundles is None else used.unionByName(bundles.select("doc_id", "scope"))).distinct()


def bundle_differences(left: DataFrame, right: DataFrame, left_bundles: DataFrame | None = None, right_bundles: DataFrame | None = None) -> DataFrame:
    """(doc_id, scope, side) of bundles that only one side has, with records or empty."""
    one, other = all_bundles(left, left_bundles), all_bundles(right, right_bundles)
    only = lambda a, b, side: a.join(b, ["doc_id", "scope"], "left_anti").withColumn("side", F.lit(side))
    return only(one, other, "left").unionByName(only(other, one, "right"))


def equal(left: DataFrame, right: DataFrame, left_bundles: DataFrame | None = None, right_bundles: DataFrame | None = None, by_name: bool = True) -> bool:
    """Whether the documents have the same bundles and, in each, the same set of records, whatever their order and number.

    Symmetric on purpose: bundles or identifiers that only the other side has make a
    difference, empty bundles too, where they are given. by_name: documents of one doc_id are
    compared; without it each side is taken as one document, whatever its doc_id."""
    if not by_name:
        left, right, left_bundles, right_bundles = (x if x is None else x.withColumn("doc_id", F.lit("")) for x in (left, right, left_bundles, right_bundles))
    return missing_from(left, right).isEmpty() and missing_from(right, left).isEmpty() and bundle_differences(left, right, left_bundles, right_bundles).isEmpty()
