"""Merging records that share an identifier, and finding those that cannot merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.catalog import DISJOINT, ELEMENTS, IDENTIFIED, KINDS, argument_names, time_names
from .records import ARGS, COLUMNS, TIMES


def _cmp(column: str) -> Column:
    """What two formal values are compared by."""
    if column in ARGS:
        return F.col(column)["uri"]
    return F.concat(F.when(F.col(column)["aware"], "A").otherwise("N"), F.col(column)["micros"].cast("string"))


def _merged(records: DataFrame) -> DataFrame:
    """Identified records by identifier and kind, with `conflicts`, the formal columns that hold different values.

    Attributes are dealt and made distinct one by one before they are collected, so an identifier that is
    asserted very often costs its last task one row for each distinct attribute, not one for each assertion."""
    key = ["doc_id", "scope", "uri", "rtype"]
    one = records.where("id is not null").select("*", F.col("id.uri").alias("uri"), F.posexplode_outer("attrs").alias("pos", "attr"))
    same = [F.col("attr.name.uri").alias("k0"), F.col("attr.value.kind").alias("k1"), F.col("attr.value.cmp").alias("k2")]
    # a record's formal values are counted with its first attribute only, or with none if it has no attributes
    head = "coalesce(pos, 0) = 0"
    part = one.groupBy(*key, *same).agg(
        F.expr(f"min(struct(seq, id)) filter (where {head})").alias("at"),
        F.expr(f"count_if({head})").alias("n"),
        F.min(F.struct("seq", "pos", "attr")).alias("attr"),
        *[F.expr(f"min(struct(seq, {c} as v)) filter (where {head} and {c} is not null)").alias(c) for c in (*ARGS, *TIMES)],
        *[fn(F.when(F.expr(head), _cmp(c))).alias(f"{fn.__name__}_{c}") for c in (*ARGS, *TIMES) for fn in (F.min, F.max)],
    )
    clash = [F.when(F.min(f"min_{c}") != F.max(f"max_{c}"), F.lit(c)) for c in (*ARGS, *TIMES)]
    lists = F.collect_list(F.when(F.col("attr.attr").isNotNull(), F.col("attr")))
    out = part.groupBy(*key).agg(
        F.min("at").alias("at"), *[F.min(c)["v"].alias(c) for c in (*ARGS, *TIMES)], F.transform(F.sort_array(lists), lambda a: a["attr"]).alias("attrs"), F.array_compact(F.array(*clash)).alias("conflicts"), F.sum("n").alias("n")
    )
    return out.withColumn("seq", F.col("at.seq")).withColumn("id", F.col("at.id"))


def unify(records: DataFrame, strict: bool = False, unique: bool = False) -> DataFrame:
    """One record for each identifier and kind of a scope: absent formal values agree with
    any, attributes are united (first of equal ones), the place is that of the first.
    Anonymous records stay as they are. Where formal values conflict the earliest stays;
    strict raises instead when such a row is computed. unique: identifiers are known to be
    distinct, so there is nothing to do. Conflicts are listed by violations()."""
    if unique:
        return records
    merged = _merged(records)
    if strict:
        merged = merged.withColumn("seq", F.when(F.size("conflicts") > 0, F.raise_error(F.concat(F.lit("cannot unify "), "uri", F.lit(": "), F.array_join("conflicts", ", ")))).otherwise(F.col("seq")))
    return merged.select(*COLUMNS).unionByName(records.where("id is null").select(*COLUMNS))


def _formal_name(rtype: Column, column: Column) -> Column:
    pairs = []
    for kind in KINDS:
        for columns, names in ((ARGS, argument_names(kind)), (TIMES, time_names(kind))):
            for c, n in zip(columns, names):
                pairs += [F.lit(f"{kind}.{c}"), F.lit(n)]
    return F.create_map(*pairs)[F.concat_ws(".", rtype, column)]


def conflicts(records: DataFrame) -> DataFrame:
    """(doc_id, scope, id, rtype, attribute) of every formal attribute with different values under one identifier."""
    found = _merged(records).select("doc_id", "scope", F.col("uri").alias("id"), "rtype", F.explode("conflicts").alias("c"))
    return found.select("doc_id", "scope", "id", "rtype", _formal_name(F.col("rtype"), F.col("c")).alias("attribute"))


def type_incompatibilities(records: DataFrame) -> DataFrame:
    """(doc_id, scope, id, kinds) of identifiers whose kinds may not share one: an entity
    and an activity; an element and an identified relation; two of the disjoint relations."""
    by = records.where("id is not null").groupBy("doc_id", "scope", F.col("id.uri").alias("id")).agg(F.sort_array(F.collect_set("rtype")).alias("k"))
    among = lambda kinds: F.size(F.array_intersect("k", F.array(*map(F.lit, kinds))))
    bad = (among(("Entity", "Activity")) == 2) | ((among(ELEMENTS) > 0) & (among(IDENTIFIED) > 0)) | (among(DISJOINT) > 1)
    return by.where(bad).select("doc_id", "scope", "id", F.array_join("k", ",").alias("kinds"))


def violations(records: DataFrame) -> DataFrame:
    """(doc_id, scope, id, kind, detail): everything that strict merging would reject."""
    one = conflicts(records).select("doc_id", "scope", "id", F.lit("conflict").alias("kind"), F.concat_ws(".", "rtype", "attribute").alias("detail"))
    return one.unionByName(type_incompatibilities(records).select("doc_id", "scope", "id", F.lit("types").alias("kind"), F.col("kinds").alias("detail")))


def typed_values(attributes: DataFrame) -> DataFrame:
    """Exploded attributes (doc_id, scope, id, name, value, seq, position) without repeats of
    name, kind and cmp under one identifier; the first by (seq, position) stays."""
    key = [F.col("doc_id"), F.col("scope"), F.col("id.uri"), F.col("name.uri"), F.col("value.kind"), F.col("value.cmp")]
    named = attributes.select("*", *[k.alias(f"k{i}") for i, k in enumerate(key)], (F.col("seq").cast("decimal(20,0)") * F.lit(1 << 31) + F.col("position")).cast("decimal(38,0)").alias("place"))
    keys = [f"k{i}" for i in range(len(key))]
    # a number as the least place aggregates by hashing: no task sorts all it has read, or holds more than its distinct keys
    least = named.groupBy(*[F.col(k).alias(f"of_{k}") for k in keys]).agg(F.min("place").alias("least"))
    same = F.col("place") == F.col("least")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    # rows that are repeated as a whole have one place
    best = named.join(least, same).groupBy(*keys).agg(F.any_value(F.struct(*attributes.columns)).alias("r"))
    return best.select("r.*")
