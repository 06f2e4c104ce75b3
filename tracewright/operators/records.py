"""Record constructors: one row per statement, in one schema for all kinds.

records: doc_id, scope ('' for the document itself, else a bundle's uri), seq (order of
assertion in its scope), rtype, id, arg1 to arg5, t1, t2, attrs. A formal attribute that
names something is in the arg column of its position among such, times are in t1 and t2.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.catalog import KINDS, PROV, argument_names, time_names

ARGS = ("arg1", "arg2", "arg3", "arg4", "arg5")
TIMES = ("t1", "t2")
SCHEMA = "doc_id string, scope string, seq bigint, rtype string, id {n}, {args}, t1 {t}, t2 {t}, attrs {a}".format(n=V.NAME, t=V.TIME, a=V.ATTRS, args=", ".join(f"{a} {V.NAME}" for a in ARGS))
COLUMNS = ["doc_id", "scope", "seq", "rtype", "id", *ARGS, *TIMES, "attrs"]


def empty(spark: SparkSession) -> DataFrame:
    """No records."""
    return spark.createDataFrame([], SCHEMA)


def record(source: DataFrame, rtype: str, seq: Column, *, doc: Column | str = "doc", scope: Column | str = "", id: Column | None = None, attrs: Sequence[tuple[Column, Column]] = (), **formals: Column) -> DataFrame:
    """A record of each row of source. formals are given by their names in the data model;
    names as name columns, times as time columns. Elements need an id, so rows without
    one give none; relations may do without."""
    names, times = argument_names(rtype), time_names(rtype)
    unknown = set(formals) - set(KINDS[rtype][1])
    if unknown:
        raise ValueError(f"{rtype} has no formal attribute {sorted(unknown)}")
    if rtype in ("Entity", "Activity", "Agent"):
        if id is None:
            raise ValueError(f"{rtype} needs an identifier")
        source = source.where(id.isNotNull())
    args = [formals.get(names[i], V.no_name()) if i < len(names) else V.no_name() for i in range(5)]
    when = [formals.get(times[i], F.lit(None).cast(V.TIME)) if i < len(times) else F.lit(None).cast(V.TIME) for i in range(2)]
    return source.select(
        V.text(doc).alias("doc_id"), V.text(scope).alias("scope"), seq.cast("long").alias("seq"), F.lit(rtype).alias("rtype"), (V.no_name() if id is None else id).cast(V.NAME).alias("id"),
        *[a.cast(V.NAME).alias(n) for a, n in zip(args, ARGS)], *[t.cast(V.TIME).alias(n) for t, n in zip(when, TIMES)], V.attributes(*attrs).cast(V.ATTRS).alias("attrs"),
    )


def entity(source, seq, id, **more):
    return record(source, "Entity", seq, id=id, **more)


def activity(source, seq, id, startTime=None, endTime=None, **more):
    return record(source, "Activity", seq, id=id, **_given(startTime=startTime, endTime=endTime), **more)


def agent(source, seq, id, **more):
    return record(source, "Agent", seq, id=id, **more)


def generation(source, seq, entity, activity=None, time=None, **more):
    return record(source, "Generation", seq, **_given(entity=entity, activity=activity, time=time), **more)


def usage(source, seq, activity, entity=None, time=None, **more):
    return record(source, "Usage", seq, **_given(activity=activity, entity=entity, time=time), **more)


def start(source, seq, activity, trigger=None, starter=None, time=None, **more):
    return record(source, "Start", seq, **_given(activity=activity, trigger=trigger, starter=starter, time=time), **more)


def end(source, seq, activity, trigger=None, ender=None, time=None, **more):
    return record(source, "End", seq, **_given(activity=activity, trigger=trigger, ender=ender, time=time), **more)


def invalidation(source, seq, entity, activity=None, time=None, **more):
    return record(source, "Invalidation", seq, **_given(entity=entity, activity=activity, time=time), **more)


def communication(source, seq, informed, informant, **more):
    return record(source, "Communication", seq, informed=informed, informant=informant, **more)


def attribution(source, seq, entity, agent, **more):
    return record(source, "Attribution", seq, entity=entity, agent=agent, **more)


def association(source, seq, activity, agent=None, plan=None, **more):
    return record(source, "Association", seq, **_given(activity=activity, agent=agent, plan=plan), **more)


def delegation(source, seq, delegate, responsible, activity=None, **more):
    return record(source, "Delegation", seq, **_given(delegate=delegate, responsible=responsible, activity=activity), **more)


def influence(source, seq, influencee, influencer, **more):
    return record(source, "Influence", seq, influencee=influencee, influencer=influencer, **more)


def derivation(source, seq, generatedEntity, usedEntity, activity=None, generation=None, usage=None, **more):
    return record(source, "Derivation", seq, **_given(generatedEntity=generatedEntity, usedEntity=usedEntity, activity=activity, generation=generation, usage=usage), **more)


def _typed_derivation(subtype: str):
    def make(source, seq, generatedEntity, usedEntity, attrs=(), **more):
        typed = [*attrs, (V.prov("type"), V.v_qname(V.prov(subtype)))]
        return derivation(source, seq, generatedEntity, usedEntity, attrs=typed, **more)

    make.__doc__ = f"A derivation whose type is {subtype}."
    return make


revision, quotation, primary_source = map(_typed_derivation, ("Revision", "Quotation", "PrimarySource"))


def collection(source, seq, id, attrs=(), **more):
    """An entity whose type is Collection."""
    return entity(source, seq, id, attrs=[*attrs, (V.prov("type"), V.v_qname(V.prov("Collection")))], **more)


def specialization(source, seq, specificEntity, generalEntity, doc="doc", scope=""):
    return record(source, "Specialization", seq, doc=doc, scope=scope, specificEntity=specificEntity, generalEntity=generalEntity)


def alternate(source, seq, alternate1, alternate2, doc="doc", scope=""):
    return record(source, "Alternate", seq, doc=doc, scope=scope, alternate1=alternate1, alternate2=alternate2)


def mention(source, seq, specificEntity, generalEntity, bundle, doc="doc", scope=""):
    return record(source, "Mention", seq, doc=doc, scope=scope, specificEntity=specificEntity, generalEntity=generalEntity, bundle=bundle)


def membership(source, seq, collection, entity, doc="doc", scope=""):
    return record(source, "Membership", seq, doc=doc, scope=scope, collection=collection, entity=entity)


def _given(**formals):
    return {k: v for k, v in formals.items() if v is not None}


# Names of the textual notation for the same constructors.
wasGeneratedBy, used, wasStartedBy, wasEndedBy, wasInvalidatedBy = generation, usage, start, end, invalidation
wasInformedBy, wasAttributedTo, wasAssociatedWith, actedOnBehalfOf = communication, attribution, association, delegation
wasInfluencedBy, wasDerivedFrom, wasRevisionOf, wasQuotedFrom, hadPrimarySource = influence, derivation, revision, quotation, primary_source
specializationOf, alternateOf, mentionOf, hadMember = specialization, alternate, mention, membership


def set_time(records: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Activities with these times where they are not null; an earlier time is overwritten without a conflict."""
    is_activity = F.col("rtype") == "Activity"
    for c, new in (("t1", start), ("t2", end)):
        if new is not None:
            records = records.withColumn(c, F.when(is_activity, F.coalesce(new, F.col(c))).otherwise(F.col(c)))
    return records


def add_attributes(records: DataFrame, *pairs: tuple[Column, Column]) -> DataFrame:
    """Records with more attributes after their own; of equal ones the first stays. Formal
    attributes of other kinds can be added like any; repeated_formals() tells where one has
    several values."""
    return records.withColumn("attrs", V.distinct_attributes(F.concat("attrs", V.attributes(*pairs).cast(V.ATTRS))))


def repeated_formals(records: DataFrame) -> DataFrame:
    """(doc_id, scope, seq, kind, detail) of records that have several values of a formal
    attribute of the data model, among their attributes or beside their own formal value."""
    own = [(k, c, n) for k in KINDS for c, n in (*zip(ARGS, argument_names(k)), *zip(TIMES, time_names(k)))]
    cells = [F.struct(F.lit(n).alias("name"), F.when(F.col("rtype") == k, F.col(c)["uri"] if c in ARGS else F.concat(F.when(F.col(c)["aware"], "A").otherwise("N"), F.col(c)["micros"].cast("string"))).alias("value")) for k, c, n in own]
    formal = sorted({PROV + n for _, _, n in own})
    more = F.transform(F.filter("attrs", lambda a: a["name"]["uri"].isin(formal)), lambda a: F.struct(F.substr(a["name"]["uri"], F.lit(len(PROV) + 1)).alias("name"), a["value"]["cmp"].alias("value")))
    some = records.where(F.size(more) > 0)
    each = some.select("doc_id", "scope", "seq", "rtype", F.explode(F.concat(F.filter(F.array(*cells), lambda c: c["value"].isNotNull()), more)).alias("c"))
    found = each.groupBy("doc_id", "scope", "seq", "rtype", F.col("c.name").alias("detail")).agg(F.count_distinct("c.value").alias("n")).where("n > 1")
    return found.select("doc_id", "scope", "seq", F.lit("repeated").alias("kind"), "detail")


def add_asserted_type(records: DataFrame, kind: Column) -> DataFrame:
    return add_attributes(records, (V.prov("type"), V.v_qname(kind)))


def in_scope(records: DataFrame, scope: Column | str) -> DataFrame:
    """The records as those of a bundle. A document inside another has no bundles of its own."""
    return records.withColumn("scope", V.text(scope))


def add_bundle(document: DataFrame, bundle: DataFrame, uri: str) -> DataFrame:
    """document with the records of bundle (which may have none of its own) as the bundle uri, unless the document has such a bundle."""
    inner = bundle.withColumn("__nested", F.when(F.col("scope") != "", F.raise_error(F.lit("a bundle cannot hold bundles"))))
    taken = document.where(F.col("scope") == uri).select("doc_id").distinct().withColumn("__taken", F.lit(True))
    inner = inner.where("__nested is null").join(taken, "doc_id", "left").withColumn("__clash", F.when(F.col("__taken"), F.raise_error(F.lit(f"bundle {uri} exists"))))
    return document.unionByName(in_scope(inner.where("__clash is null").select(*COLUMNS), uri))
