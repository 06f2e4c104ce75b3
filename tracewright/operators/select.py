"""Filters and projections over records."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.catalog import COMMON, ELEMENTS, KINDS, PROV, RELATIONS, argument_names, time_names
from .records import ARGS, TIMES


def expand_kinds(kinds: Iterable[str]) -> list[str]:
    """`element`, `relation` and kinds as kinds; a mention is also a specialization."""
    out: set[str] = set()
    for k in kinds:
        out |= set(ELEMENTS if k == "element" else RELATIONS if k == "relation" else ("Specialization", "Mention") if k == "Specialization" else (k,))
    return sorted(out)


def of_kinds(records: DataFrame, *kinds: str) -> DataFrame:
    return records.where(F.col("rtype").isin(expand_kinds(kinds)))


def by_id(records: DataFrame, uri: str) -> DataFrame:
    """All records with that identifier."""
    return records.where(F.col("id.uri") == uri)


def elements(records: DataFrame) -> DataFrame:
    return of_kinds(records, "element")


def relations(records: DataFrame) -> DataFrame:
    return of_kinds(records, "relation")


def document_level(records: DataFrame) -> DataFrame:
    return records.where("scope = ''")


def bundle(records: DataFrame, uri: str) -> DataFrame:
    return records.where(F.col("scope") == uri)


def bundles(records: DataFrame) -> DataFrame:
    """(doc_id, bundle) of every bundle that has a record."""
    return records.where("scope <> ''").select("doc_id", F.col("scope").alias("bundle")).distinct()


def documents_with(records: DataFrame, *kinds: str) -> DataFrame:
    """Records of the documents that have a record of one of the kinds."""
    return records.join(of_kinds(records, *kinds).select("doc_id").distinct(), "doc_id", "left_semi")


def formal_attributes(records: DataFrame) -> DataFrame:
    """(doc_id, scope, seq, rtype, position, name, uri, lex) of every formal attribute, also of absent ones."""
    out = None
    keys = ["doc_id", "scope", "seq", "rtype"]
    cells = []
    for kind, (_, formals) in KINDS.items():
        names, times = argument_names(kind), time_names(kind)
        made = [F.struct(F.lit(i).alias("position"), F.lit(f).alias("name"), (F.col(ARGS[names.index(f)])["uri"] if f in names else F.lit(None).cast("string")).alias("uri"), (F.col(TIMES[times.index(f)])["lex"] if f in times else F.lit(None).cast("string")).alias("lex")) for i, f in enumerate(formals)]
        cells.append((kind, F.array(*made) if made else None))
    for kind, made in cells:
        if made is not None:
            out = F.when(F.col("rtype") == kind, made) if out is None else out.when(F.col("rtype") == kind, made)
    return records.select(*keys, F.inline(out))


def extra_attributes(records: DataFrame) -> DataFrame:
    """(doc_id, scope, seq, rtype, id, position, name, value) of every attribute that is not formal, in order."""
    return records.select("doc_id", "scope", "seq", "rtype", "id", F.posexplode("attrs").alias("position", "a")).select("doc_id", "scope", "seq", "rtype", "id", "position", F.col("a.name").alias("name"), F.col("a.value").alias("value"))


def attribute_values(attrs: Column, uri: str) -> Column:
    """The values of one attribute, each once."""
    return F.array_distinct(F.transform(F.filter(attrs, lambda a: a["name"]["uri"] == uri), lambda a: a["value"]))


def asserted_types(records: DataFrame) -> DataFrame:
    return records.select("doc_id", "scope", "seq", F.col("id.uri").alias("id"), F.explode(attribute_values(F.col("attrs"), PROV + "type")).alias("t")).select("doc_id", "scope", "seq", "id", F.col("t.cmp").alias("type"))


def label(records: DataFrame) -> Column:
    """The first label, or else the identifier, as text."""
    return F.coalesce(F.get(attribute_values(records["attrs"], PROV + "label"), 0)["lex"], V.name_text(records["id"]))


def sorted_attributes(attrs: Column, formals: Iterable[str] = ()) -> Column:
    """Attributes as the XML notation orders them: formals in their order, then label,
    location, role, type and value, then the others by name; equal names by value text."""
    order = [PROV + a for a in (*formals, *COMMON)]
    rank = lambda a: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), a["name"]["uri"]), F.lit(0)), F.lit(len(order) + 1))
    keyed = F.transform(attrs, lambda a: F.struct(rank(a).alias("r"), V.name_text(a["name"]).alias("n"), a["value"]["lex"].alias("v"), a.alias("a")))
    return F.transform(F.sort_array(keyed), lambda k: k["a"])


def flat(records: DataFrame) -> DataFrame:
    """Records as plain columns: uris and texts instead of structs."""
    return records.select("doc_id", "scope", "seq", "rtype", F.col("id.uri").alias("id"), *[F.col(f"{a}.uri").alias(a) for a in ARGS], *[F.col(f"{t}.lex").alias(t) for t in TIMES], F.size("attrs").cast("long").alias("n_attrs"))
