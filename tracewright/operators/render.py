"""Text of records and documents in the textual notation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.catalog import ELEMENTS, KEYWORD, KINDS, TIMES, argument_names, time_names
from . import records as R
from .names import scope_labels
from .numbering import number_rows


def record_text(records: DataFrame) -> Column:
    """keyword(id; formals, [attributes]): `-` for an absent formal, an element's id among the formals."""
    attrs = F.transform("attrs", lambda a: F.concat(V.provn_name(a["name"]), F.lit("="), V.provn_value(a["value"])))
    extra = F.when(F.size("attrs") > 0, F.concat(F.lit("["), F.array_join(attrs, ", "), F.lit("]")))
    out = None
    for kind, (word, formals) in KINDS.items():
        names, times = argument_names(kind), time_names(kind)
        cells = []
        for f in formals:
            cell = F.col(R.TIMES[times.index(f)])["lex"] if f in TIMES else V.provn_name(F.col(R.ARGS[names.index(f)]))
            cells.append(F.coalesce(cell, F.lit("-")))
        ident = V.provn_name(F.col("id"))
        first = [ident] if kind in ELEMENTS else []
        head = F.lit("") if kind in ELEMENTS else F.coalesce(F.concat(ident, F.lit("; ")), F.lit(""))
        made = F.concat(F.lit(word + "("), head, F.concat_ws(", ", *first, *cells, extra), F.lit(")"))
        out = F.when(F.col("rtype") == kind, made) if out is None else out.when(F.col("rtype") == kind, made)
    return out


def document_text(records: DataFrame, namespaces: DataFrame | None = None, bundles: DataFrame | None = None) -> DataFrame:
    """(doc_id, text): each document as one text: prefixes, its records in order, bundles
    indented, those of `bundles` (doc_id, scope) even without records. A bundle's name has the
    prefix of its document's namespaces. For texts that fit a row; record_text() writes a
    line for each record."""
    lines = records.select("doc_id", "scope", F.struct(F.lit(1).alias("part"), F.col("seq"), record_text(records).alias("line")).alias("l"))
    if namespaces is not None:
        declared = F.when(F.col("prefix") == "", F.concat(F.lit("default <"), "uri", F.lit(">"))).otherwise(F.concat(F.lit("prefix "), "prefix", F.lit(" <"), "uri", F.lit(">")))
        heads = namespaces.select("doc_id", "scope", F.struct(F.lit(0).alias("part"), F.when(F.col("prefix") == "", -1).otherwise(F.col("seq")).cast("long").alias("seq"), declared.alias("line")).alias("l"))
        blank = namespaces.select("doc_id", "scope").distinct().select("doc_id", "scope", F.struct(F.lit(0).alias("part"), F.lit(1 << 62).alias("seq"), F.lit("").alias("line")).alias("l"))
        lines = lines.unionByName(heads).unionByName(blank)
    scopes = lines.groupBy("doc_id", "scope").agg(F.transform(F.sort_array(F.collect_list("l")), lambda l: l["line"]).alias("lines"))
    if bundles is not None:
        empty = bundles.select("doc_id", "scope").distinct().join(scopes, ["doc_id", "scope"], "left_anti")
        scopes = scopes.unionByName(empty.withColumn("lines", F.array().cast("array<string>")))
    local = F.regexp_extract("scope", r"([^/#]*)$", 1)
    if namespaces is None:
        scopes = scopes.withColumn("label", F.when(local == "", F.col("scope")).otherwise(local))
    else:
        scopes = scope_labels(scopes, namespaces)
    inner = F.concat(F.lit("  bundle "), "label", F.when(F.size("lines") > 0, F.lit("\n    ")).otherwise(""), F.array_join("lines", "\n    "), F.lit("\n  endBundle"))
    body = F.when(F.col("scope") == "", F.array_join("lines", "\n  ")).otherwise(F.substr(inner, F.lit(3)))
    joined = scopes.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("scope", body.alias("body")))), lambda s: s["body"]).alias("parts"))
    return joined.select("doc_id", F.concat(F.lit("document\n  "), F.array_join("parts", "\n  "), F.lit("\nendDocument")).alias("text"))


def anonymous_ids(records: DataFrame, key: Column) -> DataFrame:
    """(doc_id, scope, seq, anon): `_:idN` for records without an identifier; equal records
    of a document share one. N follows the first occurrence."""
    one = records.where("id is null").select("doc_id", "scope", "seq", key.alias("k"))
    firsts = one.groupBy("doc_id", "k").agg(F.min(F.struct("scope", "seq")).alias("first"))
    # one row for each distinct anonymous record is numbered, a document's in as many tasks as it needs
    numbered = number_rows(firsts, ["first"], "n", within=["doc_id"]).select("doc_id", "k", F.concat(F.lit("_:id"), F.col("n").cast("string")).alias("anon"))
    return one.join(numbered, ["doc_id", "k"]).select("doc_id", "scope", "seq", "anon")
