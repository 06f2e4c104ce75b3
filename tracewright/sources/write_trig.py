"""Writing documents as Turtle and TriG text: statements grouped by subject, names with
prefixes, blank nodes inside their only mention, a graph for each bundle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.catalog import PROV, XSD
from ..operators import triples
from ..operators.names import TABLE, tables
from ..operators.scratch import settle

#: Local names that need no escape, and prefixes that can be declared.
_LOCAL = r"^[A-Za-z0-9_](?:[A-Za-z0-9_-]*[A-Za-z0-9_])?$"
_PREFIX = r"^(?:[A-Za-z][A-Za-z0-9_-]*)?$"

_BUILT_IN = (("prov", PROV), ("xsd", XSD), ("rdfs", triples.RDFS))


def _spaces(documents: DataFrame, namespaces: DataFrame | None) -> DataFrame:
    """(doc_id, known): the namespaces that a document's text declares: prov, xsd and rdfs, and
    its own with other prefixes. A document has few of its own, so the array is small."""
    built_in = F.array(*[F.struct(F.lit(p).alias("prefix"), F.lit(u).alias("uri")) for p, u in _BUILT_IN]).cast(TABLE)
    if namespaces is None:
        return documents.withColumn("known", built_in)
    own = tables(namespaces).where("scope = ''").select("doc_id", F.filter("own", lambda n: n["prefix"].rlike(_PREFIX) & ~n["prefix"].isin([p for p, _ in _BUILT_IN])).alias("own"))
    joined = documents.join(own, "doc_id", "left")
    return joined.select("doc_id", F.concat(built_in, F.coalesce("own", F.array().cast(TABLE))).alias("known"))


def iri_name(uri: Column, known: Column) -> Column:
    """prefix:local by the longest namespace that leaves a plain local name, else <uri>."""
    inside = F.filter(known, lambda n: F.startswith(uri, n["uri"]) & F.substr(uri, F.length(n["uri"]) + 1).rlike(_LOCAL))
    best = F.array_max(F.transform(inside, lambda n: F.struct(F.length(n["uri"]).alias("l"), n["prefix"].alias("prefix"))))
    short = V.let(best, lambda b: F.concat(b["prefix"], F.lit(":"), F.substr(uri, b["l"] + 1)))
    return F.coalesce(short, F.concat(F.lit("<"), triples.iri_text(uri), F.lit(">")))


def _term(t: Column, known: Column) -> Column:
    whole = triples.term_text(F.struct(t["kind"].alias("kind"), t["lex"].alias("lex"), F.lit(None).cast("string").alias("datatype"), t["lang"].alias("lang")))
    typed = (t["kind"] == "literal") & t["lang"].isNull() & t["datatype"].isNotNull() & (t["datatype"] != XSD + "string")
    return F.when(t["kind"] == "iri", iri_name(t["lex"], known)).when(typed, F.concat(whole, F.lit("^^"), iri_name(t["datatype"], known))).otherwise(whole)


def _bodies(rows: DataFrame, keys: list[str], between: str) -> DataFrame:
    """(keys, body): what is said of each subject: properties in order, `a` first, and their objects."""
    one = rows.groupBy(*keys, "verb").agg(F.array_join(F.sort_array(F.collect_set("object")), ", ").alias("objects"))
    said = F.transform(F.sort_array(F.collect_list(F.struct((F.col("verb") != "a").alias("later"), F.concat_ws(" ", "verb", "objects").alias("t")))), lambda s: s["t"])
    return one.groupBy(*keys).agg(F.array_join(said, between).alias("body"))


def trig_text(quad_rows: DataFrame, namespaces: DataFrame | None = None, bundles: DataFrame | None = None) -> DataFrame:
    """(doc_id, text) of quads (doc_id, graph, s, p, o). A blank node that is mentioned once, and
    speaks of no other blank node, is written where it is mentioned. bundles (doc_id, scope)
    are graphs even without statements. For documents whose text fits a row."""
    # read in several ways below, so they are made once
    quad_rows = settle(quad_rows, "quads")
    documents = quad_rows.select("doc_id").distinct()
    if bundles is not None:
        documents = documents.unionByName(bundles.select("doc_id")).distinct()
    # quads in compressed files look small: without a hint they would be sent to all, and one task would do the work
    spaces = _spaces(documents, namespaces).hint("shuffle_hash")
    q = quad_rows.join(spaces, "doc_id").withColumn("scope", F.coalesce("graph", F.lit("")))
    verb = F.when(F.col("p") == triples.RDF + "type", "a").otherwise(iri_name(F.col("p"), F.col("known")))
    q = q.select("doc_id", "scope", F.col("s.kind").alias("kind"), F.col("s.lex").alias("lex"), _term(F.col("s"), F.col("known")).alias("subject"), verb.alias("verb"), _term(F.col("o"), F.col("known")).alias("object"), F.when(F.col("o.kind") == "blank", F.col("o.lex")).alias("points"))
    q = settle(q, "terms")
    at = ["doc_id", "scope"]
    mentions = q.where("points is not null").groupBy(*at, F.col("points").alias("lex")).agg(F.count("*").alias("n")).where("n = 1")
    leaves = q.where("kind = 'blank'").groupBy(*at, "lex").agg(F.count("points").alias("n")).where("n = 0")
    nested = leaves.join(mentions.select(*at, "lex"), [*at, "lex"], "left_semi").select(*at, "lex", F.lit(True).alias("nested"))
    q = q.join(nested.hint("merge"), [*at, "lex"], "left")
    inner = _bodies(q.where("nested"), [*at, "lex"], " ; ").select(*at, F.col("lex").alias("points"), F.concat(F.lit("[ "), "body", F.lit(" ]")).alias("inside"))
    outer = q.where("nested is null").join(inner.hint("merge"), [*at, "points"], "left").withColumn("object", F.coalesce("inside", "object"))
    said = _bodies(outer, [*at, "subject"], " ;\n    ").withColumn("text", F.concat("subject", F.lit(" "), "body", F.lit(" .")))
    graphs = said.groupBy(*at).agg(F.array_join(F.sort_array(F.collect_list("text")), "\n").alias("body"))
    if bundles is not None:
        empty = bundles.select(*at).distinct().join(graphs, at, "left_anti").withColumn("body", F.lit(""))
        graphs = graphs.unionByName(empty)
    graphs = graphs.join(spaces, "doc_id")
    block = F.when(F.col("scope") == "", F.col("body")).otherwise(F.concat(iri_name(F.col("scope"), F.col("known")), F.lit(" {\n"), "body", F.lit("\n}")))
    parts = graphs.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("scope", block.alias("t")))), lambda s: s["t"]).alias("parts"))
    heads = F.transform("known", lambda n: F.concat(F.lit("@prefix "), n["prefix"], F.lit(": <"), triples.iri_text(n["uri"]), F.lit("> .")))
    return parts.join(spaces, "doc_id").select("doc_id", F.concat(F.array_join(heads, "\n"), F.lit("\n\n"), F.array_join("parts", "\n\n"), F.lit("\n")).alias("text"))


def to_trig(records: DataFrame, namespaces: DataFrame | None = None, bundles: DataFrame | None = None) -> DataFrame:
    """Records as TriG, which is Turtle for documents without bundles."""
    # records are read for elements, binary relations and nodes
    return trig_text(triples.quads(settle(records, "records")), namespaces, bundles)
