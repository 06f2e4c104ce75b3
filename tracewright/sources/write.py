"""Writing documents as text, by column functions and grouping.

Each function gives (doc_id, text) with one row for a document. For documents beyond the
size of a row use render.record_text() or triples.nquads(), which write line by line.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.catalog import KEYWORD, KINDS, PROV, SUBTYPES, TIMES, XSD, argument_names, time_names
from ..operators import records as R
from ..operators import render, triples
from ..operators.names import scope_labels
from ..operators.select import sorted_attributes
from ..operators.setops import record_key
from .read import UnknownFormat
from .write_trig import to_trig


def quoted(s: Column) -> Column:
    """A JSON string."""
    whole = F.to_json(F.struct(s.alias("v")))
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def _xsd_type(v: Column) -> Column:
    return F.when(v["kind"] == "int", V.canonical_xsd(v["lex"])).when(v["kind"] == "float", "xsd:double").when(v["kind"] == "datetime", "xsd:dateTime").when(v["kind"] == "iri", "xsd:anyURI").when(v["kind"] == "qname", "xsd:QName").when(v["kind"] == "bool", "xsd:boolean").otherwise(V.datatype_text(v["datatype"]))


def json_value(v: Column) -> Column:
    typed = F.concat(F.lit('{"$": '), quoted(v["lex"]), F.lit(', "type": '), quoted(_xsd_type(v)), F.lit("}"))
    lang = F.concat(F.lit('{"$": '), quoted(v["lex"]), F.lit(', "lang": '), quoted(v["lang"]), F.lit("}"))
    bare = F.concat(F.lit('{"$": '), quoted(v["lex"]), F.lit("}"))
    return F.when(v["kind"] == "str", quoted(v["lex"])).when(v["kind"] == "bool", v["lex"]).when(F.coalesce(v["lang"], F.lit("")) != "", lang).when((v["kind"] == "literal") & v["datatype"].isNull(), bare).otherwise(typed)


def _grouped_attributes(attrs: Column, value) -> Column:
    """array of (name text, array of value texts) in order of first appearance."""
    keys = lambda a: F.array_distinct(F.transform(a, lambda x: V.name_text(x["name"])))
    bound = F.array(attrs)
    return F.transform(bound, lambda a: F.transform(keys(a), lambda k: F.struct(k.alias("k"), F.transform(F.filter(a, lambda x: V.name_text(x["name"]) == k), lambda x: value(x["value"])).alias("v"))))[0]


def _formal_cells(prefix: str) -> Column:
    """array of `"name": "text"` of the formal attributes that are there."""
    out = None
    for kind, (_, formals) in KINDS.items():
        names, times = argument_names(kind), time_names(kind)
        cells = [F.concat(F.lit(f'"{prefix}{f}": '), quoted(F.col(R.TIMES[times.index(f)])["lex"] if f in times else V.name_text(F.col(R.ARGS[names.index(f)])))) for f in formals]
        made = F.array_compact(F.array(*[F.when((F.col(R.TIMES[times.index(f)]) if f in times else F.col(R.ARGS[names.index(f)])).isNotNull(), c) for f, c in zip(formals, cells)])) if cells else F.array().cast("array<string>")
        out = F.when(F.col("rtype") == kind, made) if out is None else out.when(F.col("rtype") == kind, made)
    return out


def _joined(df: DataFrame, keys: list[str], order: Column, text: Column, name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda s: s["t"]), ", ").alias(name), F.count("*").alias("n"), F.min("seq").alias("seq"))


def instances(records: DataFrame) -> DataFrame:
    """(doc_id, scope, seq, keyword, key, body): the JSON object of each record and the
    identifier that it is filed under; equal anonymous records share one."""
    anon = render.anonymous_ids(records, record_key(records))
    many = lambda g: F.when(F.size(g["v"]) == 1, g["v"][0]).otherwise(F.concat(F.lit("["), F.array_join(g["v"], ", "), F.lit("]")))
    attrs = F.transform(_grouped_attributes(F.col("attrs"), json_value), lambda g: F.concat(quoted(g["k"]), F.lit(": "), many(g)))
    body = F.concat(F.lit("{"), F.array_join(F.concat(_formal_cells("prov:"), attrs), ", "), F.lit("}"))
    words = F.create_map(*[F.lit(x) for kv in KEYWORD.items() for x in kv])
    joined = records.join(anon, ["doc_id", "scope", "seq"], "left")
    return joined.select("doc_id", "scope", "seq", words[F.col("rtype")].alias("keyword"), F.coalesce(V.name_text(F.col("id")), "anon").alias("key"), body.alias("body"))


def _and_empty(scopes: DataFrame, bundles: DataFrame | None, **columns: Column) -> DataFrame:
    """scopes and the bundles (doc_id, scope) that aren't among them, with these columns."""
    if bundles is None:
        return scopes
    empty = bundles.select("doc_id", "scope").distinct().join(scopes, ["doc_id", "scope"], "left_anti")
    return scopes.unionByName(empty.withColumns(columns), allowMissingColumns=True)


def to_json(records: DataFrame, namespaces: DataFrame | None = None, bundles: DataFrame | None = None) -> DataFrame:
    """PROV-JSON: keyword -> identifier -> object, a list where an identifier has several."""
    one = _joined(instances(records), ["doc_id", "scope", "keyword", "key"], F.col("seq"), F.col("body"), "body")
    one = one.withColumn("entry", F.concat(quoted(F.col("key")), F.lit(": "), F.when(F.col("n") == 1, F.col("body")).otherwise(F.concat(F.lit("["), "body", F.lit("]")))))
    words = _joined(one, ["doc_id", "scope", "keyword"], F.col("seq"), F.col("entry"), "entries")
    words = words.select("doc_id", "scope", "seq", F.concat(quoted(F.col("keyword")), F.lit(": {"), "entries", F.lit("}")).alias("part"))
    if namespaces is not None:
        named = namespaces.withColumn("entry", F.concat(quoted(F.when(F.col("prefix") == "", "default").otherwise(F.col("prefix"))), F.lit(": "), quoted(F.col("uri"))))
        heads = _joined(named, ["doc_id", "scope"], F.col("seq"), F.col("entry"), "entries").select("doc_id", "scope", F.lit(-1).cast("long").alias("seq"), F.concat(F.lit('"prefix": {'), "entries", F.lit("}")).alias("part"))
        words = words.unionByName(heads)
    scopes = _joined(words, ["doc_id", "scope"], F.col("seq"), F.col("part"), "body")
    inner = scope_labels(_and_empty(scopes, bundles, body=F.lit("")).where("scope <> ''"), namespaces).withColumn("part", F.concat(quoted(F.col("label")), F.lit(": {"), "body", F.lit("}")))
    bundles = _joined(inner, ["doc_id"], F.col("scope"), F.col("part"), "parts").select("doc_id", F.concat(F.lit('"bundle": {'), "parts", F.lit("}")).alias("bundles"))
    own = scopes.where("scope = ''").select("doc_id", "body")
    both = own.join(bundles, "doc_id", "full")
    return both.select("doc_id", F.concat(F.lit("{"), F.concat_ws(", ", "body", "bundles"), F.lit("}")).alias("text"))


# Attributes with a bare term in the JSON-LD notation; the first three hold names.
_TERMS = {"prov:type": "type", "prov:location": "location", "prov:role": "role", "prov:label": "label", "prov:value": "value"}


def jsonld_value(v: Column, term: Column) -> Column:
    plain = F.concat(F.lit('{"@value": '), quoted(v["lex"]), F.lit("}"))
    lang = F.concat(F.lit('{"@value": '), quoted(v["lex"]), F.lit(', "@language": '), quoted(v["lang"]), F.lit("}"))
    typed = F.concat(F.lit('{"@value": '), quoted(v["lex"]), F.lit(', "@type": '), quoted(_xsd_type(v)), F.lit("}"))
    return F.when((v["kind"] == "qname") & term.isin("type", "location", "role"), quoted(v["lex"])).when(v["kind"] == "str", plain).when(F.coalesce(v["lang"], F.lit("")) != "", lang).otherwise(typed)


def jsonld_statement(records: DataFrame) -> Column:
    """The JSON-LD object of a record; a mention has none and raises."""
    terms = F.create_map(*[F.lit(x) for kv in _TERMS.items() for x in kv])

    def term(name: Column) -> Column:
        text = V.name_text(name)
        bare = terms[text]
        # the bare value is of entities only; a name without prefix is written whole
        bare = F.when((text == "prov:value") & (F.col("rtype") != "Entity"), F.lit(None)).otherwise(bare)
        return F.coalesce(bare, F.when(name["prefix"] == "", name["uri"]).otherwise(text))

    keys = F.array_distinct(F.transform("attrs", lambda a: term(a["name"])))
    extra = F.transform(keys, lambda k: F.concat(quoted(k), F.lit(": ["), F.array_join(F.transform(F.filter("attrs", lambda a: term(a["name"]) == k), lambda a: jsonld_value(a["value"], k)), ", "), F.lit("]")))
    head = F.array_compact(F.array(F.concat(F.lit('"@type": '), quoted(F.col("rtype"))), F.when(F.col("id").isNotNull(), F.concat(F.lit('"@id": '), quoted(V.name_text(F.col("id")))))))
    made = F.concat(F.lit("{"), F.array_join(F.concat(head, _formal_cells(""), extra), ", "), F.lit("}"))
    return F.when(F.col("rtype") == "Mention", F.raise_error(F.lit("a mention has no JSON-LD form"))).otherwise(made)


# Fixed value: the context that the JSON-LD notation names.
CONTEXT_URL = "https://openprovenance.org/prov-jsonld/context.jsonld"

#: What that context says: each kind is a class whose formal attributes are names or times.
CONTEXT = {"prov": PROV, "xsd": XSD} | {
    kind: {"@id": f"prov:{kind}", "@context": {f: {"@id": f"prov:{f}", "@type": "xsd:dateTime" if f in TIMES else "@id"} for f in formals}} for kind, (_, formals) in KINDS.items()
}


def to_jsonld(records: DataFrame, namespaces: DataFrame | None = None, bundles: DataFrame | None = None, context: str = "url") -> DataFrame:
    """The JSON-LD notation: a context of prefixes and a graph of statements and bundles. The
    notation's own context is named by its url, or written out (context="embed")."""
    if context not in ("url", "embed"):
        raise ValueError(f"context is url or embed, not {context}")
    own_context = quoted(F.lit(CONTEXT_URL)) if context == "url" else F.lit(json.dumps(CONTEXT))
    rows = records.select("doc_id", "scope", "seq", jsonld_statement(records).alias("t"))
    graph = _joined(rows, ["doc_id", "scope"], F.col("seq"), F.col("t"), "graph").select("doc_id", "scope", "graph")
    graph = _and_empty(graph, bundles, graph=F.lit(""))
    if namespaces is None:
        graph = graph.withColumn("ns", F.lit(None).cast("string"))
    else:
        entry = F.when(F.col("prefix") == "", F.concat(F.lit('"@vocab": '), quoted(F.col("uri")), F.lit(', "@base": '), quoted(F.col("uri")))).otherwise(F.concat(quoted(F.col("prefix")), F.lit(": "), quoted(F.col("uri"))))
        ns = _joined(namespaces.withColumn("entry", entry), ["doc_id", "scope"], F.col("seq"), F.col("entry"), "ns").select("doc_id", "scope", "ns")
        graph = graph.join(ns, ["doc_id", "scope"], "left")
    spaces = F.coalesce(F.concat(F.lit("{"), "ns", F.lit("}")), F.lit(None).cast("string"))
    inner = graph.where("scope <> ''").select("doc_id", "scope", F.lit(0).alias("seq"), F.concat(F.lit('{"@type": "Bundle", "@id": '), quoted(F.col("scope")), F.lit(', "@context": ['), F.coalesce(spaces, F.lit("")), F.lit('], "@graph": ['), "graph", F.lit("]}")).alias("t"))
    bundles = _joined(inner, ["doc_id"], F.col("scope"), F.col("t"), "bundles").select("doc_id", "bundles")
    own = graph.where("scope = ''").select("doc_id", "graph", spaces.alias("context")).join(bundles, "doc_id", "full")
    return own.select("doc_id", F.concat(F.lit('{"@context": ['), F.concat_ws(", ", "context", own_context), F.lit('], "@graph": ['), F.concat_ws(", ", "graph", "bundles"), F.lit("]}")).alias("text"))


def escape_xml(s: Column) -> Column:
    for raw, shown in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(raw), F.lit(shown))
    return s


def escape_name(local: Column) -> Column:
    """A local part as an XML name: other characters, a bad first one and what looks like an
    escape become _xHHHH_ (_xHHHHHHHH_ beyond the basic plane)."""
    safe = F.regexp_replace(local, "_(?=x(?:[0-9A-Fa-f]{4}|[0-9A-Fa-f]{8})_)", "_x005F_")
    points = F.split(safe, "")
    ok, first = r"^[A-Za-z0-9_.\-\x{B7}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{37D}\x{37F}-\x{1FFF}\x{200C}-\x{200D}\x{203F}-\x{2040}\x{2070}-\x{218F}\x{2C00}-\x{2FEF}\x{3001}-\x{D7FF}\x{F900}-\x{FDCF}\x{FDF0}-\x{FFFD}\x{10000}-\x{EFFFF}]$", r"^[0-9.\-\x{B7}\x{300}-\x{36F}\x{203F}-\x{2040}]$"
    code = lambda c: F.when(F.length(F.hex(F.encode(c, "UTF-16BE"))) == 4, F.concat(F.lit("_x"), F.hex(F.encode(c, "UTF-16BE")), F.lit("_"))).otherwise(F.concat(F.lit("_x"), F.lpad(F.substr(F.hex(F.encode(c, "UTF-32")), F.lit(1)), 8, "0"), F.lit("_")))
    made = F.array_join(F.transform(points, lambda c, i: F.when(~c.rlike(ok) | ((i == 0) & c.rlike(first)), code(c)).otherwise(c)), "")
    # most names need no look at each character
    return F.when(local.rlike(r"^[A-Za-z_][A-Za-z0-9_.-]*\z") & ~F.contains(local, F.lit("_x")), local).otherwise(made)


def unescape_name(local: Column) -> Column:
    """The inverse of escape_name(): the pieces between escapes, and the characters of these."""
    form = "_x([0-9A-Fa-f]{8}|[0-9A-Fa-f]{4})_"
    codes = F.regexp_extract_all(local, F.lit(form), F.lit(1))
    between = F.split(local, form, -1)
    char = lambda h: F.decode(F.unhex(F.lpad(h, 8, "0")), "UTF-32")
    made = F.array_join(F.transform(between, lambda t, i: F.concat(t, F.coalesce(char(F.get(codes, i)), F.lit("")))), "")
    return F.when(F.contains(local, F.lit("_x")), made).otherwise(local)


def _tag(n: Column) -> Column:
    return F.when(n["prefix"] == "", escape_name(n["local"])).otherwise(F.concat(n["prefix"], F.lit(":"), escape_name(n["local"])))


def xml_statement(records: DataFrame, force_types: bool = False) -> Column:
    """The XML element of a record. A subtype among its types names the element (the first one).
    force_types: all values have their datatype written, texts too."""
    subtypes = F.create_map(*[F.lit(x) for s, (word, kind) in SUBTYPES.items() for x in (f"{kind} {PROV}{s}", word)])
    words = F.create_map(*[F.lit(x) for kv in KEYWORD.items() for x in kv])
    is_sub = lambda a: (a["name"]["uri"] == PROV + "type") & subtypes[F.concat_ws(" ", F.col("rtype"), a["value"]["cmp"])].isNotNull()
    first = F.get(F.filter("attrs", is_sub), 0)
    word = F.coalesce(subtypes[F.concat_ws(" ", F.col("rtype"), first["value"]["cmp"])], words[F.col("rtype")])
    rest = F.when(first.isNull(), F.col("attrs")).otherwise(F.filter("attrs", lambda a: ~((a["name"]["uri"] == first["name"]["uri"]) & (a["value"]["kind"] == first["value"]["kind"]) & (a["value"]["cmp"] == first["value"]["cmp"]))))
    formal = None
    for kind, (_, formals) in KINDS.items():
        names, times = argument_names(kind), time_names(kind)
        cells = [F.concat(F.lit(f"<prov:{f}>"), F.col(R.TIMES[times.index(f)])["lex"], F.lit(f"</prov:{f}>")) if f in times else F.concat(F.lit(f'<prov:{f} prov:ref="'), escape_xml(_tag(F.col(R.ARGS[names.index(f)]))), F.lit('"/>')) for f in formals]
        made = F.array_join(F.array(*cells), "") if cells else F.lit("")
        formal = F.when(F.col("rtype") == kind, made) if formal is None else formal.when(F.col("rtype") == kind, made)

    def attribute(a: Column) -> Column:
        v, tag = a["value"], _tag(a["name"])
        lang = F.coalesce(v["lang"], F.lit(""))
        bare = (v["kind"] == "literal") & v["datatype"].isNull()
        text_type = F.when(v["kind"] == "str", F.lit(' xsi:type="xsd:string"' if force_types else ""))
        marks = F.when(lang != "", F.concat(F.lit(' xml:lang="'), escape_xml(lang), F.lit('"'))).when(bare, "").when(v["kind"] == "str", text_type).otherwise(F.concat(F.lit(' xsi:type="'), escape_xml(_xsd_type(v)), F.lit('"')))
        return F.concat(F.lit("<"), tag, marks, F.lit(">"), escape_xml(v["lex"]), F.lit("</"), tag, F.lit(">"))

    ident = F.coalesce(F.concat(F.lit(' prov:id="'), escape_xml(_tag(F.col("id"))), F.lit('"')), F.lit(""))
    return F.concat(F.lit("<prov:"), word, ident, F.lit(">"), formal, F.array_join(F.transform(sorted_attributes(rest), attribute), ""), F.lit("</prov:"), word, F.lit(">"))


def to_xml(records: DataFrame, namespaces: DataFrame | None = None, bundles: DataFrame | None = None, force_types: bool = False) -> DataFrame:
    """The XML notation. force_types: texts and truth values have their datatype written, too."""
    rows = records.select("doc_id", "scope", "seq", xml_statement(records, force_types).alias("t"))
    scopes = _joined_plain(rows, ["doc_id", "scope"], F.col("seq"), F.col("t"), "body")
    scopes = _and_empty(scopes, bundles, body=F.lit(""))
    if namespaces is None:
        scopes = scopes.withColumn("ns", F.lit(""))
    else:
        declared = F.concat(F.when(F.col("prefix") == "", F.lit(' xmlns="')).otherwise(F.concat(F.lit(" xmlns:"), "prefix", F.lit('="'))), escape_xml(F.col("uri")), F.lit('"'))
        ns = _joined_plain(namespaces.where("prefix not in ('prov', 'xsd', 'xsi')").withColumn("entry", declared), ["doc_id", "scope"], F.col("seq"), F.col("entry"), "ns")
        scopes = scopes.join(ns, ["doc_id", "scope"], "left").fillna("", ["ns"])
    inner = scope_labels(scopes.where("scope <> ''"), namespaces).select("doc_id", "scope", F.concat(F.lit('<prov:bundleContent prov:id="'), escape_xml(F.col("label")), F.lit('"'), "ns", F.lit(">"), "body", F.lit("</prov:bundleContent>")).alias("t"))
    bundles = _joined_plain(inner, ["doc_id"], F.col("scope"), F.col("t"), "bundles")
    own = scopes.where("scope = ''").select("doc_id", "body", "ns").join(bundles, "doc_id", "full").fillna("", ["body", "ns", "bundles"])
    head = f'<prov:document xmlns:prov="{PROV}" xmlns:xsd="{XSD}" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"'
    return own.select("doc_id", F.concat(F.lit(head), "ns", F.lit(">"), "body", "bundles", F.lit("</prov:document>")).alias("text"))


def _joined_plain(df: DataFrame, keys: list[str], order: Column, text: Column, name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda s: s["t"]), "").alias(name))


def to_rdf(records: DataFrame, namespaces: DataFrame | None = None, bundles: DataFrame | None = None) -> DataFrame:
    """N-Quads, one text for a document. The form has no place for bundles without records."""
    lines = triples.nquads(triples.quads(records))
    return lines.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set("line")), "\n").alias("text"))


WRITERS = {"json": to_json, "xml": to_xml, "jsonld": to_jsonld, "rdf": to_rdf, "trig": to_trig, "turtle": to_trig, "provn": render.document_text}


def serialize(records: DataFrame, format: str = "json", namespaces: DataFrame | None = None, bundles: DataFrame | None = None, **options) -> DataFrame:
    """(doc_id, text) of every document in a format. bundles (doc_id, scope) are written even
    without records; options are those of the format's own function."""
    if format.lower() not in WRITERS:
        raise UnknownFormat(format)
    return WRITERS[format.lower()](records, namespaces, bundles, **options)


def convert(documents: DataFrame, to: str, source: str | None = None) -> DataFrame:
    """(doc_id, text) of documents (doc_id, text) in another format."""
    from .read import PARSERS, _any, bundles_of, from_content, prefixes_of
    from .statements import flatten_documents, namespaces

    if source == "rdf":
        return serialize(from_content(documents, "rdf"), to, prefixes_of(documents), bundles_of(documents, "rdf"))
    flat = flatten_documents(documents, PARSERS[source] if source else _any)
    return serialize(from_content(documents, source), to, namespaces(flat), bundles_of(documents, source))


__all__ = ["convert", "serialize"]
