"""Records as RDF quads (graph, s, p, o): types, binary relations and qualified nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.catalog import KEYWORD, PROV, RELATIONS, XSD, argument_names, time_names
from . import records as R

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
TERM = "struct<kind:string,lex:string,datatype:string,lang:string>"

# Relations that never have a qualified node.
PLAIN = ("Specialization", "Alternate", "Membership", "Mention")
# Relations that have no binary triple beside a qualified node.
NODE_ONLY = ("Generation", "Usage", "Start", "End", "Invalidation", "Derivation", "Association")
# Properties that differ from prov: + attribute name.
ACTIVITY_TIMES = {"startTime": "startedAtTime", "endTime": "endedAtTime"}
QUALIFIED_FORMAL = {"time": "atTime", "plan": "hadPlan", "activity": "hadActivity", "generation": "hadGeneration", "usage": "hadUsage", "role": "hadRole", "starter": "hadActivity", "ender": "hadActivity"}
# The property of a qualified node that names its second thing.
INFLUENCER = {"Generation": "activity", "Usage": "entity", "Communication": "activity", "Start": "entity", "End": "entity", "Invalidation": "activity", "Derivation": "entity", "Attribution": "agent", "Association": "agent", "Delegation": "agent", "Influence": "influencer"}


def iri(uri: Column) -> Column:
    return F.struct(F.lit("iri").alias("kind"), uri.alias("lex"), F.lit(None).cast("string").alias("datatype"), F.lit(None).cast("string").alias("lang"))


def blank(label: Column) -> Column:
    return F.struct(F.lit("blank").alias("kind"), label.alias("lex"), F.lit(None).cast("string").alias("datatype"), F.lit(None).cast("string").alias("lang"))


def literal(lex: Column, datatype: Column) -> Column:
    return F.struct(F.lit("literal").alias("kind"), lex.alias("lex"), datatype.alias("datatype"), F.lit(None).cast("string").alias("lang"))


def term_of(v: Column) -> Column:
    """The RDF term of a value; numbers keep their full text."""
    size = F.replace(V.canonical_xsd(v["lex"]), F.lit("xsd:"), F.lit(XSD))
    datatype = F.when(v["kind"] == "str", F.lit(XSD + "string")).when(v["kind"] == "bool", F.lit(XSD + "boolean")).when(v["kind"] == "int", size).when(v["kind"] == "float", F.lit(XSD + "double")).when(v["kind"] == "datetime", F.lit(XSD + "dateTime")).otherwise(v["datatype"])
    lit = F.struct(F.lit("literal").alias("kind"), v["lex"].alias("lex"), F.when(v["lang"].isNull(), datatype).alias("datatype"), v["lang"].alias("lang"))
    return F.when(v["kind"].isin("iri", "qname"), iri(v["cmp"])).otherwise(lit)


def _property(name: Column) -> Column:
    special = {PROV + "type": RDF + "type", PROV + "label": RDFS + "label", PROV + "location": PROV + "atLocation", PROV + "role": PROV + "hadRole"}
    return F.coalesce(F.create_map(*[F.lit(x) for kv in special.items() for x in kv])[name], name)


def quads(records: DataFrame) -> DataFrame:
    """(doc_id, graph, s, p, o); graph is a bundle's uri or null, s and o are terms.

    Elements give a type triple and one for each time and attribute. A relation gives a
    qualified node (named by the identifier, else blank) where it has an identifier, a
    third name, a time, an attribute or no second name, and a binary triple where it is
    anonymous and has no such node or is of a kind that has both. Attributes of kinds that
    never have a node are lost, as the notation has no place for them."""
    graph = F.nullif(F.col("scope"), F.lit(""))
    base = records.withColumn("graph", graph)
    out = [_element_quads(base), _binary_quads(base), _qualified_quads(base)]
    return out[0].unionByName(out[1]).unionByName(out[2])


def _quad(s: Column, p: Column, o: Column) -> Column:
    return F.struct(s.cast(TERM).alias("s"), p.alias("p"), o.cast(TERM).alias("o"))


def _attribute_quads(s: Column) -> Column:
    return F.transform("attrs", lambda a: _quad(s, _property(a["name"]["uri"]), term_of(a["value"])))


def _exploded(rows: DataFrame, made: Column) -> DataFrame:
    return rows.select("doc_id", "graph", F.inline(F.filter(made, lambda q: q["o"]["lex"].isNotNull())))


def _element_quads(records: DataFrame) -> DataFrame:
    one = records.where(F.col("rtype").isin("Entity", "Activity", "Agent"))
    s = iri(F.col("id.uri"))
    own = [_quad(s, F.lit(RDF + "type"), iri(F.concat(F.lit(PROV), F.col("rtype"))))]
    own += [_quad(s, F.lit(PROV + p), literal(F.col(c)["lex"], F.lit(XSD + "dateTime"))) for c, p in zip(R.TIMES, ACTIVITY_TIMES.values())]
    return _exploded(one, F.concat(F.array(*own), _attribute_quads(s)))


def _binary_quads(records: DataFrame) -> DataFrame:
    node_only = F.col("rtype").isin(*NODE_ONLY) & _detailed()
    one = records.where(F.col("rtype").isin(list(RELATIONS)) & F.col("id").isNull() & F.col("arg1").isNotNull() & F.col("arg2").isNotNull() & ~node_only)
    words = F.create_map(*[F.lit(x) for k in RELATIONS for x in (k, PROV + KEYWORD[k])])
    extra = [_quad(iri(F.col("arg1.uri")), F.lit(PROV + "asInBundle"), iri(F.when(F.col("rtype") == "Mention", F.col("arg3.uri"))))]
    return _exploded(one, F.array(_quad(iri(F.col("arg1.uri")), words[F.col("rtype")], iri(F.col("arg2.uri"))), *extra))


def _detailed() -> Column:
    return F.col("arg2").isNull() | F.col("arg3").isNotNull() | F.col("arg4").isNotNull() | F.col("arg5").isNotNull() | F.col("t1").isNotNull() | (F.size("attrs") > 0)


def _qualified_quads(records: DataFrame) -> DataFrame:
    kinds = [k for k in RELATIONS if k not in PLAIN]
    one = records.where(F.col("rtype").isin(kinds) & F.col("arg1").isNotNull() & (F.col("id").isNotNull() | _detailed()))
    # a blank node is named by the record's place in its document
    node = F.when(F.col("id").isNotNull(), iri(F.col("id.uri"))).otherwise(blank(F.concat(F.lit("b"), F.lower("rtype"), F.col("seq").cast("string"), F.when(F.col("graph").isNull(), "").otherwise(F.md5("graph")))))
    cells = None
    for kind in kinds:
        names, times = argument_names(kind), time_names(kind)
        made = [_quad(iri(F.col("arg1.uri")), F.lit(f"{PROV}qualified{kind}"), node), _quad(node, F.lit(RDF + "type"), iri(F.lit(PROV + kind))), _quad(node, F.lit(PROV + INFLUENCER[kind]), iri(F.col("arg2.uri")))]
        made += [_quad(node, F.lit(PROV + QUALIFIED_FORMAL.get(n, n)), iri(F.col(R.ARGS[i])["uri"])) for i, n in enumerate(names) if i >= 2]
        made += [_quad(node, F.lit(PROV + "atTime"), literal(F.col("t1")["lex"], F.lit(XSD + "dateTime"))) for _ in times]
        cells = F.when(F.col("rtype") == kind, F.array(*made)) if cells is None else cells.when(F.col("rtype") == kind, F.array(*made))
    return _exploded(one, F.concat(cells, _attribute_quads(node)))


def iri_text(uri: Column) -> Column:
    """A uri with what an IRI may not hold written as an escape."""
    escaped = uri
    for c in '\\ <>"{}|^`':
        escaped = F.replace(escaped, F.lit(c), F.lit(f"\\u{ord(c):04X}"))
    return F.when(F.rlike(uri, F.lit(r'[\\ <>"{}|^`]')), escaped).otherwise(uri)


def _long_escapes(part: Column) -> Column:
    """Eight-digit escapes of a text without escaped backslashes: short ones up to U+FFFF, characters beyond."""
    short = F.regexp_replace(part, r"\\U0000([0-9A-Fa-f]{4})", r"\\u$1")
    form = r"\\U(00(?:0[1-9A-Fa-f]|10)[0-9A-Fa-f]{4})"
    codes = F.regexp_extract_all(short, F.lit(form), F.lit(1))
    char = lambda h: F.decode(F.unhex(h), "UTF-32")
    return V.let(codes, lambda c: F.array_join(F.transform(F.split(short, form, -1), lambda t, i: F.concat(t, F.coalesce(char(F.get(c, i)), F.lit("")))), ""))


def unescaped(text: Column) -> Column:
    """Text with its escapes decoded in one pass, as those of JSON, which N-Quads' are but for the eight-digit one."""
    parts = F.transform(F.split(text, r"\\\\", -1), _long_escapes)
    short = F.when(F.contains(text, F.lit("\\U")), F.array_join(parts, "\\\\")).otherwise(text)
    options = {"allowBackslashEscapingAnyCharacter": "true", "allowUnquotedControlChars": "true"}
    return F.when(F.contains(text, F.lit("\\")), F.from_json(F.concat(F.lit('["'), short, F.lit('"]')), "array<string>", options)[0]).otherwise(text)


def term_text(t: Column) -> Column:
    """A term as N-Quads writes it."""
    escaped = t["lex"]
    for raw, shown in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(shown))
    tail = F.when(t["lang"].isNotNull(), F.concat(F.lit("@"), t["lang"])).when(t["datatype"].isNotNull() & (t["datatype"] != XSD + "string"), F.concat(F.lit("^^<"), t["datatype"], F.lit(">"))).otherwise("")
    return F.when(t["kind"] == "iri", F.concat(F.lit("<"), iri_text(t["lex"]), F.lit(">"))).when(t["kind"] == "blank", F.concat(F.lit("_:"), t["lex"])).otherwise(F.concat(F.lit('"'), escaped, F.lit('"'), tail))


def nquads(quad_rows: DataFrame) -> DataFrame:
    """(doc_id, line): N-Quads, a line for each quad; splits at any size."""
    graph = F.when(F.col("graph").isNull(), "").otherwise(F.concat(F.lit(" <"), iri_text(F.col("graph")), F.lit(">")))
    return quad_rows.select("doc_id", F.concat(term_text(F.col("s")), F.lit(" <"), iri_text(F.col("p")), F.lit("> "), term_text(F.col("o")), graph, F.lit(" .")).alias("line"))


_TERM_FORM = r"(?:<[^>]*>|_:[^\s]+|\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)"

#: A line of N-Quads or N-Triples.
NQUAD = rf"^\s*({_TERM_FORM})\s+<([^>]*)>\s+({_TERM_FORM})(?:\s+<([^>]*)>)?\s*\.\s*$"


def read_nquads(lines: DataFrame) -> DataFrame:
    """Quads of N-Quads or N-Triples lines (doc_id, line), by regular expressions; other lines are left out."""
    part = [F.regexp_extract("line", NQUAD, i) for i in range(5)]
    good = lines.where(F.col("line").rlike(NQUAD))
    return good.select("doc_id", F.nullif(unescaped(part[4]), F.lit("")).alias("graph"), _term(part[1]).alias("s"), unescaped(part[2]).alias("p"), _term(part[3]).alias("o"))


def _term(text: Column) -> Column:
    body = F.regexp_extract(text, r'^"([^"\\]*+(?:\\.[^"\\]*+)*+)"', 1)
    body = unescaped(body)
    datatype, lang = F.nullif(F.regexp_extract(text, r"\^\^<([^>]*)>$", 1), F.lit("")), F.nullif(F.regexp_extract(text, r'"@([A-Za-z0-9-]+)$', 1), F.lit(""))
    lit = F.struct(F.lit("literal").alias("kind"), body.alias("lex"), F.when(lang.isNull(), F.coalesce(datatype, F.lit(XSD + "string"))).alias("datatype"), lang.alias("lang"))
    return F.when(F.startswith(text, F.lit("<")), iri(unescaped(F.regexp_extract(text, r"^<([^>]*)>", 1)))).when(F.startswith(text, F.lit("_:")), blank(F.substr(text, F.lit(3)))).otherwise(lit).cast(TERM)


def with_properties(quad_rows: DataFrame, table: DataFrame) -> DataFrame:
    """quad_rows with other properties: table (p, becomes) names what a property is read, or
    written, as. A property that it lacks stays; of several entries the smallest counts."""
    one = table.groupBy(F.col("p").alias("__p")).agg(F.min("becomes").alias("__becomes"))
    # a vocabulary is small, and a shuffle by property would give all quads of one to one task
    out = quad_rows.join(F.broadcast(one), F.col("p") == F.col("__p"), "left").withColumn("p", F.coalesce("__becomes", "p"))
    return out.select(*quad_rows.columns)


def relation_properties(table: DataFrame) -> DataFrame:
    """A table for with_properties() of a table (p, kind): properties that tell a relation of a kind."""
    words = F.create_map(*[F.lit(x) for k in RELATIONS for x in (k, PROV + KEYWORD[k])])
    return table.select("p", words[F.col("kind")].alias("becomes")).where("becomes is not null")


def _large(rows: DataFrame) -> DataFrame:
    """rows to be joined by sorting. Quads are made by exploding narrow columns of compressed files,
    so their size is estimated at a hundredth of what it is and a join would send them to the driver."""
    return rows.hint("merge")


def _qualified(q: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, facts): the nodes that `qualified` properties lead to, by subject and kind, and
    their statements with the column of the formal property that each is, if any."""
    link = F.regexp_extract("p", f"^{PROV}qualified([A-Z][A-Za-z]*)$", 1)
    subtype = F.create_map(*[F.lit(x) for s in ("Revision", "Quotation", "PrimarySource") for x in (s, "Derivation")])
    nodes = q.withColumn("link", link).where("link <> ''").select("doc_id", "scope", F.struct(F.col("o.kind").alias("kind"), F.col("o.lex").alias("lex")).alias("node"), F.coalesce(subtype[F.col("link")], F.col("link")).alias("rtype"), F.col("s.lex").alias("arg1"))
    nodes = nodes.where(F.col("rtype").isin(list(RELATIONS))).distinct()
    return nodes, nodes.join(_large(q.withColumnRenamed("s", "node")), ["doc_id", "scope", "node"]).withColumn("slot", _slots()[F.concat_ws(" ", "rtype", "p")])


def _typed(q: DataFrame) -> DataFrame:
    """(doc_id, scope, id, rtype) of elements."""
    kinds = {PROV + k: k for k in ("Entity", "Activity", "Agent")} | {PROV + s: b for s, b in _ELEMENT_SUBTYPES.items()}
    kind_of = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    return q.where((F.col("p") == RDF + "type") & (F.col("s.kind") == "iri")).withColumn("rtype", kind_of[F.col("o.lex")]).where("rtype is not null").select("doc_id", "scope", F.col("s.lex").alias("id"), "rtype").distinct()


# Kinds whose second name is read under another formal name, so that it has one value only.
SINGLE_SECOND = ("Communication", "Delegation", "Start", "End", "Derivation")


def conflicts(quad_rows: DataFrame) -> DataFrame:
    """(doc_id, scope, id, rtype, formal, n): formal properties of which an identified node has n
    values though it can have one: times, all names after the second, the second name of kinds
    that read it under another name, and start and end of an activity. from_quads() makes no
    record of these. Other repeated properties, and those of blank nodes, give a record for
    each combination."""
    q = quad_rows.select("doc_id", F.coalesce("graph", F.lit("")).alias("scope"), F.struct("s.kind", "s.lex").alias("s"), "p", "o")
    _, facts = _qualified(q)
    formal = F.create_map(*[F.lit(x) for k in RELATIONS for c, f in (*zip(R.ARGS, argument_names(k)), *zip(R.TIMES, time_names(k))) for x in (f"{k} {c}", f)])
    single = (F.col("slot") != "arg2") | F.col("rtype").isin(*SINGLE_SECOND)
    of_nodes = facts.where((F.col("node.kind") == "iri") & F.col("slot").isNotNull() & single).select("doc_id", "scope", F.col("node.lex").alias("id"), "rtype", formal[F.concat_ws(" ", "rtype", "slot")].alias("formal"), F.col("o.lex").alias("v"))
    times = F.create_map(*[F.lit(x) for t, p in ACTIVITY_TIMES.items() for x in (PROV + p, t)])
    told = _typed(q).where("rtype = 'Activity'").join(_large(q.withColumn("id", F.col("s.lex"))), ["doc_id", "scope", "id"])
    of_activities = told.select("doc_id", "scope", "id", "rtype", times[F.col("p")].alias("formal"), F.col("o.lex").alias("v")).where("formal is not null")
    every = of_nodes.unionByName(of_activities)
    return every.groupBy("doc_id", "scope", "id", "rtype", "formal").agg(F.count_distinct("v").alias("n")).where("n > 1")


def from_quads(quad_rows: DataFrame, namespaces: DataFrame | None = None, relation_map: DataFrame | None = None, predicate_map: DataFrame | None = None) -> DataFrame:
    """Records of quads, as joins and aggregates.

    Types of the data model make elements; `qualified` properties make relations of the
    node they lead to, whose formal properties are read by kind. A binary property belongs to
    the subject's qualified node of that kind that names the same thing; else to the last of
    its nodes (by kind and name) that names none, which it completes; else it makes an
    anonymous relation. A formal property with several values gives a record for each
    combination, or none where conflicts() tells that it can't have them. Identifiers get the
    prefix of the longest namespace (prefix, uri, seq) that they start with, or none.

    relation_map (p, kind) and predicate_map (p, becomes) are tables of properties to be read
    as relations of a kind, or as other properties."""
    for table in (predicate_map, None if relation_map is None else relation_properties(relation_map)):
        quad_rows = quad_rows if table is None else with_properties(quad_rows, table)
    q = quad_rows.select("doc_id", F.coalesce("graph", F.lit("")).alias("scope"), F.struct("s.kind", "s.lex").alias("s"), "p", "o")
    _, facts = _qualified(q)
    own_type = (F.col("p") == RDF + "type") & (F.col("o.lex") == F.concat(F.lit(PROV), F.col("rtype")))
    keys = ["doc_id", "scope", "node", "rtype", "arg1"]
    per = [F.collect_set(F.when(F.col("slot") == c, F.col("o.lex"))).alias(c) for c in (*R.ARGS[1:], *R.TIMES)]
    attrs = F.collect_list(F.when(F.col("slot").isNull() & ~own_type & ~F.startswith("p", F.lit(PROV + "qualified")), F.struct("p", "o"))).alias("attrs")
    found = facts.groupBy(*keys).agg(*per, attrs)
    single = F.greatest(*[F.size(c) for c in (*R.ARGS[2:], *R.TIMES)], F.when(F.col("rtype").isin(*SINGLE_SECOND), F.size("arg2")).otherwise(0))
    found = found.where((F.col("node.kind") != "iri") | (single < 2))
    words = F.create_map(*[F.lit(x) for k in RELATIONS for x in (PROV + KEYWORD[k], k)])
    plain = q.withColumn("rtype", words[F.col("p")]).where("rtype is not null and s.kind = 'iri'").select("doc_id", "scope", "rtype", F.col("s.lex").alias("arg1"), F.col("o.lex").alias("arg2"))
    pairs = ["doc_id", "scope", "rtype", "arg1"]
    told = found.select(*pairs, F.explode("arg2").alias("arg2")).distinct()
    plain = plain.join(_large(told), [*pairs, "arg2"], "left_anti")
    # a row for each subject and kind, whatever the number of nodes
    open_nodes = found.where(F.size("arg2") == 0).groupBy(*pairs).agg(F.max("node").alias("node"))
    plain = plain.join(_large(open_nodes), pairs, "left")
    completing = plain.where("node is not null").groupBy(*keys).agg(F.collect_set("arg2").alias("named"))
    plain = plain.where("node is null").drop("node")
    found = found.join(_large(completing), keys, "left").withColumn("arg2", F.array_union("arg2", F.coalesce("named", F.array().cast("array<string>"))))
    for c in (*R.ARGS[1:], *R.TIMES):
        found = found.withColumn(c, F.explode_outer(c))
    qualified = found.select("doc_id", "scope", "rtype", F.when(F.col("node.kind") == "iri", F.col("node.lex")).alias("id"), "arg1", *R.ARGS[1:], *R.TIMES, "attrs")
    none = F.lit(None).cast("string")
    pair = "array<struct<p:string,o:" + TERM + ">>"
    about = q.where(F.col("p") == PROV + "asInBundle").select("doc_id", "scope", F.lit("Mention").alias("rtype"), F.col("s.lex").alias("arg1"), F.col("o.lex").alias("in_bundle"))
    plain = plain.join(_large(about), ["doc_id", "scope", "rtype", "arg1"], "left")
    binary = plain.select("doc_id", "scope", "rtype", none.alias("id"), "arg1", "arg2", F.col("in_bundle").alias("arg3"), none.alias("arg4"), none.alias("arg5"), none.alias("t1"), none.alias("t2"), F.array().cast(pair).alias("attrs"))
    typed = _typed(q)
    facts = typed.join(_large(q.withColumn("id", F.col("s.lex"))), ["doc_id", "scope", "id"])
    times = {p: c for c, p in zip(R.TIMES, (PROV + t for t in ACTIVITY_TIMES.values()))}
    of_time = F.create_map(*[F.lit(x) for kv in times.items() for x in kv])
    is_relation = words[F.col("p")].isNotNull() | F.startswith("p", F.lit(PROV + "qualified")) | (F.col("p") == PROV + "asInBundle")
    base_type = (F.col("p") == RDF + "type") & F.col("o.lex").isin(PROV + "Entity", PROV + "Activity", PROV + "Agent")
    slot = F.when(F.col("rtype") == "Activity", of_time[F.col("p")])
    element = facts.groupBy("doc_id", "scope", "id", "rtype").agg(*[F.collect_set(F.when(slot == c, F.col("o.lex"))).alias(c) for c in R.TIMES], F.collect_list(F.when(slot.isNull() & ~is_relation & ~base_type, F.struct("p", "o"))).alias("attrs"))
    element = element.where(F.greatest(*[F.size(c) for c in R.TIMES]) < 2)
    element = element.select("doc_id", "scope", "rtype", "id", *[none.alias(a) for a in R.ARGS], *[F.get(c, F.lit(0)).alias(c) for c in R.TIMES], "attrs")
    every = element.unionByName(qualified).unionByName(binary)
    return _as_records(every, namespaces)


_ELEMENT_SUBTYPES = {"SoftwareAgent": "Agent", "Person": "Agent", "Organization": "Agent", "Plan": "Entity", "Collection": "Entity", "EmptyCollection": "Entity"}


#: Lexical forms that are no text: a year, or a year and month, with or without a zone.
_YEAR = r"^(-?)0*([0-9]{4,}|[0-9]+)(?:Z|[+-][0-9]{2}:[0-9]{2})?$"
_YEAR_FORM = r"^-?[0-9]{4,}(?:Z|[+-][0-9]{2}:[0-9]{2})?$"
_MONTH = r"^(-?)0*([0-9]+)-([0-9]{2})(?:Z|[+-][0-9]{2}:[0-9]{2})?$"
_MONTH_FORM = r"^-?[0-9]{4,}-[0-9]{2}(?:Z|[+-][0-9]{2}:[0-9]{2})?$"


def plain_form(lex: Column, datatype: Column) -> Column:
    """The text that a literal is kept by: years and months as plain numbers without zone,
    base64 without line breaks; anything else, and what is no such form, as it is."""
    sign, digits = F.regexp_extract(lex, _YEAR, 1), F.regexp_extract(lex, _YEAR, 2)
    year = F.concat(F.when(digits == "0", "").otherwise(sign), F.regexp_replace(digits, "^0+(?=.)", ""))
    month_year = F.regexp_replace(F.regexp_extract(lex, _MONTH, 2), "^0+(?=.)", "")
    month = F.concat(F.when(month_year == "0", "").otherwise(F.regexp_extract(lex, _MONTH, 1)), month_year, F.lit("-"), F.regexp_extract(lex, _MONTH, 3))
    packed = F.regexp_replace(lex, r"\s+", "")
    out = F.when((datatype == XSD + "gYear") & lex.rlike(_YEAR_FORM), year).when((datatype == XSD + "gYearMonth") & lex.rlike(_MONTH_FORM), month)
    out = out.when((datatype == XSD + "base64Binary") & F.try_to_binary(packed, F.lit("base64")).isNotNull(), packed).otherwise(lex)
    # null AND x computes x, and a text that is no base64 throws inside
    return F.when(datatype.isin(*[XSD + t for t in ("gYear", "gYearMonth", "base64Binary")]), out).otherwise(lex)


def lexical_error(lex: Column, datatype: Column) -> Column:
    """What is wrong with a typed literal's text, or null."""
    whole = datatype.isin(*[XSD + t for t in ("int", "long", "integer")])
    bad = F.when((datatype == XSD + "dateTime") & V.parse_datetime(lex).isNull(), "no date and time").when((datatype == XSD + "gYear") & ~lex.rlike(_YEAR_FORM), "no year")
    bad = bad.when((datatype == XSD + "gYearMonth") & ~lex.rlike(_MONTH_FORM), "no year and month").when((datatype == XSD + "boolean") & V.parse_boolean(lex).isNull(), "no truth value")
    bad = bad.when((datatype == XSD + "double") & lex.try_cast("double").isNull(), "no number").when(whole & ~lex.rlike(r"^\s*[+-]?[0-9]+\s*$"), "no whole number")
    bad = bad.when((datatype == XSD + "base64Binary") & F.try_to_binary(F.regexp_replace(lex, r"\s+", ""), F.lit("base64")).isNull(), "no base64")
    return F.when(datatype.isNotNull(), bad)


def bad_literals(quad_rows: DataFrame) -> DataFrame:
    """(doc_id, scope, s, p, lex, datatype, detail) of typed literals whose text is no such value; from_quads() keeps them as literals."""
    rows = quad_rows.where("o.kind = 'literal'").select("doc_id", F.coalesce("graph", F.lit("")).alias("scope"), F.col("s.lex").alias("s"), "p", F.col("o.lex").alias("lex"), F.col("o.datatype").alias("datatype"))
    return rows.withColumn("detail", lexical_error(F.col("lex"), F.col("datatype"))).where("detail is not null")


def _slots() -> Column:
    """`kind property` -> column of a qualified node's formal property."""
    pairs = []
    for kind in RELATIONS:
        if kind in PLAIN:
            continue
        pairs += [f"{kind} {PROV}{INFLUENCER[kind]}", "arg2", f"{kind} {PROV}atTime", "t1"]
        for i, n in enumerate(argument_names(kind)):
            if i >= 2:
                pairs += [f"{kind} {PROV}{QUALIFIED_FORMAL.get(n, n)}", R.ARGS[i]]
    return F.create_map(*[F.lit(x) for kv in dict(zip(pairs[::2], pairs[1::2])).items() for x in kv])


def _as_records(rows: DataFrame, namespaces: DataFrame | None) -> DataFrame:
    if namespaces is None:
        known = F.array().cast("array<struct<prefix:string,uri:string>>")
    else:
        from .names import tables

        own = tables(namespaces).where("scope = ''").select("doc_id", "own")
        rows = rows.join(own, "doc_id", "left")
        known = F.coalesce("own", F.array().cast("array<struct<prefix:string,uri:string>>"))
    built_in = F.array(*[F.struct(F.lit(p).alias("prefix"), F.lit(u).alias("uri")) for p, u in (("prov", PROV), ("xsd", XSD))])

    def named(uri: Column) -> Column:
        inside = F.filter(F.concat(built_in, known), lambda n: F.startswith(uri, n["uri"]))
        best = F.get(F.reverse(F.sort_array(F.transform(inside, lambda n: F.struct(F.length(n["uri"]).alias("l"), n["prefix"].alias("prefix"), n["uri"].alias("uri"))))), 0)
        cut = F.regexp_extract(uri, r"([^/#]*)$", 1)
        made = V.let(best, lambda b: F.struct(uri.alias("uri"), F.coalesce(b["prefix"], F.lit("")).alias("prefix"), F.when(b.isNotNull(), F.substr(uri, b["l"] + 1)).otherwise(F.when(cut == "", uri).otherwise(cut)).alias("local")))
        return F.when(uri.isNotNull(), made).cast(V.NAME)

    back = {RDF + "type": PROV + "type", RDFS + "label": PROV + "label", PROV + "atLocation": PROV + "location", PROV + "hadRole": PROV + "role"}
    name_of = F.create_map(*[F.lit(x) for kv in back.items() for x in kv])

    def value_of(o: Column) -> Column:
        return V.let(plain_form(o["lex"], o["datatype"]), lambda lex: told(o, lex, o["datatype"]))

    def told(o: Column, lex: Column, dt: Column) -> Column:
        whole = dt.isin(XSD + "int", XSD + "long", XSD + "integer") & lex.rlike(r"^[+-]?[0-9]+$") & (F.replace(V.canonical_xsd(lex), F.lit("xsd:"), F.lit(XSD)) == dt)
        time = V.parse_datetime(lex)
        number = lex.try_cast("double")
        plain = F.when(o["kind"] == "iri", V.v_qname(named(lex))).when(o["lang"].isNotNull(), V.v_literal(lex, PROV + "InternationalizedString", o["lang"]))
        # from here on dt is given: null AND x would compute x, and casts that fail throw inside
        plain = plain.when(dt.isNull() | (dt == XSD + "string"), V.v_str(lex)).when(whole, V.v_int(lex)).when((dt == XSD + "boolean") & V.parse_boolean(lex).isNotNull(), V.v_bool(V.parse_boolean(lex)))
        plain = plain.when((dt == XSD + "dateTime") & time.isNotNull(), V.v_datetime(time)).when((dt == XSD + "double") & number.isNotNull(), V.v_float(number))
        decimal = F.when(dt == XSD + "decimal", F.coalesce(V.canonical_decimal(lex), lex)).otherwise(lex)
        other = F.struct(F.lit("literal").alias("kind"), lex.alias("lex"), dt.alias("datatype"), o["lang"].alias("lang"), F.concat_ws("|", dt, F.lit(""), decimal).alias("cmp"))
        return plain.otherwise(other).cast(V.VALUE)

    attrs = F.sort_array(F.transform("attrs", lambda a: F.struct(named(F.coalesce(name_of[a["p"]], a["p"])).alias("name"), value_of(a["o"]).alias("value"))))
    key = F.xxhash64("rtype", "id", *R.ARGS, *R.TIMES, F.to_json("attrs"))
    out = rows.select("doc_id", "scope", F.shiftrightunsigned(key, 1).alias("seq"), "rtype", named(F.col("id")).alias("id"), *[named(F.col(a)).alias(a) for a in R.ARGS], *[V.parse_datetime(F.col(t)).alias(t) for t in R.TIMES], attrs.cast(V.ATTRS).alias("attrs"))
    return out.select(*R.COLUMNS)
