"""A document as DOT text: nodes, relations, annotations, and a cluster for each bundle.

Drawing is a walk: a document's elements, its bundles (each its elements, then its
relations), and its relations. Numbers of nodes, points, annotations and clusters follow
that walk and are shared by all bundles. Here each thing that is drawn has its place in the
walk as a key, numbers are those of number_rows() by that key, and lines are put together by
key at last, for each cluster and then for each document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.catalog import ELEMENTS, KEYWORD, PROV, RELATIONS, ROLE_KIND, argument_names, time_names
from .names import scope_labels
from .numbering import number_rows
from .records import ARGS, TIMES
from .select import sorted_attributes
from .setops import all_bundles
from .unify import unify, violations

# Shapes and colours of the usual drawings. Elements that are declared, those that are only named, relations.
ELEMENT_STYLE = {
    "Entity": 'shape=oval, style=filled, fillcolor="#FFFC87", color="#808080"',
    "Activity": 'shape=box, style=filled, fillcolor="#9FB1FC", color="#0000FF"',
    "Agent": 'shape=house, style=filled, fillcolor="#FED37F"',
}
NAMED_SHAPE = {"Entity": "oval", "Activity": "box", "Agent": "house", "Bundle": "folder"}
RELATION_COLOR = {
    "Generation": ("darkgreen", "darkgreen"), "Usage": ("red4", "red"), "Attribution": ('"#FED37F"', None), "Association": ('"#FED37F"', None),
    "Delegation": ('"#FED37F"', None), "Influence": ("grey", None),
}
DIRECTIONS = ("BT", "TB", "LR", "RL")

_KEY = ["phase", "scope", "part", "seq", "rtype", "slot"]


def _style(rtype: str, label: bool = True, gray: str | None = None) -> str:
    color, font = RELATION_COLOR.get(rtype, (None, None))
    if gray:
        color, font = "gray", "dimgray"
    parts = [f'label="{KEYWORD[rtype]}"' if label else gray and f'label="{gray}"', 'fontsize="10.0"', color and f"color={color}", font and f"fontcolor={font}"]
    return ", ".join(p for p in parts if p)


def _map(pairs) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs for x in kv])


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def escape_html(text: Column) -> Column:
    for raw, shown in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(shown))
    return text


def value_label(v: Column) -> Column:
    """A value as drawings show it: texts, numbers and names as they are, literals in the textual notation."""
    return F.when(v["kind"] == "literal", V.provn_value(v)).when(v["kind"] == "bool", F.initcap(v["lex"])).otherwise(v["lex"])


def _table(attrs: Column) -> Column:
    """Attributes as rows of an HTML table, names and values linked to their uris."""
    link = lambda a: F.when(a["value"]["kind"].isin("qname", "iri"), F.concat(F.lit(' href="'), escape_html(a["value"]["cmp"]), F.lit('"'))).otherwise("")
    row = lambda a: F.concat(F.lit('    <TR>\n        <TD align="left" href="'), escape_html(a["name"]["uri"]), F.lit('">'), escape_html(V.name_text(a["name"])), F.lit('</TD>\n        <TD align="left"'), link(a), F.lit(">"), escape_html(value_label(a["value"])), F.lit("</TD>\n    </TR>"))
    return F.concat(F.lit('<<TABLE cellpadding="0" border="0">\n'), F.array_join(F.transform(attrs, row), "\n"), F.lit("\n    </TABLE>>"))


def _shown_attributes() -> Column:
    """Times, then the other attributes in order."""
    time = lambda kind, i: F.struct(V.prov(time_names(kind)[i]).alias("name"), V.v_datetime(F.col(TIMES[i])).alias("value"))
    times = None
    for kind in (*ELEMENTS, *RELATIONS):
        if time_names(kind):
            cells = F.array(*[time(kind, i) for i in range(len(time_names(kind)))])
            times = F.when(F.col("rtype") == kind, cells) if times is None else times.when(F.col("rtype") == kind, cells)
    none = F.array().cast(V.ATTRS)
    told = F.filter(F.coalesce(times.cast(V.ATTRS), none), lambda a: a["value"].isNotNull())
    return F.concat(told, sorted_attributes(F.col("attrs")).cast(V.ATTRS))


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    return number_rows(rows, _KEY, name, within=["doc_id"])


def lines(records: DataFrame, show_nary: bool = True, use_labels: bool = False, show_element_attributes: bool = True, show_relation_attributes: bool = True) -> DataFrame:
    """(doc_id, key columns, n, line): what is drawn, by its place in the walk. seq and kind tell records of a scope apart."""
    spoiled = violations(records).select("doc_id").distinct()
    merged = unify(records.join(spoiled, "doc_id", "left_anti")).unionByName(records.join(spoiled, "doc_id", "left_semi").select(*records.columns))
    is_element, inner = F.col("rtype").isin(*ELEMENTS), F.col("scope") != ""
    placed = merged.withColumn("phase", F.when(inner, 1).when(is_element, 0).otherwise(2)).withColumn("part", F.when(is_element, 0).otherwise(1)).withColumn("shown", _shown_attributes())
    elements, relations = placed.where(is_element).withColumn("slot", F.lit(0)), placed.where(~is_element)

    # the ends of relations: the first two always, the others where they are drawn
    pairs = [(f"{k} {i}", ROLE_KIND.get(n)) for k in RELATIONS for i, n in enumerate(argument_names(k))]
    role = _map([(p, kind) for p, kind in pairs if kind])
    ends = F.array(*[F.struct(F.lit(i).alias("slot"), F.col(a)["uri"].alias("uri"), V.name_text(F.col(a)).alias("text"), role[F.concat(F.col("rtype"), F.lit(f" {i}"))].alias("role")) for i, a in enumerate(ARGS)])
    wide = F.col("rtype").isin([k for k in RELATIONS if len(argument_names(k)) > 2]) & F.lit(show_nary)
    noted = (F.size("shown") > 0) & F.lit(show_relation_attributes)
    relations = relations.withColumn("wide", wide).withColumn("noted", noted).withColumn("centre", F.col("wide") | F.col("noted"))
    ends = relations.select("doc_id", "phase", "scope", "part", "seq", "rtype", F.explode(F.filter(ends, lambda e: (e["slot"] < 2) | (F.col("wide") & e["uri"].isNotNull()))).alias("e")).select("doc_id", *_KEY[:-1], "e.*")

    # nodes: elements, and uris that are used before any element has them
    key = F.struct(*_KEY)
    of_elements = elements.select("doc_id", *_KEY, F.col("id.uri").alias("uri"), V.name_text(F.col("id")).alias("text"), F.lit(True).alias("declared"), F.lit(None).cast("string").alias("role"), F.get(F.filter("attrs", lambda a: a["name"]["uri"] == PROV + "label"), 0)["value"]["lex"].alias("label"))
    of_ends = ends.where("uri is not null").select("doc_id", *_KEY, "uri", "text", F.lit(False).alias("declared"), "role", F.lit(None).cast("string").alias("label"))
    first = of_elements.unionByName(of_ends).groupBy("doc_id", "uri").agg(F.min_by(F.struct(*_KEY, "text", "declared", "role"), key).alias("f")).where("not f.declared")
    generic = first.select("doc_id", *[F.col(f"f.{c}").alias(c) for c in _KEY], "uri", "f.text", "f.declared", "f.role", F.lit(None).cast("string").alias("label"))
    nodes = _numbered(of_elements.unionByName(generic), "n")
    node = F.concat(F.lit("n"), F.col("n").cast("string"))
    plain = _quoted(F.col("text"))
    fancy = F.concat(F.lit("<"), escape_html(F.col("label")), F.lit('<br /><font color="#333333" point-size="10">'), escape_html(F.col("text")), F.lit("</font>>"))
    label = F.when(F.lit(use_labels) & (F.col("label") != F.col("text")), fancy).otherwise(plain)
    shape = F.concat(F.lit("shape="), F.coalesce(_map(NAMED_SHAPE.items())[F.col("role")], F.lit("oval")), F.lit(", style=filled, fillcolor=lightgray, color=dimgray"))
    style = F.when(F.col("declared"), _map(ELEMENT_STYLE.items())[F.col("rtype")]).otherwise(shape)
    out = nodes.select("doc_id", *_KEY, F.lit(0).alias("n"), F.concat(node, F.lit(" [label="), label, F.lit(", URL="), _quoted(F.col("uri")), F.lit(", "), style, F.lit("];")).alias("line"))

    # points: the middle of a relation that has one, and ends that are not named
    middles = relations.where("centre").select("doc_id", *_KEY[:-1], F.lit(-1).alias("slot"))
    points = _numbered(middles.unionByName(ends.where("uri is null").select("doc_id", *_KEY)), "b")
    point = F.concat(F.lit("b"), F.col("b").cast("string"))
    out = out.unionByName(points.select("doc_id", *_KEY, F.lit(0).alias("n"), F.concat(point, F.lit(' [label="", shape=point, color=gray];')).alias("line")))

    # what each end is drawn as: the latest node of its uri at that place, or its point
    at = ends.alias("e").join(nodes.select("doc_id", "uri", F.struct(*_KEY).alias("since"), node.alias("to")).alias("n"), ["doc_id", "uri"]).where(F.col("since") <= F.struct(*[F.col(f"e.{c}") for c in _KEY]))
    at = at.groupBy("doc_id", *[F.col(f"e.{c}").alias(c) for c in _KEY]).agg(F.max_by("to", "since").alias("to"))
    at = at.unionByName(points.where("slot >= 0").select("doc_id", *_KEY, point.alias("to")))
    one = ["doc_id", *_KEY[:-1]]
    tips = at.groupBy(*one).agg(F.sort_array(F.collect_list(F.struct("slot", "to"))).alias("tips"))
    drawn = relations.select(*one, "centre").join(tips, one).join(points.where("slot = -1").select(*one, point.alias("middle")), one, "left")
    tip = lambda i: F.get(F.filter("tips", lambda t: t["slot"] == i), 0)["to"]
    full, bare = _map((k, _style(k)) for k in RELATIONS), _map((k, _style(k, False)) for k in RELATIONS)
    grays = _map((f"{k} {i}", _style(k, False, n)) for k in RELATIONS for i, n in enumerate(argument_names(k)) if i > 1)
    edge = lambda a, b, s: F.concat(a, F.lit(" -> "), b, F.lit(" ["), s, F.lit("];"))
    more = F.transform(F.filter("tips", lambda t: t["slot"] > 1), lambda t: edge(F.col("middle"), t["to"], grays[F.concat_ws(" ", "rtype", t["slot"].cast("string"))]))
    through = F.concat(F.array(edge(tip(0), F.col("middle"), F.concat(F.lit("arrowhead=none, "), full[F.col("rtype")])), edge(F.col("middle"), tip(1), bare[F.col("rtype")])), more)
    every = F.when(F.col("centre"), through).otherwise(F.array(edge(tip(0), tip(1), full[F.col("rtype")])))
    edges = drawn.select(*one, F.lit(10).alias("slot"), F.posexplode(every).alias("n", "line"))
    out = out.unionByName(edges)

    # annotations, at an element's node or a relation's middle
    notes = elements.where((F.size("shown") > 0) & F.lit(show_element_attributes)).select("doc_id", *_KEY, "shown").unionByName(relations.where("noted").select("doc_id", *_KEY[:-1], F.lit(20).alias("slot"), "shown"))
    notes = _numbered(notes, "a")
    homes = nodes.where("declared").select(*one, node.alias("home")).unionByName(points.where("slot = -1").select(*one, point.alias("home")))
    ann = F.concat(F.lit("ann"), F.col("a").cast("string"))
    text = F.array(F.concat(ann, F.lit(" [label="), _table(F.col("shown")), F.lit(', shape=note, color=gray, fontcolor=black, fontsize="10"];')), F.concat(ann, F.lit(" -> "), "home", F.lit(" [arrowhead=none, style=dashed, color=gray];")))
    return out.unionByName(notes.join(homes, one).select("doc_id", *_KEY, F.posexplode(text).alias("i", "line")).select("doc_id", *_KEY, (F.col("i") + 1).alias("n"), "line"))


def dot_document(records: DataFrame, namespaces: DataFrame | None = None, bundles: DataFrame | None = None, show_nary: bool = True, use_labels: bool = False, direction: str = "BT", show_element_attributes: bool = True, show_relation_attributes: bool = True) -> DataFrame:
    """(doc_id, text): each document as a DOT graph.

    Records are unified first, but those of documents that can't be. A relation with more
    than two names in its kind (show_nary), or with attributes that are shown, goes through
    a point; an end that is not named is a point. Bundles are clusters, by uri, those of
    `bundles` (doc_id, scope) even without records. Another direction than BT, TB, LR or RL
    is taken as BT. For documents whose text fits a row; lines() has them line by line."""
    from .scratch import settle

    drawn = settle(lines(records, show_nary, use_labels, show_element_attributes, show_relation_attributes), "dot-lines")
    parts = drawn.groupBy("doc_id", "scope", "phase").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*_KEY[2:], "n", "line"))), lambda l: l["line"]), "\n").alias("body"))
    scopes = all_bundles(records, bundles)
    clusters = number_rows(scopes, ["scope"], "c", within=["doc_id"])
    clusters = scope_labels(clusters, namespaces).join(parts.where("phase = 1").select("doc_id", "scope", "body"), ["doc_id", "scope"], "left")
    cluster = F.concat(F.lit("subgraph cluster_c"), F.col("c").cast("string"), F.lit(" {\nURL="), _quoted(F.col("scope")), F.lit(";\nlabel="), _quoted(F.col("label")), F.lit(";\n"), F.coalesce(F.concat("body", F.lit("\n")), F.lit("")), F.lit("}"))
    pieces = parts.where("phase <> 1").select("doc_id", "phase", F.lit(0).cast("long").alias("c"), "body").unionByName(clusters.select("doc_id", F.lit(1).alias("phase"), "c", cluster.alias("body")))
    way = direction if direction in DIRECTIONS else "BT"
    joined = pieces.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("phase", "c", "body"))), lambda p: p["body"]), "\n").alias("body"))
    return joined.select("doc_id", F.concat(F.lit(f'digraph {{\nrankdir={way};\ncharset="utf-8";\n'), "body", F.lit("\n}")).alias("text"))
