"""Records as a graph of elements, and its text for drawing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.catalog import KEYWORD, RELATIONS, ROLE_KIND, argument_names
from .records import COLUMNS
from .select import elements, relations
from .unify import unify


def _ends(own: DataFrame) -> DataFrame:
    ends = relations(own).where("arg1 is not null and arg2 is not null")
    return ends.select("doc_id", "seq", "rtype", F.col("id.uri").alias("id"), F.col("arg1.uri").alias("src"), F.col("arg2.uri").alias("dst"))


#: Relations whose first two roles do not tell the kind of an undeclared element.
VAGUE = [k for k in RELATIONS if not all(r in ROLE_KIND for r in argument_names(k)[:2])]


def edges(records: DataFrame, merged: bool = True) -> DataFrame:
    """(doc_id, seq, rtype, id, src, dst): relations of the document itself with both
    first names. merged: identified records are unified first. Parallel edges stay. A
    relation whose roles tell no kind is left out unless both ends are declared or are
    named by an earlier relation whose roles do."""
    own = records.where("scope = ''")
    own = unify(own) if merged else own
    ends = _ends(own)
    clear = ends.where(~F.col("rtype").isin(VAGUE))
    return clear.unionByName(_explained(own, ends.where(F.col("rtype").isin(VAGUE))))


def _explained(own: DataFrame, rest: DataFrame) -> DataFrame:
    """The relations `rest` (doc_id, seq, src, dst and more) whose ends are declared in own, or
    named by an earlier relation whose roles tell a kind. Only names that rest has are looked up."""
    known = elements(own).select("doc_id", F.col("id.uri").alias("uri"), F.lit(-1).cast("long").alias("since"))
    clear = _ends(own).where(~F.col("rtype").isin(VAGUE))
    named = clear.select("doc_id", F.explode(F.array("src", "dst")).alias("uri"), F.col("seq").alias("since"))
    asked = rest.select("doc_id", F.explode(F.array("src", "dst")).alias("uri")).distinct()
    since = known.unionByName(named).join(asked, ["doc_id", "uri"], "left_semi").groupBy("doc_id", "uri").agg(F.min("since").alias("since"))
    for side in ("src", "dst"):
        rest = rest.join(since.withColumnRenamed("uri", side), ["doc_id", side]).where("since < seq").drop("since")
    return rest


def nodes(records: DataFrame, merged: bool = True) -> DataFrame:
    """(doc_id, uri, rtype, inferred): elements of the document itself and those that edges
    name without a declaration. The kind of such a one follows from its role at its first edge."""
    own = records.where("scope = ''")
    own = unify(own) if merged else own
    known = elements(own).select("doc_id", F.col("id.uri").alias("uri"), "rtype", F.lit(False).alias("inferred"))
    return known.unionByName(_inferred(own, known))


def _inferred(own: DataFrame, known: DataFrame) -> DataFrame:
    role = {(k, i): ROLE_KIND.get(argument_names(k)[i]) for k in RELATIONS for i in (0, 1)}
    table = F.create_map(*[F.lit(x) for (k, i), kind in role.items() if kind for x in (f"{k}{i}", kind)])
    ends = _ends(own).where(~F.col("rtype").isin(VAGUE))
    each = ends.select("doc_id", F.inline(F.array(*[F.struct(F.col(c).alias("uri"), table[F.concat("rtype", F.lit(str(i)))].alias("rtype"), F.struct("seq", F.lit(i).alias("i")).alias("at")) for i, c in enumerate(("src", "dst"))])))
    unknown = each.where("rtype is not null").join(known.select("doc_id", "uri"), ["doc_id", "uri"], "left_anti")
    return unknown.groupBy("doc_id", "uri").agg(F.min_by("rtype", "at").alias("rtype")).select("doc_id", "uri", "rtype", F.lit(True).alias("inferred"))


def to_records(records: DataFrame) -> DataFrame:
    """The records that the graph of a document stands for: unified elements and the relations that became edges."""
    own = unify(records.where("scope = ''"))
    rel = relations(own).where("arg1 is not null and arg2 is not null").withColumn("src", F.col("arg1.uri")).withColumn("dst", F.col("arg2.uri"))
    # a relation whose roles tell a kind is an edge by itself: only the others are looked up
    vague = _explained(own, rel.where(F.col("rtype").isin(VAGUE)))
    return elements(own).select(*COLUMNS).unionByName(rel.where(~F.col("rtype").isin(VAGUE)).select(*COLUMNS)).unionByName(vague.select(*COLUMNS))


# Shape and colour of each kind in the usual drawings.
NODE_STYLE = {"Entity": ("oval", "#FFFC87"), "Activity": ("box", "#9FB1FC"), "Agent": ("house", "#FED37F"), "Bundle": ("folder", "aliceblue")}


def dot_nodes(records: DataFrame) -> DataFrame:
    """(doc_id, uri, line): a DOT line for each node of the graph."""
    style = F.create_map(*[F.lit(x) for k, (shape, color) in NODE_STYLE.items() for x in (k, f"shape={shape}, style=filled, fillcolor=\"{color}\"")])
    label = F.replace(F.replace("uri", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    every = nodes(records)
    return every.select("doc_id", "uri", F.concat(F.lit('"'), label, F.lit('" ['), style[F.col("rtype")], F.when(F.col("inferred"), ", style=dashed").otherwise(""), F.lit("];")).alias("line"))


def dot_edges(records: DataFrame) -> DataFrame:
    """(doc_id, seq, rtype, src, dst, label): binary edges with the keyword as label."""
    words = F.create_map(*[F.lit(x) for k in RELATIONS for x in (k, KEYWORD[k])])
    return edges(records).select("doc_id", "seq", "rtype", "src", "dst", words[F.col("rtype")].alias("label"))


def dot_nary(records: DataFrame) -> DataFrame:
    """(doc_id, seq, rtype, part, head, tail): relations with three names or more as segments
    through a blank node: the first name to it, from it the second, and the others."""
    own = relations(unify(records.where("scope = ''"))).where("arg1 is not null and arg2 is not null and (arg3 is not null or arg4 is not null or arg5 is not null)")
    blank = F.concat(F.lit("b"), F.col("seq").cast("string"))
    parts = [F.struct(F.lit(0).alias("part"), F.col("arg1.uri").alias("head"), blank.alias("tail"))]
    parts += [F.struct(F.lit(i).alias("part"), blank.alias("head"), F.col(f"arg{i + 1}.uri").alias("tail")) for i in range(1, 5)]
    return own.select("doc_id", "seq", "rtype", F.inline(F.array(*parts))).where("tail is not null")


__all__ = ["dot_edges", "dot_nary", "dot_nodes", "edges", "nodes", "to_records"]
