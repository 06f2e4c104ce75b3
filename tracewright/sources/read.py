"""Reading documents: by format, or by the first format that gives a record."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ProvenanceError
from ..operators import triples
from ..operators.records import COLUMNS
from ..operators.scratch import settle
from . import statements
from .parse_json import prov_json, prov_jsonld
from .parse_turtle import graph_names, read_through, terms
from .parse_xml import prov_xml


class UnknownFormat(ProvenanceError):
    """No reader or writer of that name."""


#: Formats whose parsers give flat rows, in the order in which they are tried.
PARSERS: dict[str, Callable[[str], Iterator[dict]]] = {"json": prov_json, "xml": prov_xml, "jsonld": prov_jsonld}
FORMATS = ("json", "rdf", "provn", "xml", "jsonld")

_PARTS = ("kind", "lex", "datatype", "lang")
_FLAT_QUADS = ["doc_id", "graph", *[f"s_{x}" for x in _PARTS], "p", *[f"o_{x}" for x in _PARTS]]


def register(name: str, parse: Callable[[str], Iterator[dict]]) -> None:
    """Add a format: parse gives flat rows (see statements.FLAT) of a text."""
    PARSERS[name] = parse


def _any(text: str) -> Iterator[dict]:
    for name, parse in PARSERS.items():
        try:
            rows = list(parse(text))
        except Exception:  # another format may fit
            continue
        if any(r["what"] in ("statement", "bundle") for r in rows):
            return iter(rows)
    raise ValueError("no format fits")


#: Characters of a text up to which its rows leave Python only when all of it has been read.
WHOLE = 4 << 20


def _turtle_rows(text: str) -> Iterator[tuple]:
    """Rows (what, *_FLAT_QUADS without the first) of a text; a long one that cannot be read ends with one of what = error."""
    none = (None,) * 4
    made = ((what, q[0], *q[1], q[2], *q[3]) if what == "quad" else (what, str(q[0]), *none, q[1], None, q[2], None, None) for what, q in read_through(text))
    try:
        yield from made if len(text) > WHOLE else list(made)
    except Exception:  # a text that is no such gives no rows
        if len(text) > WHOLE:
            yield ("error", *none, *none, None, None)


def _settled(documents: DataFrame, text_col: str) -> DataFrame:
    """(doc_id, what, graph, s, p, o): quads and prefixes of texts, each read once and written."""
    import pyarrow as pa

    names = [*_FLAT_QUADS[:1], "part", "what", *_FLAT_QUADS[1:]]

    def run(batches):
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                part, rows = uuid.uuid4().hex, _turtle_rows(text or "")
                while some := list(itertools.islice(rows, statements.PART)):
                    own = [[doc_id] * len(some), [part] * len(some)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in [*own, *zip(*some)]], names=names)

    # N-Quads splits by lines, without Python, if every line is one
    each = F.forall(F.split(text_col, "\n"), lambda l: l.rlike(r"^\s*(#.*)?$") | l.rlike(triples.NQUAD))
    documents = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(each & ~F.contains(F.col(text_col), F.lit("\\U")), F.lit(False)).alias("flat"))
    none = F.lit(None).cast("string")
    split = triples.read_nquads(documents.where("flat").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))).select("doc_id", none.alias("part"), F.lit("quad").alias("what"), "graph", "s", "p", "o")
    parsed = documents.where("not flat").select("doc_id", "text").mapInArrow(run, ", ".join(f"{c} string" for c in names))
    term = lambda c: F.struct(*[F.col(f"{c}_{x}").alias(x) for x in _PARTS]).alias(c)
    rows = settle(split.unionByName(parsed.select("doc_id", "part", "what", "graph", term("s"), "p", term("o"))), "quads")
    # only long texts have such rows, so these are few
    bad = rows.where("what = 'error'").select("part")
    return rows.join(F.broadcast(bad), "part", "left_anti").drop("part")


def _quads(rows: DataFrame) -> DataFrame:
    return rows.where("what = 'quad'").drop("what")


def _prefixes(rows: DataFrame) -> DataFrame:
    return rows.where("what = 'prefix'").select("doc_id", F.lit("").alias("scope"), F.col("graph").cast("long").alias("seq"), F.col("p").alias("prefix"), F.col("o.lex").alias("uri"))


def quads_of(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """Quads (doc_id, graph, s, p, o) of Turtle, TriG, N-Triples or N-Quads texts; none of a text that is no such."""
    return _quads(_settled(documents, text_col))


def prefixes_of(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """namespaces (doc_id, scope, seq, prefix, uri) that Turtle texts declare."""
    return _prefixes(_settled(documents, text_col))


def bundles_of(documents: DataFrame, format: str | None = None, text_col: str = "text") -> DataFrame:
    """(doc_id, scope): the bundles of documents (doc_id, text), those without statements, too."""
    name = format and format.lower()
    if name != "rdf":
        flat = statements.flatten_documents(documents, PARSERS[name] if name else _any, text_col)
        found = statements.bundles(flat)
        if name:
            return found
        documents = documents.join(statements.errors(flat).select("doc_id"), "doc_id", "left_semi")

    def graphs(text: str) -> Iterator[dict]:
        return ({"what": "bundle", "scope": g} for g in graph_names(text))

    named = statements.flatten_documents(documents, graphs, text_col).where("what = 'bundle'").select("doc_id", "scope").distinct()
    return named if name else found.unionByName(named)


def from_content(documents: DataFrame, format: str | None = None, text_col: str = "text") -> DataFrame:
    """Records of documents (doc_id, text). Without a format each text is read by the first
    one that gives a statement. Texts that cannot be read give no records; see
    problems()."""
    name = format and format.lower()
    if name == "provn":
        raise NotImplementedError("the textual notation is written, not read")
    if name is not None and name != "rdf" and name not in PARSERS:
        raise UnknownFormat(name)
    if name == "rdf":
        # quads are joined with each other in several ways: texts are parsed once
        rows = _settled(documents, text_col)
        return triples.from_quads(_quads(rows), _prefixes(rows))
    flat = statements.flatten_documents(documents, PARSERS[name] if name else _any, text_col)
    if name:
        return statements.to_records(flat)
    flat = settle(flat, "flat")
    out = statements.to_records(flat)
    other = documents.join(statements.errors(flat).select("doc_id"), "doc_id", "left_semi")
    return out.unionByName(from_content(other, "rdf", text_col).select(*COLUMNS))


def problems(documents: DataFrame, format: str | None = None, text_col: str = "text") -> DataFrame:
    """(doc_id, error) of texts that the format's parser refuses, or names that nothing explains."""
    if format and format.lower() == "rdf":

        def check(text: str) -> Iterator[dict]:
            list(terms(text))
            return iter(())

        return statements.errors(statements.flatten_documents(documents, check, text_col))
    flat = statements.flatten_documents(documents, PARSERS[format.lower()] if format else _any, text_col)
    return statements.errors(flat).unionByName(statements.unresolved(flat).select("doc_id", F.concat(F.lit("unknown name "), "text").alias("error")))


def read(spark: SparkSession, paths: str | list[str], format: str | None = None) -> DataFrame:
    """Records of the files at paths, one document each, named by its path."""
    return from_content(statements.texts(spark, paths), format)
