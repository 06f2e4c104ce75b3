"""From parsed documents to records: what all readers share.

A reader turns the text of a document into rows of one flat schema with a small parser
per format: name bindings, and one row for each attribute of each statement, with names
still as written. Everything after that is DataFrame code: names are resolved against
the bindings of the scope and its document, values are typed, formal attributes are told
from others, and the rows of a statement are grouped into a record.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.catalog import ELEMENTS, KINDS, PROV, XSD, argument_names, time_names
from ..operators import records as R
from ..operators.names import resolve, tables
from ..operators.triples import lexical_error

#: what: binding (attr is the prefix, lex the uri), bundle (scope is its name), attribute, statement (one without attributes) or error (lex the message).
FLAT = "doc_id string, scope string, seq bigint, what string, rtype string, id string, attr string, pos bigint, form string, lex string, datatype string, lang string"
_FIELDS = [c.split()[0] for c in FLAT.split(", ")]

#: Rows of a document that a Python worker turns into a data frame at a time.
PART = 10_000

_FORMAL_NAMES = sorted({a for _, formals in KINDS.values() for a in formals})
_TIME_NAMES = ("time", "startTime", "endTime")


def parts(rows: list) -> Iterator[list]:
    """The rows of a document by PART, so that no data frame has all rows of a long one."""
    return (rows[i : i + PART] for i in range(0, len(rows), PART))


class Row(dict):
    """A row of the flat schema; what is not given is null."""


def flatten_documents(documents: DataFrame, parse: Callable[[str], Iterator[dict]], text_col: str = "text") -> DataFrame:
    """Flat rows of documents (doc_id, text). A text that cannot be parsed gives one row with what = error."""

    def run(batches):
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch[text_col]):
                try:
                    rows = list(parse(text or ""))
                except Exception as error:  # any defect of one document is told in its row
                    rows = [{"what": "error", "lex": f"{type(error).__name__}: {error}"}]
                for some in parts(rows):
                    yield pd.DataFrame([{f: r.get(f) for f in _FIELDS} | {"doc_id": doc_id, "scope": r.get("scope") or ""} for r in some], columns=_FIELDS, dtype=object)

    return documents.select("doc_id", text_col).mapInPandas(run, FLAT)


def errors(flat: DataFrame) -> DataFrame:
    """(doc_id, error) of documents that could not be read."""
    return flat.where("what = 'error'").select("doc_id", F.col("lex").alias("error"))


def bindings(flat: DataFrame) -> DataFrame:
    """The namespaces of the documents; scopes as written."""
    return flat.where("what = 'binding'").select("doc_id", "scope", F.col("pos").alias("seq"), F.col("attr").alias("prefix"), F.col("lex").alias("uri"))


def namespaces(flat: DataFrame) -> DataFrame:
    """bindings() with the scopes of records: a bundle's uri for its name."""
    own = bindings(flat)
    document = tables(own).where("scope = ''").select("doc_id", F.col("own").alias("doc_ns"))
    return own.join(document, "doc_id", "left").select("doc_id", _scope_uri().alias("scope"), "seq", "prefix", "uri")


def bundles(flat: DataFrame) -> DataFrame:
    """(doc_id, scope): the bundles of the documents by uri, those without statements, too."""
    document = tables(bindings(flat)).where("scope = ''").select("doc_id", F.col("own").alias("doc_ns"))
    named = flat.where("what = 'bundle'").select("doc_id", "scope").join(document, "doc_id", "left")
    return named.select("doc_id", _scope_uri().alias("scope")).distinct()


def _scope_uri() -> Column:
    return F.when(F.col("scope") == "", F.lit("")).otherwise(F.coalesce(resolve(F.col("scope"), F.col("doc_ns"))["uri"], F.col("scope")))


def to_records(flat: DataFrame) -> DataFrame:
    """Records of flat rows. A formal name that cannot be resolved and a formal time that
    cannot be parsed are left out; a statement of an element whose identifier cannot be
    resolved has no record and is listed by unresolved()."""
    return _grouped(_resolved(flat)).select(*R.COLUMNS)


def unresolved(flat: DataFrame) -> DataFrame:
    """(doc_id, scope, seq, text) of names that no binding explains: attribute names and elements' identifiers."""
    one = _resolved(flat)
    bad = F.when(F.col("attr").isNotNull() & F.col("name").isNull(), F.col("attr")).when(F.col("rtype").isin(*ELEMENTS) & F.col("rid").isNull(), F.col("id"))
    return one.select("doc_id", "scope", "seq", bad.alias("text")).where("text is not null").distinct()


def violations(flat: DataFrame) -> DataFrame:
    """(doc_id, scope, seq, kind, detail): what to_records() leaves out or takes as something
    else. Kinds: text (unreadable), identifier (an element without one), name (an identifier of an
    element, an attribute, or a formal value that no namespace explains), time (a formal time
    that is none), value (a typed number, truth value or time that is none, kept as a
    literal), repeated (a formal attribute with several values, of which the first stays)."""
    texts = flat.where("what = 'error'").select("doc_id", "scope", "seq", F.lit("text").alias("kind"), F.col("lex").alias("detail"))
    rows = _resolved(flat)
    element = F.col("rtype").isin(*ELEMENTS)
    local = F.when(F.startswith(F.col("name.uri"), F.lit(PROV)), F.substr(F.col("name.uri"), F.lit(len(PROV) + 1)))
    formal, is_time = local.isin(*_FORMAL_NAMES), local.isin(*_TIME_NAMES)
    attribute, dt = F.col("what") == "attribute", F.col("type.uri")
    told = lambda kind, detail: F.struct(F.lit(kind).alias("kind"), detail.alias("detail"))
    checks = [
        F.when((F.col("what") == "statement") & element & F.col("id").isNull(), told("identifier", F.col("rtype"))),
        F.when((F.col("what") == "statement") & element & F.col("id").isNotNull() & F.col("rid").isNull(), told("name", F.col("id"))),
        F.when(attribute & F.col("name").isNull(), told("name", F.col("attr"))),
        F.when(attribute & formal & ~is_time & F.col("ref").isNull(), told("name", F.col("lex"))),
        F.when(attribute & is_time & V.parse_datetime(F.col("lex")).isNull(), told("time", F.col("lex"))),
        F.when(attribute & (F.col("form") == "typed") & ~F.coalesce(formal, F.lit(False)), told("value", F.when(lexical_error(F.col("lex"), dt).isNotNull(), F.col("lex")))),
    ]
    single = rows.select("doc_id", "scope", "seq", F.explode(F.filter(F.array(*checks), lambda c: c["detail"].isNotNull())).alias("c")).select("doc_id", "scope", "seq", "c.*")
    repeated = rows.where(attribute & formal).groupBy("doc_id", "scope", "seq", local.alias("detail")).agg(F.count_distinct(F.coalesce("ref.uri", "lex")).alias("n")).where("n > 1")
    return texts.unionByName(single).unionByName(repeated.select("doc_id", "scope", "seq", F.lit("repeated").alias("kind"), "detail"))


def _resolved(flat: DataFrame) -> DataFrame:
    spaces = tables(bindings(flat))
    own = spaces.withColumnRenamed("own", "own_ns")
    document = spaces.where("scope = ''").select("doc_id", F.col("own").alias("doc_ns"))
    rows = flat.where("what in ('attribute', 'statement')").join(own, ["doc_id", "scope"], "left").join(document, "doc_id", "left")
    known = lambda text: resolve(text, F.col("own_ns"), F.col("doc_ns"))
    rows = rows.withColumn("rid", known(F.col("id"))).withColumn("name", known(F.col("attr")))
    rows = rows.withColumn("type", known(F.col("datatype"))).withColumn("ref", known(F.col("lex")))
    return rows.withColumn("scope", _scope_uri())


def typed_value() -> Column:
    """The value of a flat row: plain JSON forms as they are, typed text by its datatype
    where that loses nothing, names where their prefix is known, else a literal."""
    lex, form, dt = F.col("lex"), F.col("form"), F.col("type.uri")
    plain = F.col("lang").isNull() | (F.col("lang") == "")
    whole = dt.isin(XSD + "int", XSD + "long", XSD + "integer") & lex.rlike(r"^\s*[+-]?[0-9]+\s*$") & (F.replace(V.canonical_xsd(lex), F.lit("xsd:"), F.lit(XSD)) == dt)
    decimal = F.when(dt == XSD + "decimal", F.coalesce(V.canonical_decimal(lex), lex)).otherwise(lex)
    datatype = F.when(~plain, F.lit(PROV + "InternationalizedString")).otherwise(dt)
    literal = F.struct(F.lit("literal").alias("kind"), lex.alias("lex"), datatype.alias("datatype"), F.col("lang").alias("lang"), F.concat_ws("|", F.coalesce(datatype, F.lit("")), F.coalesce(F.lower("lang"), F.lit("")), decimal).alias("cmp"))
    out = F.when(form == "ref", F.coalesce(V.v_qname(F.col("ref")), V.v_str(lex)))
    out = out.when((form == "str") & plain, V.v_str(lex)).when(form == "int", V.v_int(lex)).when(form == "float", V.v_float(lex.try_cast("double"))).when(form == "bool", V.v_bool(lex == "true"))
    out = out.when(plain & (dt == XSD + "anyURI"), V.v_iri(lex)).when(plain & dt.isin(XSD + "QName", PROV + "QUALIFIED_NAME") & F.col("ref").isNotNull(), V.v_qname(F.col("ref")))
    out = out.when(plain & (dt == XSD + "string"), V.v_str(lex)).when(plain & whole, V.v_int(F.trim(lex)))
    # null where the text is no such value
    typed = F.when(dt == XSD + "boolean", V.v_bool(V.parse_boolean(lex))).when(dt == XSD + "dateTime", V.v_datetime(V.parse_datetime(lex))).when(dt == XSD + "double", V.v_float(lex.try_cast("double")))
    return F.coalesce(out, F.when(plain, typed), literal).cast(V.VALUE)


def _grouped(rows: DataFrame) -> DataFrame:
    local = F.when(F.startswith(F.col("name.uri"), F.lit(PROV)), F.substr(F.col("name.uri"), F.lit(len(PROV) + 1)))
    formal = F.when(local.isin(*_FORMAL_NAMES), local)
    rows = rows.withColumn("formal", formal).withColumn("time", F.when(formal.isin(*_TIME_NAMES), V.parse_datetime(F.col("lex")))).withColumn("value", typed_value())
    places = F.create_map(*[F.lit(x) for kind in KINDS for i, n in enumerate(argument_names(kind)) for x in (f"{kind} {n}", R.ARGS[i])])
    slots = F.create_map(*[F.lit(x) for kind in KINDS for i, n in enumerate(time_names(kind)) for x in (f"{kind} {n}", R.TIMES[i])])
    key = F.concat_ws(" ", "rtype", "formal")
    rows = rows.withColumn("slot", F.coalesce(places[key], slots[key]))
    args = [F.min_by(F.when(F.col("slot") == a, F.col("ref")), F.when((F.col("slot") == a) & F.col("ref").isNotNull(), F.col("pos"))).alias(a) for a in R.ARGS]
    times = [F.min_by(F.when(F.col("slot") == t, F.col("time")), F.when((F.col("slot") == t) & F.col("time").isNotNull(), F.col("pos"))).alias(t) for t in R.TIMES]
    # a formal name of another kind is an attribute that holds a name or a time
    value = F.when(F.col("formal").isin(*_TIME_NAMES), V.v_datetime(F.col("time"))).when(F.col("formal").isNotNull(), V.v_qname(F.col("ref"))).otherwise(F.col("value"))
    extra = F.when((F.col("what") == "attribute") & F.col("slot").isNull() & F.col("name").isNotNull() & value.isNotNull(), F.struct(F.col("pos"), F.struct(F.col("name"), value.alias("value")).alias("a")))
    one = rows.groupBy("doc_id", "scope", "seq", "rtype").agg(F.min_by("rid", "pos").alias("id"), *args, *times, F.transform(F.array_sort(F.collect_list(extra), lambda x, y: F.when(x["pos"] < y["pos"], -1).when(x["pos"] > y["pos"], 1).otherwise(0)), lambda s: s["a"]).alias("attrs"))
    one = one.where(~F.col("rtype").isin(*ELEMENTS) | F.col("id").isNotNull())
    return one.withColumn("attrs", V.distinct_attributes(F.col("attrs").cast(V.ATTRS)))


def texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(doc_id, text): each file as one document, named by its path."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))
