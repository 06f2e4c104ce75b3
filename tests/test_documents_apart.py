"""Several documents in one DataFrame, names of bundles, and RDF texts with escapes or of mixed forms."""

import pytest
from pyspark.sql import functions as F

from tracewright.operators import names, setops, triples
from tracewright.sources import read, write
from tracewright.sources.parse_json import prov_json
from tracewright.sources.statements import flatten_documents, namespaces

ONE = '{"prefix": {"ex": "http://e/"}, "entity": {"ex:a": {}}, "bundle": {"ex:b1": {"entity": {"ex:c": {}}}}}'
TWO = '{"prefix": {"ex": "http://e/"}, "entity": {"ex:b": {}}}'
ENTITY = "<http://www.w3.org/ns/prov#Entity>"
TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"


def documents(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "doc_id string, text string")


def held(df):
    """The rows without the plan of the reader, which is long."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def test_swapped_documents_differ(spark):
    left = held(read.from_content(documents(spark, x=ONE, y=TWO), "json"))
    swap = F.when(F.col("doc_id") == "x", "y").otherwise("x")
    right = left.withColumn("doc_id", swap)
    assert setops.differences(left, right).count() == 6 and not setops.equal(left, right)
    assert setops.equal(left, left)


def test_prefixes_of_each_document(spark):
    uris = spark.createDataFrame([("x", "http://e/1"), ("y", "http://e/1"), ("z", "http://e/1")], "doc_id string, uri string")
    spaces = spark.createDataFrame([("x", "", 0, "ex", "http://e/"), ("y", "", 0, "other", "http://e/")], names.SCHEMA)
    got = {r.doc_id: r.ns_prefix for r in names.longest_match(uris, spaces).collect()}
    assert got == {"x": "ex", "y": "other", "z": None}


@pytest.mark.parametrize("format, shown", [("json", '"bundle": {"ex:b1": {'), ("xml", '<prov:bundleContent prov:id="ex:b1"')])
def test_bundles_are_written_by_name(spark, format, shown):
    texts = documents(spark, x=ONE)
    records, spaces = held(read.from_content(texts, "json")), held(namespaces(flatten_documents(texts, prov_json)))
    out = held(write.serialize(records, format, spaces))
    assert shown in out.first().text
    back = held(read.from_content(out, format))
    assert sorted((r.scope, r.id.uri) for r in back.collect()) == [("", "http://e/a"), ("http://e/b1", "http://e/c")]


def test_rdf_texts(spark):
    lines = "# a comment\n<http://e/a> <http://e/p> \"caf\\u00e9 \\\\u0041 \\\"q\\\" \\b\" .\n\n<http://e/x\\u0020y> <http://e/p> \"" + "long \\n" * 3000 + '" .'
    quads = {r.s.lex: r.o.lex for r in triples.read_nquads(documents(spark, x=lines).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))).collect()}
    assert quads == {"http://e/a": 'café \\u0041 "q" \b', "http://e/x y": "long \n" * 3000}
    back = triples.nquads(triples.read_nquads(triples.nquads(triples.read_nquads(documents(spark, x=lines.split("\n")[3]).withColumnRenamed("text", "line")))))
    assert "<http://e/x\\u0020y>" in back.first().line
    turtle = f"<http://e/a> a {ENTITY} ."
    mixed = f"<http://e/a> {TYPE} {ENTITY} .\n<http://e/b> a {ENTITY} .\n<http://e/c> a {ENTITY} ;\n <http://e/p> 5 ."
    got = read.from_content(documents(spark, t=turtle, m=mixed), "rdf")
    assert sorted((r.doc_id, r.id.uri) for r in got.collect()) == [("m", "http://e/a"), ("m", "http://e/b"), ("m", "http://e/c"), ("t", "http://e/a")]
    assert [r.doc_id for r in read.problems(documents(spark, t=turtle, bad="<http://e/a> a"), "rdf").collect()] == ["bad"]
