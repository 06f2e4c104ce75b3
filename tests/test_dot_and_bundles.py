"""Drawings and bundles of small documents."""

import json
import re

import pytest

from tracewright.functions import values as V
from tracewright.operators import dot, names, setops
from tracewright.operators import records as R
from tracewright.sources import read, write
from pyspark.sql import functions as F

SPACES = [("d", "", 0, "ex", "http://e/"), ("d", "", 1, "q", "http://q/")]


def n(local):
    return V.name("ex", "http://e/", local)


@pytest.fixture(scope="module")
def document(spark):
    one = spark.range(1)
    time = V.time_of(F.lit("2020-01-02 03:04:05").cast("timestamp_ntz"))
    parts = [
        R.entity(one, F.lit(0), n("e"), doc="d", attrs=[(V.prov("label"), V.v_str("An <e>")), (n("k"), V.v_bool(F.lit(True))), (V.prov("type"), V.v_qname(n("T")))]),
        R.agent(one, F.lit(1), n("g"), doc="d"),
        R.usage(one, F.lit(2), n("a"), n("e"), doc="d"),
        R.usage(one, F.lit(3), n("a"), doc="d"),
        R.delegation(one, F.lit(4), n("g"), n("boss"), n("a"), doc="d"),
        R.generation(one, F.lit(5), n("inner"), n("a"), time=time, doc="d"),
        R.entity(one, F.lit(0), n("inner"), doc="d", scope="http://e/b"),
        R.specialization(one, F.lit(1), n("inner"), n("e"), doc="d", scope="http://e/b"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def test_dot_document(spark, document):
    spaces = spark.createDataFrame(SPACES, names.SCHEMA)
    empty = spark.createDataFrame([("d", "http://q/none"), ("d", "http://e/b")], "doc_id string, scope string")
    text = dot.dot_document(document, spaces, empty).collect()[0].text
    lines = text.split("\n")
    assert lines[:3] == ["digraph {", "rankdir=BT;", 'charset="utf-8";'] and lines[-1] == "}"
    assert [x.split(" [")[0] for x in lines if re.match(r"(n|b|ann)\d+ \[", x)] == ["n1", "ann1", "n2", "n3", "n4", "b1", "b2", "n5", "b3", "ann2"]
    # e, g, the bundle's entity, then what relations name first
    assert 'n1 [label="ex:e", URL="http://e/e", shape=oval, style=filled, fillcolor="#FFFC87", color="#808080"];' in lines
    assert 'n4 [label="ex:a", URL="http://e/a", shape=box, style=filled, fillcolor=lightgray, color=dimgray];' in lines
    assert 'n5 [label="ex:boss", URL="http://e/boss", shape=house, style=filled, fillcolor=lightgray, color=dimgray];' in lines
    used = 'label="used", fontsize="10.0", color=red4, fontcolor=red'
    edges = [x for x in lines if "->" in x]
    assert edges == [
        "ann1 -> n1 [arrowhead=none, style=dashed, color=gray];",
        'n3 -> n1 [label="specializationOf", fontsize="10.0"];',
        f"n4 -> n1 [{used}];",
        f"n4 -> b1 [{used}];",
        'n2 -> b2 [arrowhead=none, label="actedOnBehalfOf", fontsize="10.0", color="#FED37F"];',
        'b2 -> n5 [fontsize="10.0", color="#FED37F"];',
        'b2 -> n4 [label="activity", fontsize="10.0", color=gray, fontcolor=dimgray];',
        'n3 -> b3 [arrowhead=none, label="wasGeneratedBy", fontsize="10.0", color=darkgreen, fontcolor=darkgreen];',
        'b3 -> n4 [fontsize="10.0", color=darkgreen, fontcolor=darkgreen];',
        "ann2 -> b3 [arrowhead=none, style=dashed, color=gray];",
    ]
    at = lines.index("subgraph cluster_c1 {")
    assert lines[at + 1 : at + 6] == ['URL="http://e/b";', 'label="ex:b";', 'n3 [label="ex:inner", URL="http://e/inner", shape=oval, style=filled, fillcolor="#FFFC87", color="#808080"];', 'n3 -> n1 [label="specializationOf", fontsize="10.0"];', "}"]
    assert lines[at + 6 : at + 10] == ["subgraph cluster_c2 {", 'URL="http://q/none";', 'label="q:none";', "}"]
    cells = re.findall(r'<TD align="left"[^>]*>(.*?)</TD>', text)
    assert cells == ["prov:label", "An &lt;e&gt;", "prov:type", "ex:T", "ex:k", "True", "prov:time", "2020-01-02T03:04:05"]


def test_dot_options(spark, document):
    text = dot.dot_document(document, None, None, show_nary=False, use_labels=True, direction="sideways", show_element_attributes=False, show_relation_attributes=False).collect()[0].text
    assert "rankdir=BT" in text and "ann" not in text and 'label=<An &lt;e&gt;<br /><font color="#333333" point-size="10">ex:e</font>>' in text
    assert 'n2 -> n5 [label="actedOnBehalfOf", fontsize="10.0", color="#FED37F"];' in text and text.count("shape=point") == 1


def test_empty_bundles_are_seen_and_written(spark, document):
    spaces = spark.createDataFrame(SPACES, names.SCHEMA)
    empty = spark.createDataFrame([("d", "http://q/none")], "doc_id string, scope string")
    assert setops.equal(document, document) and setops.equal(document, document, empty, empty)
    assert not setops.equal(document, document, empty)
    assert [tuple(r) for r in setops.bundle_differences(document, document, None, empty).collect()] == [("d", "http://q/none", "right")]
    other = document.withColumn("doc_id", F.lit("x"))
    assert not setops.equal(document, other) and setops.equal(document, other, by_name=False)
    for format in ("json", "jsonld", "xml"):
        texts = write.serialize(document, format, spaces, empty)
        found = {tuple(r) for r in read.bundles_of(texts, format).collect()}
        assert found == {("d", "http://e/b"), ("d", "http://q/none")}
    text = write.serialize(document, "provn", spaces, empty).collect()[0].text
    assert "  bundle ex:b\n    entity(ex:inner)" in text and "  bundle q:none\n  endBundle" in text
    trig = spark.createDataFrame([("d", "@prefix ex: <http://e/> . ex:g { } ex:h { ex:a a ex:b . }")], "doc_id string, text string")
    assert {r.scope for r in read.bundles_of(trig, "rdf").collect()} == {"http://e/g", "http://e/h"}


def test_context_and_types(spark, document):
    texts = write.serialize(document.where("scope = ''"), "jsonld", spark.createDataFrame(SPACES, names.SCHEMA), context="embed")
    context = json.loads(texts.collect()[0].text)["@context"]
    assert context[1]["Usage"]["@context"]["time"]["@type"] == "xsd:dateTime" and not any(isinstance(c, str) for c in context)
    back = read.from_content(texts, "jsonld")
    assert setops.equal(back, document.where("scope = ''"))
    with pytest.raises(ValueError):
        write.serialize(document, "jsonld", context="none")
    forced = write.serialize(document, "xml", spark.createDataFrame(SPACES, names.SCHEMA), force_types=True)
    assert '<prov:label xsi:type="xsd:string">' in forced.collect()[0].text and setops.equal(read.from_content(forced, "xml"), document)
