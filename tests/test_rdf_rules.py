"""How quads are read: nodes and binary properties, repeated properties, typed texts, own properties."""

from tracewright.functions.catalog import PROV, XSD
from tracewright.operators import render, triples
from tracewright.sources.read import from_content

HEAD = f"@prefix prov: <{PROV}> .\n@prefix ex: <http://e/> .\n@prefix xsd: <{XSD}> .\n"


def texts(spark, turtle, **more):
    from tracewright.sources import read

    docs = spark.createDataFrame([("d", HEAD + turtle)], "doc_id string, text string")
    records = triples.from_quads(read.quads_of(docs), read.prefixes_of(docs), **more)
    return sorted(r.t for r in records.select(render.record_text(records).alias("t")).collect())


def quads(spark, turtle):
    from tracewright.sources import read

    return read.quads_of(spark.createDataFrame([("d", HEAD + turtle)], "doc_id string, text string"))


CASES = [
    # each binary property finds the node that names the same thing
    ("""ex:d prov:actedOnBehalfOf ex:r1, ex:r2 ; prov:qualifiedDelegation
          [a prov:Delegation ; prov:agent ex:r1 ; prov:hadActivity ex:a1], [a prov:Delegation ; prov:agent ex:r2 ; prov:hadActivity ex:a2] .""",
     ["actedOnBehalfOf(ex:d, ex:r1, ex:a1)", "actedOnBehalfOf(ex:d, ex:r2, ex:a2)"]),
    # a node that names nothing is completed
    ("""ex:d prov:actedOnBehalfOf ex:r1 ; prov:qualifiedDelegation [a prov:Delegation ; prov:hadActivity ex:a1] .""", ["actedOnBehalfOf(ex:d, ex:r1, ex:a1)"]),
    ("""ex:e prov:wasGeneratedBy ex:a ; prov:qualifiedGeneration [a prov:Generation ; prov:atTime "2020-01-01T00:00:00"^^xsd:dateTime] .""", ["wasGeneratedBy(ex:e, ex:a, 2020-01-01T00:00:00)"]),
    # the last of several such nodes; the one that names another thing stays apart
    ("""ex:e prov:wasAttributedTo ex:g, ex:h ; prov:qualifiedAttribution ex:n1, ex:n2, ex:n3 .
        ex:n1 a prov:Attribution ; prov:hadRole "r1" . ex:n2 a prov:Attribution ; prov:hadRole "r2" . ex:n3 a prov:Attribution ; prov:agent ex:g .""",
     ["wasAttributedTo(ex:n1; ex:e, -, [prov:role=\"r1\"])", "wasAttributedTo(ex:n2; ex:e, ex:h, [prov:role=\"r2\"])", "wasAttributedTo(ex:n3; ex:e, ex:g)"]),
    # no node of that kind
    ("""ex:e prov:wasAttributedTo ex:g ; prov:qualifiedGeneration [a prov:Generation ; prov:activity ex:a] .""", ["wasAttributedTo(ex:e, ex:g)", "wasGeneratedBy(ex:e, ex:a, -)"]),
]


def test_binary_property_and_its_node(spark):
    from tracewright.sources import read

    docs = spark.createDataFrame([(str(i), HEAD + turtle) for i, (turtle, _) in enumerate(CASES)], "doc_id string, text string")
    records = triples.from_quads(read.quads_of(docs), read.prefixes_of(docs))
    found = records.select("doc_id", render.record_text(records).alias("t")).collect()
    for i, (_, want) in enumerate(CASES):
        assert sorted(r.t for r in found if r.doc_id == str(i)) == sorted(want)


def test_repeated_properties(spark):
    turtle = """ex:e prov:qualifiedGeneration ex:n, ex:m, [a prov:Generation ; prov:activity ex:a, ex:b ; prov:atTime "2020-01-01T00:00:00"^^xsd:dateTime, "2021-01-01T00:00:00"^^xsd:dateTime] .
      ex:n a prov:Generation ; prov:activity ex:a ; prov:atTime "2020-01-01T00:00:00"^^xsd:dateTime, "2021-01-01T00:00:00"^^xsd:dateTime .
      ex:m a prov:Generation ; prov:activity ex:c, ex:d .
      ex:x prov:qualifiedDelegation ex:o . ex:o a prov:Delegation ; prov:agent ex:p, ex:q .
      ex:act a prov:Activity ; prov:startedAtTime "2020-01-01T00:00:00"^^xsd:dateTime, "2020-01-02T00:00:00"^^xsd:dateTime ; prov:endedAtTime "2020-01-03T00:00:00"^^xsd:dateTime ."""
    product = [f"wasGeneratedBy(ex:e, ex:{a}, {y}-01-01T00:00:00)" for a in "ab" for y in (2020, 2021)]
    assert texts(spark, turtle) == sorted([*product, "wasGeneratedBy(ex:m; ex:e, ex:c, -)", "wasGeneratedBy(ex:m; ex:e, ex:d, -)"])
    told = {(r.id.rsplit("/", 1)[1], r.rtype, r.formal, r.n) for r in triples.conflicts(quads(spark, turtle)).collect()}
    assert told == {("n", "Generation", "time", 2), ("o", "Delegation", "responsible", 2), ("act", "Activity", "startTime", 2)}


def test_typed_texts(spark):
    forms = [("gYear", "2020Z", "2020"), ("gYear", "-0044", "-44"), ("gYear", "20", "20"), ("gYearMonth", "0099-03+01:00", "99-03"), ("gYearMonth", "2020-3", "2020-3"), ("base64Binary", "aGVs\n bG8=", "aGVsbG8="), ("base64Binary", "a", "a"), ("decimal", "1.50", "1.50"), ("int", "x", "x"), ("boolean", "maybe", "maybe"), ("dateTime", "2020-01-01", "2020-01-01"), ("double", "1e", "1e"), ("date", "2020-1", "2020-1")]
    turtle = "\n".join(f'ex:e{i} a prov:Entity ; ex:v """{lex}"""^^xsd:{t} .' for i, (t, lex, _) in enumerate(forms))
    docs = spark.createDataFrame([("d", HEAD + turtle)], "doc_id string, text string")
    got = {r.id.local: r.attrs[0].value for r in from_content(docs, "rdf").collect()}
    for i, (t, _, want) in enumerate(forms):
        assert (got[f"e{i}"].kind, got[f"e{i}"].lex, got[f"e{i}"].datatype) == ("literal", want, XSD + t)
    bad = {(r.s.rsplit("/e", 1)[1], r.detail) for r in triples.bad_literals(quads(spark, turtle)).collect()}
    assert bad == {("2", "no year"), ("4", "no year and month"), ("6", "no base64"), ("8", "no whole number"), ("9", "no truth value"), ("10", "no date and time"), ("11", "no number")}


def test_long_escapes_of_lines(spark):
    lines = [r'<http://e/\U0001F600> <http://e/p> "a\U0001F600\\U0001F600\U00000022é\U0010FFFF\n" .', r'<http://e/s> <http://e/p> "\\\U0001F601" .']
    got = {(r.s.lex, r.o.lex) for r in triples.read_nquads(spark.createDataFrame([("d", x) for x in lines], "doc_id string, line string")).collect()}
    assert got == {("http://e/\U0001f600", 'a\U0001f600\\U0001F600"é\U0010ffff\n'), ("http://e/s", "\\\U0001f601")}


def test_own_properties(spark):
    turtle = "ex:e ex:madeBy ex:a ; ex:signedBy ex:g . ex:a a prov:Activity ; ex:began \"2020-01-01T00:00:00\"^^xsd:dateTime ."
    kinds = spark.createDataFrame([("http://e/madeBy", "Generation"), ("http://e/signedBy", "Attribution"), ("http://e/none", "Nothing")], "p string, kind string")
    others = spark.createDataFrame([("http://e/began", PROV + "startedAtTime")], "p string, becomes string")
    assert texts(spark, turtle, relation_map=kinds, predicate_map=others) == ["activity(ex:a, 2020-01-01T00:00:00, -)", "wasAttributedTo(ex:e, ex:g)", "wasGeneratedBy(ex:e, ex:a, -)"]
