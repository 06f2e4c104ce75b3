"""Turtle and TriG text, read again."""

from collections import Counter

from tracewright.functions import values as V
from tracewright.operators import names, setops
from tracewright.operators import records as R
from tracewright.sources import read, write, write_trig
from pyspark.sql import functions as F

TEXT = """@prefix ex: <http://e/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
ex:a a ex:T ; ex:p "x", 'y"z', \"\"\"two
lines\"\"\", "fr"@fr, 5, "b\\\\"^^ex:t, <http://e/a/b>, <http://e/a%20b>, <http://e/x\\u0020y>, <http://e/ends.> .
ex:a ex:q [ ex:r "1" ; ex:s ex:b ], _:shared . ex:b ex:q _:shared . _:shared ex:r [ ex:r _:deep ] . _:deep ex:r "2" . _:alone ex:r "3" .
<http://other.org/x#-1> ex:p ex:1 . ex:g { ex:a ex:p "in g" . } ex:none { }"""


def shape(rows):
    """Quads with blank nodes named by what is said of them."""
    said = lambda label, depth: repr(sorted((p, (o[1] if o[0] != "blank" else said(o[1], depth - 1))) for g, s, p, o in rows if s[:2] == ("blank", label))) if depth else "-"
    named = lambda t: ("blank", said(t[1], 4)) if t[0] == "blank" else t
    return Counter((g, named(s), p, named(o)) for g, s, p, o in set(rows))


def test_turtle_is_read_back(spark):
    docs = spark.createDataFrame([("d", TEXT)], "doc_id string, text string")
    quads = read.quads_of(docs).cache()
    plain = lambda df: [(r.graph, tuple(r.s), r.p, tuple(r.o)) for r in df.collect()]
    for spaces in (None, read.prefixes_of(docs)):
        text = write_trig.trig_text(quads, spaces, read.bundles_of(docs, "rdf"))
        assert shape(plain(read.quads_of(text))) == shape(plain(quads))
        assert {r.scope for r in read.bundles_of(text, "rdf").collect()} == {"http://e/g", "http://e/none"}
    shown = text.collect()[0].text
    assert 'ex:q [ ex:r "1" ; ex:s ex:b ], _:shared' in shown and "ex:g {" in shown and '"b\\\\"^^ex:t' in shown and "<http://other.org/x#-1>" in shown


def test_records_are_read_back(spark):
    one = spark.range(1)
    n = lambda x: V.name("ex", "http://e/", x)
    time = V.time_of(F.lit("2020-01-02 03:04:05").cast("timestamp_ntz"))
    parts = [
        R.entity(one, F.lit(0), n("e 1"), doc="d", attrs=[(V.prov("label"), V.v_str("l\n\"x\"")), (n("k"), V.v_float(F.lit(1.5)))]),
        R.generation(one, F.lit(1), n("e"), n("a"), time=time, doc="d"),
        R.association(one, F.lit(2), n("a"), n("g"), n("plan"), doc="d", attrs=[(V.prov("role"), V.v_str("r"))]),
        R.association(one, F.lit(3), n("a"), n("h"), n("plan"), doc="d", id=n("named")),
        R.delegation(one, F.lit(4), n("g"), n("h"), doc="d", scope="http://e/b"),
    ]
    records = parts[0]
    for p in parts[1:]:
        records = records.unionByName(p)
    spaces = spark.createDataFrame([("d", "", 0, "ex", "http://e/"), ("d", "", 1, "1bad", "http://x/")], names.SCHEMA)
    text = write.serialize(records, "trig", spaces)
    assert setops.equal(read.from_content(text, "rdf"), records)


def test_labels_of_the_text_are_kept_apart(spark):
    text = '@prefix ex: <http://e/> . _:anon1 ex:p "1" . ex:a ex:q [ ex:p "2" ] . ex:b ex:q [ ex:p _:anon2 ] . ex:c ex:q [ ex:p "3" ; ex:q [ ] ] .'
    quads = read.quads_of(spark.createDataFrame([("d", text)], "doc_id string, text string")).collect()
    said = {}
    for r in quads:
        said.setdefault(r.s.lex, []).append(r.p[-1] + (r.o.lex if r.o.kind == "literal" else ""))
    assert sorted(sorted(v) for k, v in said.items() if not k.startswith("http")) == [["p"], ["p1"], ["p2"], ["p3", "q"]]


def test_long_texts_that_break_off_give_nothing(spark, monkeypatch):
    line = "ex:a ex:p ex:b{} . "
    rows = [("good", "@prefix ex: <http://e/> . " + "".join(line.format(i) for i in range(300_000))), ("bad", "@prefix ex: <http://e/> . " + "".join(line.format(i) for i in range(300_000)) + "ex:a ex:p"), ("short", "ex:a ex:p ex:b ."), (None, None)]
    assert all(len(t) > read.WHOLE for d, t in rows[:2])
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert [tuple(r) for r in read.quads_of(docs).groupBy("doc_id").count().collect()] == [("good", 300_000)]
    assert [tuple(r) for r in read.prefixes_of(docs).collect()] == [("good", "", 0, "ex", "http://e/")]


def test_quads_are_made_once_and_not_broadcast(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    n = 500
    iri = "struct('iri' as kind, {} as lex, cast(null as string) as datatype, cast(null as string) as lang)"
    rows = spark.range(n).select(F.lit("d").alias("doc_id"), F.lit(None).cast("string").alias("graph"), F.expr(iri.format("concat('http://e/', id)")).alias("s"), F.lit("http://e/p").alias("p"), F.expr(iri.format("'http://e/o'")).alias("o"))
    text = write_trig.trig_text(rows.mapInArrow(count, rows.schema), spark.createDataFrame([("d", "", 0, "ex", "http://e/")], names.SCHEMA)).collect()[0].text
    assert text.count("ex:p ex:o") == n and made.value == n
