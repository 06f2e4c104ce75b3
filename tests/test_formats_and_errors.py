"""The data source, and what is told about statements that can't be taken whole."""

import pytest

from tracewright import errors
from tracewright.functions import values as V
from tracewright.operators import names, setops
from tracewright.operators import records as R
from tracewright.sources import formats, read, statements, write
from pyspark.sql import functions as F


def test_written_and_read_by_format(spark, tmp_path):
    one = spark.range(3)
    doc = F.concat(F.lit("a/b "), F.col("id").cast("string"))
    name = lambda x: V.name("ex", "http://e/", F.concat(F.lit(x), F.col("id").cast("string")))
    docs = R.entity(one, F.lit(0), name("e"), doc=doc).unionByName(R.usage(one, F.lit(1), name("a"), name("e"), doc=doc))
    spaces = one.select(doc.alias("doc_id"), F.lit("").alias("scope"), F.lit(0).cast("long").alias("seq"), F.lit("ex").alias("prefix"), F.lit("http://e/").alias("uri"))
    formats.register(spark)
    for notation in ("json", "xml", "rdf"):
        path = f"{tmp_path}/{notation}"
        texts = write.serialize(docs, notation, spaces)
        for _ in range(2):
            texts.write.format("provenance").option("notation", notation).mode("overwrite").save(path)
        texts.write.format("provenance").option("notation", notation).mode("append").save(path)
        rows = spark.read.format("provenance").option("notation", notation).option("partitions", 2).load(path)
        assert setops.equal(formats.records(rows), docs)
        if notation != "rdf":
            assert setops.equal(formats.records(spark.read.format("provenance").load(f"file://{path}")), docs)
    (tmp_path / "json" / "bad.json").write_text("{")
    bad = statements.violations(spark.read.format("provenance").option("notation", "json").load(f"{tmp_path}/json"))
    assert [(r.doc_id, r.kind) for r in bad.collect()] == [("bad", "text")]
    with pytest.raises(Exception, match="nothing"):
        spark.read.format("provenance").option("notation", "nothing").load(str(tmp_path)).count()


TEXT = """{"prefix": {"ex": "http://e/"}, "activity": {"ex:a": {"prov:startTime": "yesterday", "ex:n": {"$": "x", "type": "xsd:int"}, "ex:m": {"$": "5", "type": "xsd:int"}}, "zz:b": {}},
"used": {"_:u": {"prov:activity": "ex:a", "prov:entity": "yy:e", "qq:k": "v"}}, "entity": {"ex:e": {"ex:t": {"$": "then", "type": "xsd:dateTime"}}}}"""


def test_violations_of_a_text(spark):
    docs = spark.createDataFrame([("d", TEXT), ("e", "<")], "doc_id string, text string")
    flat = statements.flatten_documents(docs, read.PARSERS["json"])
    found = statements.violations(flat)
    told = sorted((r.doc_id, r.kind, r.detail) for r in found.where("kind <> 'text'").collect())
    assert told == [("d", "name", "qq:k"), ("d", "name", "yy:e"), ("d", "name", "zz:b"), ("d", "time", "yesterday"), ("d", "value", "then"), ("d", "value", "x")]
    assert [r.doc_id for r in found.where("kind = 'text'").collect()] == ["e"]
    with pytest.raises(errors.InvalidName, match="qq:k|yy:e|zz:b"):
        errors.raise_first(found.where("kind = 'name'"))
    with pytest.raises(errors.UnreadableText):
        errors.raise_first(found.where("doc_id = 'e'"))
    errors.raise_first(found.limit(0))


def test_repeated_formals(spark):
    rows = [("d", 0, "statement", None, 0, None), ("d", 0, "attribute", "prov:entity", 1, "ex:a"), ("d", 0, "attribute", "prov:entity", 2, "ex:b"), ("d", 1, "statement", None, 0, None), ("d", 1, "attribute", "prov:entity", 1, "ex:a"), ("d", 1, "attribute", "prov:entity", 2, "ex:a")]
    flat = spark.createDataFrame(rows, "doc_id string, seq long, what string, attr string, pos long, lex string").selectExpr("doc_id", "'' as scope", "seq", "what", "'Usage' as rtype", "cast(null as string) as id", "attr", "pos", "'str' as form", "lex", "cast(null as string) as datatype", "cast(null as string) as lang")
    spaces = spark.createDataFrame([("d", "", "binding", "ex", 0, "http://e/")], "doc_id string, scope string, what string, attr string, pos long, lex string")
    found = statements.violations(flat.unionByName(spaces, allowMissingColumns=True)).collect()
    assert [(r.seq, r.kind, r.detail) for r in found] == [(0, "repeated", "entity")]
    one = spark.range(1)
    n = lambda x: V.name("ex", "http://e/", x)
    used = R.usage(one, F.lit(0), n("a"), n("e"), doc="d")
    more = R.add_attributes(used, (V.prov("entity"), V.v_qname(n("other"))), (V.prov("plan"), V.v_qname(n("p"))), (V.prov("activity"), V.v_qname(n("a"))))
    assert [(r.kind, r.detail) for r in R.repeated_formals(more.unionByName(used)).collect()] == [("repeated", "entity")]


def test_required_times_and_names(spark):
    good = spark.createDataFrame([("2020-01-01T00:00:00", "ex:a"), (None, None)], "t string, n string")
    own = F.array(F.struct(F.lit("ex").alias("prefix"), F.lit("http://e/").alias("uri")))
    assert [r.u for r in good.select(names.require(F.col("n"), own)["uri"].alias("u")).collect()] == ["http://e/a", None]
    assert good.select(V.require_datetime(F.col("t"))["lex"].alias("t")).where("t is not null").count() == 1
    for c in (V.require_datetime(F.lit("2020-01-01")), names.require(F.lit("zz:a"), own)):
        with pytest.raises(Exception, match="no date and time|unknown name"):
            good.select(c.alias("c")).collect()
