"""Registration of namespaces in order, against a plain fold."""

import random

from tracewright.functions import values as V
from tracewright.functions.catalog import PROV, XSD
from tracewright.operators import names, render
from tracewright.operators import records as R
from pyspark.sql import functions as F

BUILT_IN = {"prov": PROV, "xsd": XSD, "xsi": "http://www.w3.org/2001/XMLSchema-instance"}


def fold(rows):
    """rows of (prefix, uri) in order: the prefix each ends up with."""
    taken, known, default, out = dict(BUILT_IN), {}, None, []
    for prefix, uri in rows:
        if prefix == "":
            default = default or uri
            if uri == default:
                out.append("")
                continue
            prefix = "dn"
        if taken.get(prefix) == uri:
            out.append(prefix)
            continue
        if uri not in known:
            name, n = prefix, 1
            while name in taken:
                name, n = f"{prefix}_{n}", n + 1
            taken[name], known[uri] = uri, name
        out.append(known[uri])
    return out


def test_register_follows_the_fold(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for doc in range(40):
        prefixes = ["a", "b", "prov", "", "dn", "xsd"] if doc % 2 else ["a", "a_1", "a_2", "a_1_1", "b", "", "prov", "dn", "dn_1", "c_7"]
        for scope in ("", "http://x/b"):
            declared = [(rng.choice(prefixes), rng.choice([PROV, XSD, *(f"http://u/{i}/" for i in range(9))])) for _ in range(rng.randrange(14))]
            rows += [(str(doc), scope, i, p, u) for i, (p, u) in enumerate(declared)]
            want |= {(str(doc), scope, i): w for i, w in enumerate(fold(declared))}
    rows += [("0", "", 99, "z", " ")]
    got = {(r.doc_id, r.scope, r.seq): r.as_prefix for r in names.register(spark.createDataFrame(rows, names.SCHEMA).repartition(5)).collect()}
    assert got == want


def test_combined_documents_keep_their_names_apart(spark):
    one = spark.range(1)
    ns = lambda rows: spark.createDataFrame([("d", *r) for r in rows], names.SCHEMA)
    a = R.entity(one, F.lit(0), V.name("ex", "http://a/", "x"), doc="d")
    inner = R.entity(one, F.lit(0), V.name("ex", "http://c/", "y"), doc="d", scope="http://b/bundle", attrs=[(V.name("own", "http://own/", "k"), V.v_qname(V.name("ex", "http://c/", "v")))])
    b = R.usage(one, F.lit(0), V.name("ex", "http://b/", "act"), V.name("new", "http://a/", "x"), doc="d", attrs=[(V.prov("type"), V.v_qname(V.name("ex", "http://b/", "t:u")))]).unionByName(inner)
    records, spaces = names.combine(a, ns([("", 0, "ex", "http://a/")]), b, ns([("", 0, "ex", "http://b/"), ("", 1, "new", "http://a/"), ("http://b/bundle", 0, "own", "http://own/"), ("", 2, "ex", "http://c/")]))
    assert sorted((r.scope, r.prefix, r.uri) for r in spaces.collect()) == [("", "ex", "http://a/"), ("", "ex_1", "http://b/"), ("", "ex_2", "http://c/"), ("http://b/bundle", "own", "http://own/")]
    texts = [r.text for r in records.select(render.record_text(records).alias("text"), "seq").collect()]
    assert sorted(texts) == ["entity(ex:x)", "entity(ex_2:y, [own:k='ex_2:v'])", "used(ex_1:act, ex:x, -, [prov:type='ex_1:t:u'])"]
    uris = {r.id.uri for r in records.where("id is not null").collect()}
    assert uris == {"http://a/x", "http://c/y"}


def test_no_namespaces(spark):
    none = spark.createDataFrame([], names.SCHEMA)
    spaces, renamed = names.union(none, none)
    assert spaces.count() == 0 and renamed.count() == 0
