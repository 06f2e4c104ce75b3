"""Near-duplicate documents, fuzzy lines and the pipeline against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from tracewright.llm import components, line_dedup, minhash

RNG = random.Random(11)
WORDS = [f"word{i}" for i in range(900)]


def union_find(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def edited(words, n):
    words = list(words)
    for _ in range(n):
        words[RNG.randrange(len(words))] = RNG.choice(WORDS)
    return words


@pytest.fixture(scope="module")
def texts():
    out = [None, "", " \n", "one two", "One\tTWO", "one two three", "one two three four", "é É"]
    for _ in range(12):  # families with a few to many edits
        base = RNG.choices(WORDS, k=RNG.choice([30, 80, 200]))
        out += [" ".join(edited(base, n)) for n in (0, 0, 1, 1, 2, 3, 4, 6, 9)]
    shared = RNG.choices(WORDS, k=60)
    out += [" ".join(RNG.choices(WORDS, k=40) + shared) for _ in range(30)]
    base = RNG.choices(WORDS, k=120)
    out += [" ".join(edited(base, RNG.randrange(5))) for _ in range(40)]
    out.append(" ".join(RNG.choices(WORDS, k=9000)))
    RNG.shuffle(out)
    return out


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, texts, k):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(7, texts[7], "y", 2)], "doc_id long, text string, kept string, component_id int").repartition(5)
    sets = [shingles(t, k) for t in texts]
    links = [(a, b) for b in range(len(sets)) for a in range(b) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = union_find(len(texts), links)
    out = minhash.near_duplicates(docs, words=k).collect()
    assert len(out) == len(texts) + 1
    for r in out:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root[r.doc_id], root[r.doc_id] == r.doc_id)


def test_near_duplicates_edge_tables(spark):
    schema = "doc_id long, text string"
    assert minhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    out = minhash.near_duplicates(spark.createDataFrame([(None, "a b"), (5, "a b"), (None, "z"), (None, None)], schema)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in out) == [(-1, -1, True), (-1, -1, True), (-1, 5, False), (5, 5, True)]


def test_large_group_below_the_similarity(spark, monkeypatch):
    """Copies of one text with so many edits that few are linked: pairs looked at don't grow with the square of the group."""
    rng = random.Random(12)
    base = rng.choices(WORDS, k=150)
    rows = []
    for i in range(400):
        own = list(base)
        for j in rng.sample(range(150), rng.choice([1, 2, 6, 7, 8, 9])):
            own[j] = f"own{i}x{j}"
        rows.append((i, " ".join(own)))
    compared = []

    def counted(members, facts, verify, *rest):
        def count(pairs):
            compared.append(pairs.count())
            return verify(pairs)

        return components.bucket_components(members, facts, count, *rest)

    monkeypatch.setattr(minhash, "bucket_components", counted)
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
    sets = [shingles(t, 4) for _, t in rows]
    root = union_find(len(rows), [(a, b) for b in range(len(sets)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    assert {r.doc_id: r.component_id for r in out} == dict(enumerate(root)) and len(set(root)) > 100
    assert sum(compared) <= 12 * len(rows)


def test_parity_maps_differ_no_more_than_sets():
    rng = np.random.default_rng(5)
    for n in (1, 40, 900):
        a, b = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)), np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        b[: n // 2] = a[: n // 2]
        bits = sum(bin(int(x)).count("1") for x in (minhash.parity_map(a) ^ minhash.parity_map(np.unique(b))).view(np.uint64))
        assert 0 < bits <= len(np.setxor1d(a, b))


def test_super_minhash_estimates():
    rng = np.random.default_rng(4)
    for overlap in (50, 160, 900):
        a, b = rng.integers(0, 2**63, (2, 1000), dtype=np.uint64)
        b[:overlap] = a[:overlap]
        x, y = minhash.super_minhash([np.unique(a), np.unique(b)], 512)
        assert abs((x == y).mean() - overlap / (2000 - overlap)) < 0.06
    one = minhash.super_minhash([np.array([7], np.uint64), np.zeros(0, np.uint64)], 40)
    assert sorted(one[0] >> np.uint64(40)) == list(range(40)) and (one[1] == np.iinfo(np.uint64).max).all()
    many = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 5, 60, 700)]
    assert (minhash.super_minhash(many, 64) == np.concatenate([minhash.super_minhash([s], 64) for s in many])).all()


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (100, 102), (7, 7)]
    star = [(200, x) for x in range(201, 260)]
    links = spark.createDataFrame(chain + star + [(None, 1)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100} | {i: 200 for i in range(200, 260)}
    assert components.connected_components(links.limit(0)).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        left = row[:]
        row[0] = i + 1
        for j, y in enumerate(b):
            row[j + 1] = min(left[j + 1] + 1, row[j] + 1, left[j] + (x != y))
    return row[-1]


def test_lines(spark):
    base = [" ".join(RNG.choices(WORDS, k=25)) for _ in range(25)]
    near = [b.replace(b[30:36], b[30:36].upper() + "  ") for b in base[:8]] + [b[:-1] + "~" for b in base[8:16]]
    rows = [(i, "\n".join(RNG.sample(base, 4) + ["", RNG.choice(near), "short"])) for i in range(30)]
    rows += [(40, None), (41, ""), (42, "\n \n"), (43, "short\nSHORT\n" + base[0]), (7, rows[7][1]), (44, "only this line stays\nonly that line stays")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_lines string").repartition(4)
    out = line_dedup.dedup_lines(docs).collect()
    assert len(out) == len(rows) and set(out[0].asDict()) == {"doc_id", "text", "n_lines", "n_removed"}
    norm = lambda line: " ".join(line.lower().replace("~", " ").split())
    lines = sorted({(i, p, norm(x)) for i, t in rows for p, x in enumerate((t or "").split("\n")) if norm(x)})
    source = docs.selectExpr("doc_id as id", "text").where("text is not null")
    _, stays = line_dedup.line_groups(source)
    key = lambda n: hashlib.md5(n.encode()).digest()
    place = {bytes(r.key): (r.first.id, r.first.pos) for r in stays.collect()}
    texts = sorted({n for _, _, n in lines})
    similar = [(a, b) for b in range(len(texts)) for a in range(b) if distance(texts[a], texts[b]) <= 0.2 * max(len(texts[a]), len(texts[b]))]
    # exactly the groups of all similar lines are linked
    want = union_find(len(texts), similar)
    for t, r in zip(texts, want):
        own = [(i, p) for i, p, n in lines if n == t]
        group = [(i, p) for i, p, n in lines if want[texts.index(n)] == r]
        assert place.get(key(t), own[0]) == min(group)
        assert (key(t) in place) == (len(group) > 1)
    for r in out:
        before = next(t for i, t in rows if i == r.doc_id)
        keep = [x for p, x in enumerate((before or "").split("\n")) if not norm(x) or place.get(key(norm(x)), (r.doc_id, p)) == (r.doc_id, p)]
        assert r.text == (None if before is None else "\n".join(keep))
        n = sum(bool(norm(x)) for x in (before or "").split("\n"))
        assert (r.n_lines, r.n_removed) == (n, n - sum(bool(norm(x)) for x in keep))
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    sf = "/root/testdata/sf0.001"
    docs = start = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in pipeline.STAGES:
        before, docs = docs, pipeline.materialize(stage(spark, docs, sf), "test-stage")
        kept[name] = docs
        if name != "bpe":
            assert docs.columns == start.columns and [t for _, t in docs.dtypes] == [t for _, t in start.dtypes]
        if name == "toxicity":
            toxic = spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").select("doc_id")
            assert docs.join(toxic, "doc_id").count() <= 0.2 * toxic.count() and docs.count() >= 0.8 * before.count()
        if name == "line_dedup":
            repeated = docs.selectExpr("explode(split(text, '\\n')) l").where("trim(l) <> ''").groupBy("l").count().where("count > 1")
            assert repeated.isEmpty()
        if name == "minhash":
            rows = [(r.doc_id, shingles(r.text, 5)) for r in docs.collect()]
            assert not [(a, b) for a, x in rows for b, y in rows if a < b and x and 100 * len(x & y) >= 80 * len(x | y)]
    mixed = {r.doc_id: r["count"] for r in kept["mixing"].groupBy("doc_id").count().collect()}
    assert max(mixed.values()) <= 3 and set(mixed) <= {r.doc_id for r in kept["minhash"].collect()}
    assert kept["bpe"].where("not round_trip").isEmpty() and kept["bpe"].count() == sum(mixed.values())
    assert pipeline.run(spark, sf).count() == kept["bpe"].count()
