"""Centroids, substring dedup and importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from tracewright.llm import centroids, importance, substrings

# --- centroids


def lloyd(rows, k, rounds, dims, scale, seed="2"):
    """rows of (id, vector): {row number: (cluster, distance)} and centres."""
    kept = [(i, v, [math.floor(scale * x) for x in v[1]]) for i, v in enumerate(rows) if v[1] is not None and len(v[1]) == dims and all(x is not None and math.isfinite(x) for x in v[1])]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[1][0] is None else r[1][0]}".encode()).hexdigest(), r[2]))
    centres = [q for _, _, q in order[:k]]
    nearest = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        of = [nearest(q)[1] for _, _, q in kept]
        for n in range(len(centres)):
            mine = [q for (_, _, q), c in zip(kept, of) if c == n]
            if mine:
                centres[n] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted((str(v[0]), nearest(q)[1], nearest(q)[0]) for _, v, q in kept), centres


def blobs(n, dims, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(9, dims))
    return [(i, [float(x) for x in middles[rng.integers(9)] + spread * rng.normal(size=dims)]) for i in range(n)]


@pytest.mark.parametrize("k, rounds, spread", [(7, 6, 0.9), (12, 5, 0.1), (1, 2, 0.3), (5, 0, 0.3)])
def test_centroids_equal_lloyd(spark, k, rounds, spread):
    dims = 6
    rows = blobs(400, dims, k, spread)
    rows += [rows[3], rows[3], (None, rows[5][1]), (None, None), (1000, []), (1001, [0.0] * 5), (1002, [0.0] * 7), (1003, [None] + [0.0] * 5), (1004, [math.nan] * 6), (1005, [math.inf] * 6), (1006, [0.0] * 6), (1007, [0.0] * 6), (1008, [3.0] * 6), (1009, [-3.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' as cluster", "1 as distance").repartition(5)
    got, table = centroids.cluster_vectors(df, k=k, rounds=rounds, dims=dims, scale=16)
    want, centres = lloyd(rows, k, rounds, dims, 16)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in got.collect()) == want
    stats = {r.cluster: r for r in table.collect()}
    assert [stats[c].centroid for c in range(len(centres))] == centres
    for c, r in stats.items():
        mine = [d for _, n, d in want if n == c]
        assert (r.n, r.cluster_inertia, r.inertia) == (len(mine), sum(mine), sum(d for _, _, d in want))


def test_centroids_of_few_and_of_large_vectors(spark):
    none = spark.createDataFrame([], "vec_id string, embedding array<float>")
    assigned, table = centroids.cluster_vectors(none)
    assert assigned.count() == 0 and table.count() == 0 and assigned.columns == ["vec_id", "cluster", "distance"]
    same = spark.createDataFrame([("a", [5e5] * 64), ("b", [5e5] * 64), ("c", [-5e5] * 64)], "vec_id string, embedding array<float>")
    assigned, table = centroids.cluster_vectors(same)
    got = {r.vec_id: (r.cluster, r.distance) for r in assigned.collect()}
    assert got["a"] == got["b"] and got["a"][1] == got["c"][1] == 0 and got["c"][0] != got["a"][0] and table.count() == 3
    with pytest.raises(Exception, match="component beyond"):
        centroids.cluster_vectors(spark.createDataFrame([("a", [1e6] * 64)], "vec_id string, embedding array<float>"))


def test_heaps_pop_less_than_everything(spark, monkeypatch):
    """Later rounds scan only what has expired."""
    sizes = []
    kept = centroids.materialize

    def counted(df, name):
        out = kept(df, name)
        if name == "centroid-heaps":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(centroids, "materialize", counted)
    centroids.cluster_vectors(spark.createDataFrame(blobs(2000, 8, 1, 0.05), "vec_id long, embedding array<double>"), k=9, dims=8)
    assert sizes[0] == 2000 and sizes[-1] < 500


# --- substrings

SPLIT = re.compile(r"[^\x20\x09-\x0d]+")


def cut_windows(rows, window):
    first = {}
    for i, t in rows:
        words = SPLIT.findall(t or "")
        if i is not None:
            for s in range(len(words) - window + 1):
                key = tuple(words[s : s + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        words = SPLIT.findall(t or "")
        gone = set()
        if i is not None:
            for s in range(len(words) - window + 1):
                if first[tuple(words[s : s + window])] < i:
                    gone.update(range(s, s + window))
        out.append((str(i), len(words), len(gone), " ".join(w for n, w in enumerate(words) if n not in gone)))
    return sorted(out)


def shared_texts(seed):
    rng = random.Random(seed)
    prose = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    passages = [prose(n) for n in (49, 50, 51, 70, 120, 400)]
    rows = [(i, " ".join(prose(rng.randrange(5)) + sum((rng.choice(passages) + prose(rng.randrange(60)) for _ in range(rng.randrange(1, 4))), []))) for i in range(60)]
    long = prose(5000)
    rows += [(100, " ".join(long)), (101, "\n".join(long)), (102, " ".join(long[100:4000]) + " x " + " ".join(long[:200]))]
    for i in range(110, 125):  # near copies
        words = list(long[:600])
        for _ in range(6):
            words[rng.randrange(600)] = "changed"
        rows.append((i, " ".join(words)))
    rows += [(130, "a " * 300), (131, "a " * 49), (132, "a " * 50), (133, "b a " * 200), (134, None), (135, ""), (136, " \t"), (137, "é " * 3000), (138, "é " * 3000)]
    rows += [(100, " ".join(long)), (7, " ".join(long)), (None, " ".join(long)), (None, None), (139, "\x0b".join(passages[4]) + " " + "\r\n".join(passages[5]))]
    return rows


@pytest.mark.parametrize("piece, window", [(1 << 20, 50), (700, 50), (1 << 20, 25)])
def test_substrings_equal_brute_force(spark, piece, window):
    rows = shared_texts(piece)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' as n_removed", "'s' as spans").repartition(6)
    got = substrings.dedup_substrings(df, window=window, piece_bytes=piece)
    assert got.columns == ["doc_id", "text", "n_words", "n_removed", "spans"]
    found = got.collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.text) for r in found) == cut_windows(rows, window)
    for r in found:
        assert sum(s.hi - s.lo for s in r.spans) == r.n_removed


def test_substrings_by_text_ids_and_of_no_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([("b", text), ("a", text), ("c", "x")], "id string, body string")
    got = {r.id: r.n_removed for r in substrings.dedup_substrings(df, "id", "body").collect()}
    assert got == {"a": 0, "b": 60, "c": 0}
    assert substrings.dedup_substrings(df.limit(0), "id", "body").count() == 0


def test_anchors_depend_on_the_window_alone():
    rng = random.Random(4)
    words = [f"w{rng.randrange(9)}".encode() for _ in range(400)]
    whole = substrings.blocks(substrings.Words([words]), 50, 20)
    owner = {s: at for h, at, lo, hi in zip(*map(np.ndarray.tolist, whole)) for s in range(lo, hi + 1)}
    assert sorted(owner) == list(range(351))
    for s in range(0, 351, 7):
        _, at, _, _ = substrings.blocks(substrings.Words([words[s : s + 50]]), 50, 20)
        assert at.tolist() == [owner[s] - s]


# --- importance

WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def runs_of(text, max_n):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    return words, [" ".join(words[i : i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize("max_n, buckets, piece", [(1, 10_000, 1 << 20), (2, 64, 1 << 20), (3, 500, 300)])
def test_importance_equals_plain_python(spark, max_n, buckets, piece):
    rng = random.Random(max_n)
    texts = [None, "", " .,-", "İstanbul ΑΒΓ É x_y A1b2", "a", "AZ az `@[{", "z" * 300 + " " + "z" * 300, "y" * 200 + "a " + "y" * 200 + "b", "日本語、テキスト 🙂", "long " * 3000] + [" ".join(rng.choice(["the", "The", "of", "x1", "Über", f"w{rng.randrange(200)}"]) for _ in range(rng.randrange(60))) for _ in range(80)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(30, texts[30]), (30, texts[30]), (None, texts[31]), (None, None)]
    aim = [(i, t) for i, t in enumerate(texts[40:50])] + [(None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' as rank", "'s' as weight").repartition(5)
    got = importance.resample(df, spark.createDataFrame(aim, "item_id long, text string"), max_n=max_n, buckets=buckets, percent=30, piece_bytes=piece).collect()
    s, t = [np.zeros(buckets, int) for _ in range(2)]
    for some, into in ((rows, s), (aim, t)):
        for _, text in some:
            for f in runs_of(text, max_n)[1]:
                into[zlib.crc32(f.encode()) % buckets] += 1
    gain = [math.floor(1000 * math.log(float(t[b] + 1) * float(s.sum() + buckets) / (float(s[b] + 1) * float(t.sum() + buckets)))) for b in range(buckets)]
    want, able = [], []
    for i, text in rows:
        words, feats = runs_of(text, max_n)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in feats)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        want.append((str(i), len(words), len(feats), weight, score))
        if len(words) >= 20:
            able.append((-score, i is None, i or 0))
    assert sorted((str(r.doc_id), r.n_words, r.n_features, r.weight, r.score) for r in got) == sorted(want)
    drawn = sorted((r.rank, -r.score, r.doc_id is None, r.doc_id or 0) for r in got if r.rank is not None)
    assert [r[0] for r in drawn] == list(range(1, len(able) * 30 // 100 + 1))
    assert [r[1:] for r in drawn] == sorted(able)[: len(drawn)]
    assert {r.doc_id: r.text for r in got if r.doc_id is not None} == dict(r for r in rows if r[0] is not None)


def test_importance_of_no_rows(spark):
    none = spark.createDataFrame([], "doc_id string, text string")
    assert importance.resample(none, none).count() == 0
    one = spark.createDataFrame([("a", "b " * 30)], "doc_id string, text string")
    assert importance.resample(one, none).collect()[0].n_features == 30


def test_intern_table_tells_equal_keys_apart(monkeypatch):
    """Strings whose xxhash64 keys are equal are told apart by their bytes."""
    monkeypatch.setattr(importance.xxhash, "xxh64_intdigest", lambda b: 3)
    words = [b"aa", b"bb", b"aa", b"c", b"x" * 90, b"x" * 89 + b"y", b"x" * 90, b"bb"]
    buf = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    table = importance.InternTable(buf, ends - [len(w) for w in words], ends, 1000)
    slots = table.slot.tolist()
    assert len(set(slots)) == 5 and slots[0] == slots[2] and slots[1] == slots[7] and slots[4] == slots[6]
    assert [table.count[x] for x in slots] == [2, 2, 2, 1, 2, 1, 2, 2] and table.bucket[slots[3]] == zlib.crc32(b"c") % 1000
