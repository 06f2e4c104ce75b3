"""Learned operators against brute force: marginals of the field, log-ratios, and what training brings to the driver."""

import collections
import itertools
import math

import numpy as np
import xxhash

from tracewright.llm import pii, quality, toxicity


def marginals(p, field):
    """Exact label probabilities by enumeration."""
    n, labels = len(field.spans), range(1 + len(pii.KINDS))
    total = np.zeros((n, len(labels)))
    for y in itertools.product(labels, repeat=n):
        if any(g and g != l for g, l in zip(field.given, y)):
            continue
        e = sum((field.x[i] @ p["w"])[l] for i, l in enumerate(y) if not field.given[i])
        e += sum(p[k][y[a], y[b]] for k, edges in (("chain", field.chain), ("skip", field.skip)) for a, b in edges)
        total[np.arange(n), list(y)] += math.exp(e)
    return total / total.sum(axis=1, keepdims=True)


def test_messages_against_enumeration():
    rng = np.random.default_rng(3)
    # a chain, two repeats that are joined, a pattern's span beside words, and a loop of chain and skip edges
    for text, near in (("12 34 x1 78", 0.01), ("12 and 77 or 12", 0.001), ("a@b.com 12 34", 0.01), ("12 34 12", 0.05)):
        field = pii.Field([text])
        for _ in range(5):
            p = {"w": rng.normal(0, 0.3, (pii._N_FEATURES, 5)), "chain": rng.normal(0, 0.5, (5, 5)), "skip": rng.normal(0, 0.5, (5, 5))}
            assert np.abs(pii.beliefs(p, field) - marginals(p, field)).max() < near, text


def test_counted_examples_give_the_same_weights(spark):
    texts = ["mail a@b.com or a at b 12", "call +1 555 123 4567 now, again 5551234567 and 5551234567", None, "", "ip 10.0.0.1 10.0.0.1, 1.2.3", "none", "x9 x9 x9 x9"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 2, "doc_id long, text string").repartition(3)
    plain = pii.fit([t for t in texts if t and any(c in "0123456789@" for c in t)])
    for got in (pii.train(docs), pii.train(docs.selectExpr("cast(null as string) as doc_id", "text"))):
        assert all(np.abs(got[k] - plain[k]).max() < 1e-6 for k in plain)
    one = pii.train(docs.selectExpr("1 as doc_id", "text"), limit=2)
    again = pii.train(docs.repartition(5).selectExpr("1 as doc_id", "text"), limit=2)
    assert all((one[k] == again[k]).all() for k in one)


def test_log_ratios_against_plain_counts(spark):
    texts = {1: "good plain words here", 2: "good plain words there ünï", 3: "bad bad #spam", 4: None, 5: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    target = [1, 2, 9]

    def grams(text):
        words = (text or "").split()
        one = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
        two = [xxhash.xxh64_intdigest(w.encode(), h) for h, w in zip(one, words[1:])]
        return [((h ^ 1 << 63) - (1 << 63)) % quality.BUCKETS for h in one + two]

    raw, good = (collections.Counter(g for i, t in texts.items() if i in ids for g in grams(t)) for ids in (texts, target))
    share = lambda c, b: math.log((c[b] + 0.5) / (c.total() + 0.5 * quality.BUCKETS))
    ratios = quality.log_ratios(docs, spark.createDataFrame([(i,) for i in target], "doc_id long"))
    got = {r.bucket: r.ratio for r in ratios.collect()}
    assert set(got) == set(range(quality.BUCKETS))
    assert all(abs(v - (share(good, b) - share(raw, b)) * quality.UNIT) <= 0.51 for b, v in got.items())
    for r in quality.assess(docs, ratios).collect():
        own = grams(texts[r.doc_id])
        assert abs(r.llr - sum(got[g] for g in own) / max(1, len(own)) / quality.UNIT) < 1e-9


def test_windows_for_training():
    words = [f"w{i}" for i in range(500)]
    assert toxicity.cut_windows(None) == toxicity.cut_windows("... ") == []
    cut = toxicity.cut_windows(" ".join(words))
    assert {w for c in cut for w in c.split()} == set(words)
    texts = [" ".join(words), None, "", "Two words", "x" * 9000]
    whole, made = toxicity.Batch(texts[:4]), toxicity.Batch.of_windows([toxicity.cut_windows(t) for t in texts])
    assert whole.words == made.words and (whole.text == made.text).all() and (whole.ids == made.ids).all()
    # of a very long text a bounded part is learned from, the same each time
    long = " ".join(f"v{i}" for i in range(200_000))
    cut = toxicity.cut_windows(long)
    assert len(cut) == toxicity.TRAIN_WINDOWS and cut == toxicity.cut_windows(long)
    assert max(map(len, cut)) <= toxicity.TRAIN_CHARS


def test_training_batches_keep_distinct_words_only():
    """Windows of words that repeat are held as codes: a list of all words takes many times as much."""
    import tracemalloc

    cuts = [[" ".join(f"word{(i * 7 + j) % 500}" for j in range(64)) for i in range(60)] for _ in range(50)]
    toxicity.Batch.of_windows([["some words"]])
    tracemalloc.start()
    batch = toxicity.Batch.of_windows(cuts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(batch.words) == 477 and batch.ids.nbytes == 4 * 64 * 3000
    assert most < 6 * batch.ids.nbytes


def test_parts_of_a_table_are_the_whole(monkeypatch):
    cuts = [[f"a{i} bb{i} ccc{i % 7}" for i in range(40)]]
    whole = toxicity.Batch.of_windows(cuts)
    p = toxicity.start(whole, np.array([1]), np.random.default_rng(1))
    expected = whole.table(p)
    monkeypatch.setattr(toxicity, "PART", 3)
    cut = toxicity.Batch.of_windows(cuts)
    assert all((a == b).all() for a, b in zip(whole.features, cut.features)) and (cut.table(p) == expected).all()
    assert (cut.table(p, np.array([5, 0, 60])) == expected[[5, 0, 60]]).all()
