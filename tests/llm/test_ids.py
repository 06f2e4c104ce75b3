"""Operators on rows whose ids are null, shared or text."""

import random

import pytest

from tracewright.llm import exact_dedup, language_id, mixing
from pyspark.sql import functions as F

ENGLISH, GERMAN = "the house and the garden are there with this".split(), "das haus und der garten sind mit diesem dort".split()


@pytest.mark.parametrize("ids", ["cast(null as long)", "5L", "cast(null as string)"])
def test_languages_are_learned_whatever_the_ids(spark, ids):
    rng = random.Random(1)
    rows = [(" ".join(rng.choices(words, k=6)), lang) for words, lang in ((ENGLISH, "en"), (GERMAN, "de")) for _ in range(2000)]
    docs = spark.createDataFrame(rows, "text string, lang string").selectExpr(f"{ids} as doc_id", "*").repartition(4)
    out = language_id.identify(docs, language_id.train(docs, per_language=300))
    assert out.where("lang_pred = lang").count() > 3950


def test_language_of_one_repeated_row(spark):
    rows = [(1, "the the the", "en")] * 40 + [(2, "der der der", "de")] * 40 + [(3, "", "fr")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for per_language in (1, 5):
        langs, table = language_id.train(docs, per_language=per_language)
        assert langs == ["de", "en"] and table.shape[1] == 2


def naive_bayes(rows, text):
    """Plain multinomial naive Bayes over the same n-grams: log-likelihoods by language."""
    import math
    from collections import Counter

    size, out = 1 << language_id.BUCKET_BITS, {}
    for lang in sorted({x for _, _, x in rows}):
        counts = Counter(b for _, t, x in rows if x == lang for b in language_id.ngram_buckets(t).tolist())
        total = sum(counts.values()) + 0.5 * size
        out[lang] = sum(math.log((counts[b] + 0.5) / total) for b in language_id.ngram_buckets(text).tolist())
    return out


def test_posteriors_equal_plain_naive_bayes(spark):
    import math

    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 9))), lang) for words, lang in ((ENGLISH, "en"), (GERMAN, "de"), (["le", "jardin", "et", "la"], "fr")) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    asked = ["the garden", "der garten", "le garten", "x", "haus und jardin the"]
    got = {r.text: r for r in language_id.identify(spark.createDataFrame([(t,) for t in asked], "text string"), language_id.train(docs)).collect()}
    for text in asked:
        want = naive_bayes(rows, text)
        best = max(sorted(want), key=want.get)
        assert got[text].lang_pred == best
        assert abs(got[text].score - 1 / sum(math.exp(v - want[best]) for v in want.values())) < 1e-3


@pytest.mark.parametrize("ids", ["cast(null as long)", "'same'"])
def test_targets_are_met_whatever_the_ids(spark, ids):
    rng = random.Random(3)
    rows = [(" ".join(f"w{rng.randrange(999)}" for _ in range(10)), s) for s, n in (("a", 50), ("b", 200), ("c", 80)) for _ in range(n)]
    docs = spark.createDataFrame(rows, "text string, source string").selectExpr(f"{ids} as doc_id", "*")
    for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= 10


def test_text_ids_of_copies(spark):
    rows = [("b", "x y"), ("a", "xy"), ("c", "x  y"), ("e", "x  y"), (None, "z"), ("d", "z"), (None, "")]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {(i, "c", 4, i == "c") for i in "abce"} | {(None, "d", 2, False), ("d", "d", 2, True), (None, None, 1, True)}
