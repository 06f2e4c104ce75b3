"""Operators against plain Python on fixtures with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re

import numpy as np
import pytest

from tracewright.llm import bpe, exact_dedup, language_id, mixing, pii, quality, queries, toxicity, url_filter

RNG = random.Random(3)
WORDS = [f"w{i}" for i in range(60)]
TEXTS = [None, "", " \t\n", "a", "A b\x0bc\r\nd", "é\u00a0x \u2003y", "x" * 5000, "a b c d e f g h " * 40, "# & *** $$$\nsame line\nsame line\n\nsame line"] + [" ".join(RNG.choices(WORDS, k=RNG.randrange(1, 80))) for _ in range(40)]
SCHEMA = "doc_id long, text string, lang string, source string, score string, kept string, size string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", None, "Z"][i % 4], "s", "k", "z") for i, t in enumerate(TEXTS)]
    rows += [rows[10], rows[10], (None, "a b", "en", "a", None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.where("doc_id is not null").collect()}


def test_url_filter(spark):
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", None), ("allow", "a.org", ""), ("block", None, "/"), ("block", "com", "/en/")]
    hosts = ["example.com", "EXAMPLE.com", "sub.example.com", "notexample.com", "com", "x.net", "example.net", "a.org", "b.a.org", "ca.org", "", "..com"]
    urls = [None, "", "no scheme", "://", "http://", "a://b://c/en/"] + [f"http://{h}{p}" for h in hosts for p in ("", "/", "/en/", "/en/7", "/en/71?q", "?/en/", "#x", "/de/8#", "/de/x")]
    pages = spark.createDataFrame([(i, u, "v") for i, u in enumerate(urls + urls[:3])], "page_id long, url string, verdict string").repartition(4)
    got = {r.page_id: tuple(r)[1:] for r in url_filter.filter_urls(pages, spark.createDataFrame(rules, "verdict string, host string, path string"), ranges=5).collect()}
    for i, u in enumerate(urls + urls[:3]):
        rest = (u or "").split("://", 1)[1] if "://" in (u or "") else ""
        host = re.match(r"[^/?#]*", rest)[0].lower()
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fits = [(len(h + (p or "")), h + (p or ""), v) for v, h, p in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
        best = max(fits, default=(0, None, "allow"))
        assert got[i] == (host, path, best[1], best[2]), u
    assert url_filter.filter_urls(pages.limit(0), spark.createDataFrame(rules, "verdict string, host string, path string")).count() == 0


def test_exact_duplicates(docs, none, monkeypatch):
    rows = docs.select("doc_id", "text").collect()
    body = lambda t: re.sub(r"[\x20\x09-\x0d]+", "", t or "")
    for capacity, bits in ((1, 14), (20_000, 14), (1, 2)):
        monkeypatch.setattr(exact_dedup, "COUNTED_BITS", bits)
        out = exact_dedup.exact_duplicates(docs, capacity=capacity).collect()
        assert len(out) == len(rows)
        for r in out:
            same = [x for x in rows if hashlib.sha256(body(x.text).encode()).hexdigest() == r.text_sha256]
            assert r.group_size == len(same)
            assert r.keep_id == min(same, key=lambda x: (-len(x.text or ""), x.doc_id is None, x.doc_id)).doc_id
            assert r.kept == (r.doc_id == r.keep_id)
    assert exact_dedup.exact_duplicates(none).count() == 0


def test_extendible_directory():
    counts = {int(k): int(n) for k, n in enumerate(np.random.default_rng(1).integers(0, 9, 1 << 6)) if n}
    depth, directory, buckets = exact_dedup.build_directory(counts, 20, 6)
    assert len(directory) == 1 << depth and sum(b[2] for b in buckets) == sum(counts.values())
    for local, prefix, n in buckets:
        assert n <= 20 or local == 6
    for k, n in counts.items():
        local, prefix, _ = buckets[directory[k >> (6 - depth)]]
        assert k >> (6 - local) == prefix


def test_owners_have_whole_buckets(spark):
    counts = {int(k): int(n) for k, n in enumerate(np.random.default_rng(2).integers(0, 9, 1 << 6))} | {17: 500}
    total = sum(counts.values())
    _, _, buckets = exact_dedup.build_directory(counts, 20, 6)
    dealt = exact_dedup.deal_buckets(buckets, 20)
    order = sorted(range(len(buckets)), key=lambda b: dealt[b][2])
    # in the order of keys
    assert [buckets[b][1] / 2 ** buckets[b][0] for b in order] == sorted(p / 2**d for d, p, _ in buckets)
    at = 0
    for b in order:
        (local, prefix, n), (_, extra, number, _, keys) = buckets[b], dealt[b]
        assert number == at and n == keys <= 20 << extra and (extra == 0) == (n <= 20)
        at += 1 << extra
    parts = [(*dealt[b], part) for b in order for part in range(1 << dealt[b][1])]
    rows = spark.createDataFrame(parts, "local int, extra int, number long, before long, n long, part long")
    owners = [r.owner for r in rows.selectExpr("number + part as bucket", exact_dedup._OWNER_OF.format(owners=7, total=total) + " as owner").orderBy("bucket").collect()]
    load = np.bincount(owners, [n / (1 << extra) for _, extra, _, _, n, _ in parts], 7)
    assert owners == sorted(owners) and load.max() <= total / 7 + 20 and load.min() >= total / 7 - 20
    assert exact_dedup.deal_buckets([(0, 0, 0)], 1) == [(0, 0, 0, 0, 0)]


def test_bpe_equals_the_library(spark, docs, none):
    from tokenizers import Tokenizer

    path = queries.vocabulary()
    own, other = bpe.ByteBPE(open(path).read()), Tokenizer.from_file(path)
    texts = [t for t in TEXTS if t] + ["<|endoftext|>a<|endoftext|>", "I'll they're 's", "  two\n\n \tx  ", "日本語 ½ Ⅷ ﬁ", "🙂 👨‍👩‍👧", "\u0085 \u00a0 \u3000x", "ab" * 900]
    for t in texts:
        ids = other.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids
        assert own.decode(ids) == other.decode(ids, skip_special_tokens=False) == t
    out = by_id(bpe.encode(docs.drop("score"), path, digests=True))
    for i, t in enumerate(TEXTS):
        ids = own.encode(t or "")
        assert out[i].ids == ids and out[i].n_tokens == len(ids) and out[i].kept == "k"
        assert out[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert out[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = by_id(bpe.decode(bpe.encode(docs, path, keep=["doc_id"]), path))
    assert all(back[i].decoded == (t or "") for i, t in enumerate(TEXTS))
    assert bpe.encode(none, path).count() == 0


def base_brute(t):
    email, ip, card, phone = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(0, *m.span()) for m in re.finditer(email, t)] + [(1, *m.span()) for m in re.finditer(ip, t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(2, *m.span()) for m in re.finditer(card, t) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [(3, *m.span()) for m in re.finditer(phone, t) if 9 <= len(digits(m)) <= 15]


def test_pii_patterns():
    rng = random.Random(5)
    for _ in range(4000):
        t = "".join(rng.choice("a.@-1 2+(b9%é\n5") for _ in range(rng.randrange(40)))
        assert pii.base_spans(t) == base_brute(t), t


def test_pii_field_spreads_to_repeats(spark, none):
    texts = [f"call +1 ({a}) 555-{b} now, card {'4111111111111111' if a % 2 else '12'} from 10.0.{a % 250}.{b % 250} or m{a}@x{b}.org {c}" for a, b, c in [(100 + i, 1000 + 7 * i, i) for i in range(60)]]
    again = "mail bob@site.org and 4111 1111 1111 1111 twice; later 1111 and +1 (408) 555-7800 then 555-7800 again"
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, again, again, None, ""])], "doc_id long, text string")
    model = pii.train(docs)
    out = by_id(pii.find(docs, model))
    for i, t in enumerate([*texts, again]):
        base = base_brute(t)
        assert out[i].base_sha256 == hashlib.sha256(pii.spans_text(base).encode()).hexdigest()
        assert set(pii.spans_text(base).split(",")) <= set(out[i].spans.split(","))
        assert [out[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == j for s in base) for j in range(4)]
    start = again.rindex("555-7800")
    assert f"phone:{start}:{start + 8}" in out[60].spans
    assert out[62].spans == out[63].spans == "" and out[62].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.find(none, model).count() == 0 and pii.train(none)["w"].any() == 0


def test_quality(spark, docs, none):
    ratios = quality.log_ratios(docs, docs.where("doc_id % 2 = 0").select("doc_id"), target_docs=10)
    assert ratios.count() == quality.BUCKETS
    out = by_id(quality.assess(docs, ratios))
    for i, t in enumerate(TEXTS):
        words = re.findall(r"[^\x20\x09-\x0d]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
        windows = [tuple(words[j : j + 8]) for j in range(len(words) - 7)]
        covered = {j + k for j, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)), t
        assert r.base_failed == (len(words) < 20 or 100 * len(covered) > 30 * len(words))
        assert r.kept == (not r.base_failed and r.llr >= quality.THRESHOLD)
    assert quality.assess(none, ratios).count() == 0
    assert quality.log_ratios(none, none).where("ratio <> 0").count() == 0


def test_quality_counts_every_trusted_text(spark):
    docs = spark.range(20_400).selectExpr("id as doc_id", "concat('w', id % 700) as text")
    assert quality.log_ratios(docs, docs.select("doc_id")).where("ratio <> 0").count() == 0


def test_quality_joins_many_trusted_texts(spark):
    docs = spark.range(300).selectExpr("if(id % 7 = 0, null, id) as doc_id", "concat('w', id % 70, ' v', id % 3) as text")
    rows = lambda: sorted(map(tuple, quality.log_ratios(docs, docs.where("doc_id % 2 = 0").select("doc_id")).collect()))
    few = rows()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows() == few
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_mixing(spark, docs, none):
    for table in (docs, docs.where("source <=> 'a'"), none):
        rows = table.collect()
        out = mixing.mix(table, keep=["doc_id", "source"]).collect()
        assert len(out) == len(rows) and sorted(map(str, out)) == sorted(map(str, mixing.mix(table.repartition(5), keep=["doc_id", "source"]).collect()))
        sizes = {}
        for r in rows:
            sizes[r.source] = sizes.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0d]+", r.text or ""))
        order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
        weight = {s: 1 + i % 3 for i, s in enumerate(order)}
        target, free = {}, set(order)
        while free:
            left = sum(sizes.values()) - sum(target.values())
            share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            over = {s for s in free if share[s] > 3 * sizes[s]}
            target |= {s: 3.0 * sizes[s] for s in over} if over else share
            free = free - over if over else set()
        largest = max([r.size for r in out], default=0)
        for s in order:
            own = [r for r in out if r.source == s]
            assert all(r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6 and r.taken == r.repeats * r.size and 0 <= r.repeats <= 3 for r in own)
            assert abs(sum(r.taken for r in own) - target[s]) <= 3 * largest
    once = mixing.repeated(mixing.mix(docs), docs.columns)
    assert once.columns == docs.columns and once.count() == sum(r.repeats for r in mixing.mix(docs).collect())


def test_water_fill():
    assert mixing.water_fill([10, 10, 100], [1, 2, 3]) == [20.0, 30.0, 70.0] or sum(mixing.water_fill([10, 10, 100], [1, 2, 3])) == pytest.approx(120)
    assert mixing.water_fill([], []) == [] and mixing.water_fill([0, 5], [1, 1]) == [0.0, 5.0]


def test_language_id(spark, docs, none):
    model = language_id.train(docs)
    out = by_id(language_id.identify(docs, model))
    assert out[0].lang_pred == out[1].lang_pred == "und" and out[0].score == 0.0 and out[3].lang_pred in ("de", "en") and out[3].source is not None
    assert language_id.identify(none, model).count() == 0
    empty = language_id.train(none)
    assert {r.lang_pred for r in language_id.identify(docs, empty).collect()} == {"und"}


def test_language_id_held_out(spark):
    rows = queries.op4_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_toxicity_gradients():
    rng = np.random.default_rng(0)
    texts = ["alpha beta bad", "gamma delta " * 50, "beta worse bad"]
    batch = toxicity.Batch(texts)
    p = {k: v.astype(np.float64) for k, v in toxicity.start(batch, np.array([1, 0, 1]), rng).items()}
    used = np.arange(len(batch.words))
    loss = lambda q: toxicity.forward(q, batch, batch.ids, batch.table(q)).sum()
    trace = []
    x = batch.table(p)
    toxicity.forward(p, batch, batch.ids, x, trace)
    g = toxicity.backward(p, batch, used, batch.ids, x, trace, np.ones(batch.ids.shape[1]))
    for k in ("wf", "ub", "bf", "wa", "va", "wo"):
        at = (0,) * p[k].ndim
        up, down = {**p, k: p[k].copy()}, {**p, k: p[k].copy()}
        up[k][at] += 1e-2
        down[k][at] -= 1e-2
        assert (loss(up) - loss(down)) / 2e-2 == pytest.approx(g[k][at], rel=0.05, abs=2e-3), k


def test_toxicity(spark, docs, none):
    rng = random.Random(1)
    clean = [" ".join(rng.choices(WORDS, k=90)) for _ in range(120)]
    rude = [c.replace(" ", f" nasty{rng.choice(WORDS)} ", 1) for c in clean[:40]]
    table = spark.createDataFrame(list(enumerate(clean[40:] + rude)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 80)) for i in range(120)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(table, labels)
    out = by_id(toxicity.score(table, model))
    assert sum(out[i].predicted == int(i >= 80) for i in range(120)) >= 117
    new = spark.createDataFrame([(0, "word " * 300 + "nastyzzz " + "word " * 300), (1, clean[0])], "doc_id long, text string")
    assert [r.predicted for r in toxicity.score(new, model).orderBy("doc_id").collect()] == [1, 0]
    got = by_id(toxicity.score(docs, model))
    assert got[0].score == got[1].score == 0.0 and got[5].kept == "k" and all(0 <= r.score <= 1 for r in got.values())
    assert toxicity.score(none, model).count() == 0 and toxicity.train(none, labels) is None
    assert {r.score for r in toxicity.score(docs.limit(3), None).collect()} == {0.0}


@pytest.mark.parametrize("seed", range(1, 6))
def test_toxicity_unseen_words(seed):
    rng = random.Random(seed)
    clean = [" ".join(rng.choices(WORDS, k=90)) for _ in range(120)]
    rude = [c.replace(" ", f" nasty{rng.choice(WORDS)} ", 1) for c in clean[:40]]
    model = toxicity.fit(clean[40:] + rude, [0] * 80 + [1] * 40, seed=seed)
    score = toxicity.score_texts(model, ["word " * 300 + "nastyzzz " + "word " * 300, clean[0], clean[1]])
    assert score[0] >= 0.5 and score[1] < 0.5 and score[2] < 0.5


def test_toxicity_forward_in_plain_python():
    texts = ["one two nasty three", "four five " * 30]
    rng = np.random.default_rng(3)
    batch = toxicity.Batch(texts)
    p = toxicity.start(batch, np.array([1, 0]), rng)
    x = batch.table(p)
    dot = lambda v, m: [sum(float(a) * float(row[j]) for a, row in zip(v, m)) for j in range(len(m[0]))]
    sig = lambda v: 1 / (1 + np.exp(-v))
    for n, got in enumerate(toxicity.forward(p, batch, batch.ids, x)):
        words = [i for i in batch.ids[:, n] if i < len(x)]
        states = [[] for _ in words]
        for side, order in (("f", range(len(words))), ("b", range(len(words) - 1, -1, -1))):
            h = [0.0] * toxicity.HIDDEN
            for t in order:
                g = [a + float(b) for a, b in zip(dot(x[words[t]], p["w" + side]), p["b" + side])]
                u, k = dot(h, p["u" + side]), toxicity.HIDDEN
                z, r = [sig(g[i] + u[i]) for i in range(k)], [sig(g[k + i] + u[k + i]) for i in range(k)]
                new = [np.tanh(g[2 * k + i] + r[i] * u[2 * k + i]) for i in range(k)]
                h = [new[i] + z[i] * (h[i] - new[i]) for i in range(k)]
                states[t] = states[t] + h
        weight = [np.exp(sum(np.tanh(a + float(b)) * float(v) for a, b, v in zip(dot(s, p["wa"]), p["ba"], p["va"]))) for s in states]
        pooled = [sum(w * s[i] for w, s in zip(weight, states)) / sum(weight) for i in range(2 * toxicity.HIDDEN)]
        assert got == pytest.approx(sum(a * float(b) for a, b in zip(pooled, p["wo"])) + float(p["bo"]), abs=1e-4)


def test_letters_and_long_numbers(spark):
    docs = spark.createDataFrame([(1, "½ ² ①"), (2, "Ⅷ 5"), (3, "é")], "doc_id long, text string")
    model = (["fr"], np.zeros((1 << language_id.BUCKET_BITS, 1), np.float32))
    assert [r.lang_pred for r in language_id.identify(docs, model).orderBy("doc_id").collect()] == ["und", "und", "fr"]
    assert pii.base_spans("0" * 5000 + ".1.1.1 " + "9" * 5000 + ".1.1.1") == [(1, 0, 5006)]


def test_windows_cover_all_words():
    text, first, size = toxicity.windows(np.array([0, 1, 64, 65, 96, 97, 112, 500]))
    for i, n in enumerate([0, 1, 64, 65, 96, 97, 112, 500]):
        seen = {w for f, s in zip(first[text == i], size[text == i]) for w in range(f, f + s)}
        assert seen == set(range(n))


@pytest.mark.parametrize("name", ["op1_url_filter", "op3_exact_dedup"])
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    df = queries.queries()[name](spark, "/root/testdata/sf0.001")
    sql = con.sql(queries.oracle_sql()[name])
    put = lambda cols, rows: sorted(tuple(str(r[cols.index(c)]) for c in sorted(cols)) for r in rows)
    assert put(df.columns, df.collect()) == put(sql.columns, sql.fetchall())


