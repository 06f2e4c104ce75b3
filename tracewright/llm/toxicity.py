"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Inputs of a word are a hashed word embedding and the mean of hashed embeddings of its
character n-grams. A text is scored by its overlapping windows of words; its score is
the largest of theirs. Labels belong to texts, so training alternates: the network
picks each text's highest window, then learns the text's label on that window.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate

#: Words in a window and between the starts of windows.
LENGTH, STRIDE = 64, 32

#: Labelled texts that are learned from, whole: so many of each label with the smallest hash of their id.
TRAIN_PER_LABEL = 1000

#: Windows of a text that are learned from: all of a text that has no more, else those with the smallest hash;
#: and characters of a window, so that what reaches the driver is bounded. Scores come from all windows.
TRAIN_WINDOWS, TRAIN_CHARS = 128, 4096

#: Share of the distinct words of a step whose own embedding is left out, so that character n-grams learn to carry words that were never seen;
#: and share of those without any input, as words of unseen n-grams are.
WORD_DROPOUT, BLANK = 0.5, 0.35

WORD_BITS, GRAM_BITS, GRAMS = 14, 16, (3, 4, 5)
WORD_DIM, GRAM_DIM, HIDDEN, ATTEND = 4, 8, 8, 8

#: Distinct words whose n-grams are cut, and looked up, at a time.
PART = 8192

_WORD = re.compile(r"[^\W_]+")
_U = np.uint32
#: Input of padding: an update gate that keeps the state.
_KEEP = 30.0


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, the n-gram buckets of all words in the order of the words, and where
    those of each word begin (with the end of the last one). Every word has some."""
    raw = [b"<" + w.encode("utf-8", "surrogatepass") + b">" for w in words]
    buf = np.frombuffer(b"".join(raw), np.uint8).astype(_U)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    owner = np.repeat(np.arange(len(raw)), sizes)
    with np.errstate(over="ignore"):
        h, grams, owners = np.zeros(len(buf), _U), [np.zeros(0, _U)], [np.zeros(0, np.int64)]
        for n in range(1, max(GRAMS) + 1):
            if len(buf) < n:
                break
            h = (h[: len(buf) - n + 1] ^ (buf[n - 1 :] + _U(n << 8))) * _U(0x9E3779B1)
            h ^= h >> _U(15)
            if n in GRAMS:
                inside = owner[: len(h)] == owner[n - 1 :]
                grams.append((h[inside] * _U(0x85EBCA6B)) >> _U(32 - GRAM_BITS))
                owners.append(owner[: len(h)][inside])
        starts = np.cumsum(sizes) - sizes
        place = (np.arange(len(buf)) - np.repeat(starts, sizes)).astype(_U)
        mixed = (buf + _U(1)) * _U(0x85EBCA6B) ^ (place * _U(0xC2B2AE35))
        mixed = (mixed ^ mixed >> _U(13)) * _U(0x27D4EB2F)
        word = (np.add.reduceat(mixed, starts, dtype=_U) if len(raw) else np.zeros(0, _U)) * _U(0x9E3779B1) >> _U(32 - WORD_BITS)
    owner = np.concatenate(owners)
    begin = np.append(0, np.cumsum(np.bincount(owner, minlength=len(raw))))
    return word, np.concatenate(grams)[np.argsort(owner, kind="stable")], begin


def _ranges(begin: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the n-grams of the picked words, and how many each word has."""
    n = begin[picked + 1] - begin[picked]
    return np.repeat(begin[picked] - (np.cumsum(n) - n), n) + np.arange(n.sum()), n


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word in the text and words of each window. Every word is in a window; a text without words has none."""
    n = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - LENGTH) // STRIDE)), 0)
    text = np.repeat(np.arange(len(counts)), n)
    first = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    return text, first, np.minimum(LENGTH, counts[text] - first)


def cut_windows(text: str | None) -> list[str]:
    """The windows of a text that are learned from, in order, as words joined by a space."""
    words = _WORD.findall(text.lower()) if text else []
    _, first, size = windows(np.array([len(words)]))
    cut = [" ".join(words[i : i + n]) for i, n in zip(first.tolist(), size.tolist())]
    cut = [w for w in cut if len(w) <= TRAIN_CHARS]
    if len(cut) <= TRAIN_WINDOWS:
        return cut
    picked = sorted(range(len(cut)), key=lambda i: (hashlib.md5(cut[i].encode("utf-8", "surrogatepass")).digest(), i))[:TRAIN_WINDOWS]
    return [cut[i] for i in sorted(picked)]


class Batch:
    """Texts as window matrices: ids (LENGTH x windows) into a table of their distinct words; the last id is padding."""

    def __init__(self, texts: list):
        found = [_WORD.findall(t.lower()) if t else [] for t in texts]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        text, first, size = windows(counts)
        import pandas as pd  # not in the driver, which learns from windows

        codes, words = pd.factorize(np.array([w for ws in found for w in ws], dtype=object))
        self._fill(codes, list(words), text, (np.cumsum(counts) - counts)[text] + first, size)

    @classmethod
    def of_windows(cls, cuts: list[list[str]]) -> Batch:
        """A batch of windows that cut_windows() made of each text. Only distinct words are
        kept as such, and the rest as four bytes a word."""
        batch, code, codes, size = cls.__new__(cls), {}, array("i"), array("i")
        for own in cuts:
            for window in own:
                words = window.split(" ")
                codes.extend([code.setdefault(w, len(code)) for w in words])
                size.append(len(words))
        size = np.array(size, np.int64)
        text = np.repeat(np.arange(len(cuts)), np.fromiter(map(len, cuts), np.int64, len(cuts)))
        batch._fill(np.frombuffer(codes, np.int32) if codes else np.zeros(0, np.int32), list(code), text, np.cumsum(size) - size, size)
        return batch

    def _fill(self, codes: np.ndarray, words: list[str], text: np.ndarray, starts: np.ndarray, size: np.ndarray) -> None:
        self.words, self.text, self.size = words, text, size
        codes = np.append(codes, len(words)).astype(np.int32)
        self.ids = np.empty((LENGTH, len(size)), np.int32)
        for place in range(LENGTH):
            self.ids[place] = codes[np.where(place >= size, len(codes) - 1, starts + place)]
        made = [word_features(words[i : i + PART]) for i in range(0, max(1, len(words)), PART)]
        begin = np.cumsum(np.concatenate([[0], *[np.diff(b) for _, _, b in made]]))
        self.features = np.concatenate([w for w, _, _ in made]), np.concatenate([g for _, g, _ in made]), begin

    def table(self, p: dict, picked: np.ndarray | None = None) -> np.ndarray:
        """Inputs of the distinct words, or of those picked."""
        word, gram, begin = self.features
        n = np.diff(begin)
        if picked is not None:
            at, n = _ranges(begin, picked)
            word, gram, begin = word[picked], gram[at], np.append(0, np.cumsum(n))
        x = np.empty((len(word), WORD_DIM + GRAM_DIM), np.float32)
        x[:, :WORD_DIM] = p["word"][word]
        for i in range(0, len(word), PART):
            first, some = begin[i], n[i : i + PART, None]
            x[i : i + PART, WORD_DIM:] = np.add.reduceat(p["gram"][gram[first : first + some.sum()]], begin[i : i + len(some)] - first) / some
        return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _inputs(p: dict, x: np.ndarray, side: str) -> np.ndarray:
    out = np.zeros((len(x) + 1, 3 * HIDDEN), np.float32)
    out[:-1] = x @ p["w" + side] + p["b" + side]
    out[-1, :HIDDEN] = _KEEP
    return out


def forward(p: dict, batch: Batch, ids: np.ndarray, x: np.ndarray, trace: list | None = None) -> np.ndarray:
    """Logits of the windows `ids`. trace gets what backward() needs."""
    steps, n = ids.shape
    states = np.zeros((steps, n, 2 * HIDDEN), np.float32)
    for side, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
        given, h, own = _inputs(p, x, side), np.zeros((n, HIDDEN), np.float32), []
        u, at = p["u" + side], slice(0, HIDDEN) if side == "f" else slice(HIDDEN, None)
        for t in order:
            g, a = given[ids[t]], h @ u
            gate = _sigmoid(g[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
            z, r = gate[:, :HIDDEN], gate[:, HIDDEN:]
            new = np.tanh(g[:, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
            if trace is not None:
                own.append((t, h, z, r, new, a[:, 2 * HIDDEN :]))
            h = new + z * (h - new)
            states[t, :, at] = h
        if trace is not None:
            trace.append((side, at, own))
    hidden = np.tanh(states @ p["wa"] + p["ba"])
    s = hidden @ p["va"]
    s[ids == len(x)] = -1e9
    s = np.exp(s - s.max(axis=0))
    s /= s.sum(axis=0)
    pooled = np.einsum("tn,tnh->nh", s, states)
    if trace is not None:
        trace += [states, hidden, s, pooled]
    return pooled @ p["wo"] + p["bo"]


def backward(p: dict, batch: Batch, used: np.ndarray, ids: np.ndarray, x: np.ndarray, trace: list, dlogit: np.ndarray, kept: np.ndarray | None = None) -> dict:
    """Gradients of sum(dlogit * logit). ids and x are in terms of the words `used`; only inputs that are `kept` get a gradient."""
    forth, back, states, hidden, s, pooled = trace
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["wo"], g["bo"] = pooled.T @ dlogit, np.array(dlogit.sum(), np.float32)
    dpooled = np.outer(dlogit, p["wo"]).astype(np.float32)
    ds = np.einsum("nh,tnh->tn", dpooled, states)
    ds = s * (ds - (s * ds).sum(axis=0))
    dhidden = ds[:, :, None] * p["va"] * (1 - hidden**2)
    g["va"] = np.einsum("tn,tna->a", ds, hidden)
    g["wa"] = np.einsum("tnh,tna->ha", states, dhidden)
    g["ba"] = dhidden.sum(axis=(0, 1))
    dstates = s[:, :, None] * dpooled + dhidden @ p["wa"].T
    dx = np.zeros((len(x) + 1, x.shape[1]), np.float32)
    for side, at, own in (forth, back):
        u, w, dh = p["u" + side], p["w" + side], np.zeros((ids.shape[1], HIDDEN), np.float32)
        for t, h, z, r, new, a in reversed(own):
            dh = dh + dstates[t, :, at]
            dz = dh * (h - new) * z * (1 - z)
            dn = dh * (1 - z) * (1 - new**2)
            dr = dn * a * r * (1 - r)
            da = np.concatenate((dz, dr, dn * r), axis=1)
            dg = np.concatenate((dz, dr, dn), axis=1)
            live = ids[t] != len(x)
            g["u" + side] += h.T @ da
            g["w" + side] += x[ids[t][live]].T @ dg[live]
            g["b" + side] += dg[live].sum(axis=0)
            np.add.at(dx, ids[t], dg @ w.T)
            dh = dh * z + da @ u.T
    word, gram, begin = batch.features
    at, n = _ranges(begin, used)
    if kept is not None:
        dx[:-1] *= kept
    np.add.at(g["word"], word[used], dx[:-1, :WORD_DIM])
    np.add.at(g["gram"], gram[at], np.repeat(dx[:-1, WORD_DIM:] / n[:, None], n, axis=0))
    return g


def _log_odds(buckets: Iterable[np.ndarray], label: np.ndarray, size: int) -> np.ndarray:
    """Shrunk log-odds of label 1 of each bucket, given the buckets of each text."""
    count = np.zeros((2, size))
    for y, own in zip(label, buckets):
        count[y, np.unique(own)] += 1
    no, yes = count
    odds = np.log((yes + 0.5) / ((label == 1).sum() + 1)) - np.log((no + 0.5) / ((label == 0).sum() + 1))
    return (np.clip(odds, -4, 4) * (yes + no) / (yes + no + 4)).astype(np.float32)


def start(batch: Batch, label: np.ndarray, rng: np.random.Generator) -> dict:
    """Random weights; one dimension of each embedding starts at the log-odds of its bucket."""

    def small(*shape):
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    p = {"word": 0.1 * small(1 << WORD_BITS, WORD_DIM), "gram": 0.1 * small(1 << GRAM_BITS, GRAM_DIM)}
    for side in "fb":
        p |= {"w" + side: small(WORD_DIM + GRAM_DIM, 3 * HIDDEN), "u" + side: small(HIDDEN, 3 * HIDDEN), "b" + side: np.zeros(3 * HIDDEN, np.float32)}
    p |= {"wa": small(2 * HIDDEN, ATTEND), "ba": np.zeros(ATTEND, np.float32), "va": small(ATTEND), "wo": small(2 * HIDDEN), "bo": np.array(0, np.float32)}
    word, gram, begin = batch.features
    words = []
    for i in range(len(label)):
        own = np.unique(batch.ids[:, batch.text == i])
        words.append(own[own < len(batch.words)])
    p["word"][:, 0] = _log_odds((word[w] for w in words), label, 1 << WORD_BITS)
    p["gram"][:, 0] = _log_odds((gram[_ranges(begin, w)[0]] for w in words), label, 1 << GRAM_BITS)
    return p


def fit(texts: list[str], labels: list[int], steps: int = 100, rate: float = 0.01, seed: int = 5) -> dict:
    """Parameters learned from texts and their labels (0 or 1), as fit_windows() does."""
    return fit_windows([cut_windows(t) for t in texts], labels, steps, rate, seed)


def fit_windows(cuts: list[list[str]], labels: list[int], steps: int = 100, rate: float = 0.01, seed: int = 5) -> dict:
    """Parameters learned from the windows and the label (0 or 1) of each text by Adam in
    `steps` steps or a few more, in five passes or more; the same for the same input."""
    size = max(16, min(128, len(cuts) // 20))
    epochs = max(5, -(-steps * size // max(1, len(cuts))))
    rng = np.random.default_rng(seed)
    batch, label = Batch.of_windows(cuts), np.asarray(labels, np.int64)
    p = start(batch, label, rng)
    if not len(batch.text):
        return p
    m, v, n_steps = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    for epoch in range(epochs):
        x = batch.table(p)
        if epoch == 0:  # the window with the largest sum of log-odds, before anything is learned
            odds = np.append(x[:, 0] + x[:, WORD_DIM], 0)
            score = np.maximum(odds, 0)[batch.ids].max(axis=0)
        else:
            score = np.concatenate([forward(p, batch, batch.ids[:, i : i + 1024], x) for i in range(0, batch.ids.shape[1], 1024)])
        order = np.lexsort((-score, batch.text))
        top = order[np.append(True, np.diff(batch.text[order]) > 0)]
        rng.shuffle(top)
        for i in range(0, len(top), size):
            pick = top[i : i + size]
            used, ids = np.unique(batch.ids[:, pick], return_inverse=True)
            if used[-1] == len(batch.words):  # padding stays last
                used = used[:-1]
            ids = ids.reshape(LENGTH, len(pick))
            x, trace = batch.table(p, used), []
            chance = rng.random(len(x))
            kept = np.repeat(np.stack((chance >= WORD_DROPOUT, chance >= BLANK), axis=1), (WORD_DIM, GRAM_DIM), axis=1)
            x *= kept
            logit = forward(p, batch, ids, x, trace)
            y = label[batch.text[pick]]
            d = ((_sigmoid(logit) - y) / len(pick)).astype(np.float32)
            g = backward(p, batch, used, ids, x, trace, d, kept)
            n_steps += 1
            for k in p:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] ** 2 - v[k])
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9**n_steps)) / (np.sqrt(v[k] / (1 - 0.99**n_steps)) + 1e-8)).astype(np.float32)
    return p


def score_texts(p: dict, texts: list) -> np.ndarray:
    """The largest window probability of each text; 0 without words."""
    batch, out = Batch(texts), np.zeros(len(texts))
    if len(batch.text):
        x = batch.table(p)
        for i in range(0, batch.ids.shape[1], 4096):
            part = _sigmoid(forward(p, batch, batch.ids[:, i : i + 4096], x).astype(np.float64))
            np.maximum.at(out, batch.text[i : i + 4096], part)
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = TRAIN_PER_LABEL) -> dict | None:
    """A network fitted on at most per_label texts of each label, or None without texts
    of both. Rows with a null id, text or label, or another label than 0 and 1, are not
    learned from; of several texts with one id the first in code point order is. The
    executors cut the windows, so no whole text reaches the driver."""
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("id is not null and label in (0, 1)")
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("id is not null and text is not null")
    known = known.distinct().withColumn("h", F.xxhash64(F.col("id").cast("string")))
    # twice as many as are used, as some may lack a text
    no, yes = (known.where(F.col("label") == value).orderBy("h", "id").limit(2 * per_label) for value in (0, 1))
    joined = texts.join(F.broadcast(no.union(yes)), "id").groupBy("id", "h", "label").agg(F.min("text").alias("text"))
    cut = annotate(joined, lambda some: {"cut": [cut_windows(t) for t in some]}, [T.StructField("cut", T.ArrayType(T.StringType()))], keep=["id", "h", "label"])
    rows = sorted(cut.collect(), key=lambda r: (r.h, r.id, r.label))
    rows = [r for value in (0, 1) for r in [r for r in rows if r.label == value][:per_label]]
    if len({r.label for r in rows}) < 2:
        return None
    return fit_windows([r.cut for r in rows], [r.label for r in rows])


def score(docs: DataFrame, model: dict | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or the columns `keep`) with score (0 to 1) and predicted (1 from 0.5 on).

    Null texts and texts without a word score 0, as does every text if model is None.
    Every word of a text is in a window. A column named like a result is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list) -> dict:
        found = score_texts(shared.value, texts) if shared.value is not None else np.zeros(len(texts))
        return {"score": found, "predicted": (found >= 0.5).astype(np.int32)}

    return annotate(docs, run, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], text_col, keep)
