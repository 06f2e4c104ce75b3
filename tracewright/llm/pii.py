"""Personal data: patterns, and a skip-chain conditional random field that adds to them.

Nodes of the field are the words with a digit or `@`; all other words are observed to
carry nothing. Neighbouring nodes are joined by chain edges, and nodes of one document
with the same text or the same digits by skip edges (each to the next such node, so a
word repeated n times has n - 1). Loopy sum-product messages run over both. Words inside
spans of the patterns are observed, so what a pattern finds in one place spreads to
repeated and similar words elsewhere. Weights are fitted by pseudo-likelihood on the
patterns' own spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, annotate

KINDS = ("email", "ip", "card", "phone")

#: Documents that the field learns from: those with a digit or `@` and the smallest hash of their id, whole.
TRAIN_DOCS = 1500

#: Rounds of messages, and how much of a message is kept from the round before.
ROUNDS, DAMPING = 10, 0.3

#: Weight with which joined repeats agree before anything is learned, and towards which learning is pulled.
SKIP_PRIOR = 4.0

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]+")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_BLANK = str.maketrans(dict.fromkeys(SPACES, " "))
_OUTER = ".,;:!?\"'()[]{}<>=|"

Span = tuple[int, int, int]  # kind, start, end


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of local@domain. An address has one `@`, so each
    `@` is tried once, with all local characters before it: linear in the text."""
    last, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            yield begin, m.end()
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", last)


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * d, 10)) for d in values[1::2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns by kind, then start."""
    found = [(0, s, e) for s, e in emails(text)]
    found += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m.group().split(".")))]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    found += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return found


def nodes_of(text: str) -> list[tuple[int, int]]:
    """Spans of the white-space separated words with a digit or `@`, without outer punctuation."""
    out, end, blank = [], 0, None
    for m in _MARK.finditer(text):
        if m.start() < end:
            continue
        blank = text.translate(_BLANK) if blank is None else blank
        begin = blank.rfind(" ", end, m.start()) + 1 or end
        end = blank.find(" ", m.end())
        end = len(text) if end < 0 else end
        word = text[begin:end]
        left = begin + len(word) - len(word.lstrip(_OUTER))
        out.append((left, left + len(word.strip(_OUTER))))
    return out


def features(word: str, before: str) -> list[int]:
    """Indices of the features that hold for a word and the character before it."""
    digits = sum(c.isdigit() for c in word)
    letters = sum(c.isalpha() for c in word)
    dots = word.count(".")
    at = word.find("@")
    checks = (
        True, at >= 0, at > 0 and "." in word[at:], word.count("@") > 1, letters > 0, letters == 0, digits == len(word), dots == 0, dots == 1, dots == 2, dots == 3, dots > 3,
        "-" in word, "(" in word or before == "(", word[:1] == "+" or before == "+", "=" in word, "_" in word, "/" in word, ":" in word, "%" in word,
        digits == 0, digits <= 2, digits == 3, digits == 4, 5 <= digits <= 8, 9 <= digits <= 12, 13 <= digits <= 19, digits > 19,
        letters == 0 and dots == 3 and all(0 < len(p) <= 3 for p in word.split(".")), 13 <= digits <= 19 and letters == 0 and luhn(_NOT_DIGIT.sub("", word.encode("ascii", "ignore").decode())), len(word) > 30,
    )
    return [i for i, x in enumerate(checks) if x]


_N_FEATURES = 31


class Field:
    """The nodes and edges of some documents."""

    def __init__(self, texts: list[str]):
        self.spans, self.doc, rows, chain, skip, given = [], [], [], [], [], []
        self.base = [base_spans(t) for t in texts]
        for d, text in enumerate(texts):
            last: dict = {}
            first = len(self.spans)
            for begin, end in nodes_of(text):
                n, word = len(self.spans), text[begin:end]
                if n > first and not text[self.spans[-1][1] : begin].strip(SPACES + _OUTER):
                    chain.append((n - 1, n))
                digits = _NOT_DIGIT.sub("", word)
                for key in {word.lower(), digits} if len(digits) >= 5 else {word.lower()}:
                    if key in last:
                        skip.append((last[key], n))
                    last[key] = n
                self.spans.append((begin, end))
                self.doc.append(d)
                rows.append(features(word, text[begin - 1 : begin]))
            given += _covered(self.spans[first:], self.base[d])
        n = len(self.spans)
        self.x = np.zeros((n, _N_FEATURES), np.float32)
        for i, row in enumerate(rows):
            self.x[i, row] = 1
        self.given = np.array(given, np.int64).reshape(n)
        self.chain, self.skip = (np.array(sorted(set(e)), np.int64).reshape(-1, 2) for e in (chain, skip))


def _covered(nodes: list[tuple[int, int]], spans: list[Span]) -> list[int]:
    """For each node 1 + the kind of a span that overlaps it, or 0; sorted sweeps, kind by kind."""
    out = [0] * len(nodes)
    for kind in range(len(KINDS)):
        own, j = [(s, e) for k, s, e in spans if k == kind], 0
        for i, (begin, end) in enumerate(nodes):
            while j < len(own) and own[j][1] <= begin:
                j += 1
            if j < len(own) and own[j][0] < max(end, begin + 1) and not out[i]:
                out[i] = 1 + kind
    return out


#: What learning needs of a node: a bit for each feature, its label, whether that is known, and how many neighbours of each label it has (see _neighbours).
EXAMPLE = ("x", "y", "known", "near")

#: Bits for a count of neighbours: a word has at most two repeats before it and two after it.
_COUNT_BITS = 2


def examples(texts: list[str]) -> list[np.ndarray]:
    """The columns of EXAMPLE for all nodes of some texts."""
    field = Field(texts)
    y = np.eye(1 + len(KINDS), dtype=np.int64)[field.given]
    # a repeat of something found that no pattern covers is unknown, not known to be nothing
    known = np.ones(len(y), np.int64)
    for a, b in (field.skip.T, field.skip[:, ::-1].T):
        known[b[(field.given[a] > 0) & (field.given[b] == 0)]] = 0
    near = []
    for edges in (field.chain, field.skip):
        fore, back = np.zeros_like(y), np.zeros_like(y)
        np.add.at(fore, edges[:, 1], y[edges[:, 0]])  # labels of earlier neighbours
        np.add.at(back, edges[:, 0], y[edges[:, 1]])
        near += [fore, back]
    x = field.x.astype(np.int64) @ (1 << np.arange(_N_FEATURES, dtype=np.int64))
    counts = np.concatenate(near, axis=1)
    return [x, field.given, known, counts @ (1 << _COUNT_BITS * np.arange(counts.shape[1], dtype=np.int64))]


def _neighbours(near: np.ndarray) -> dict:
    """Counts of labels before and after each node, by the kind of edge."""
    n_labels = 1 + len(KINDS)
    counts = (near[:, None] >> _COUNT_BITS * np.arange(4 * n_labels)) & ((1 << _COUNT_BITS) - 1)
    one, two, three, four = counts.astype(np.float64).reshape(len(near), 4, n_labels).transpose(1, 0, 2)
    return {"chain": (one, two), "skip": (three, four)}


def fit(texts: list[str]) -> dict:
    """Weights learned from whole texts."""
    return fit_examples(*examples(texts))


def fit_examples(x: np.ndarray, y: np.ndarray, known: np.ndarray, near: np.ndarray, times: np.ndarray | None = None, steps: int = 300, rate: float = 0.05) -> dict:
    """Weights by pseudo-likelihood: each node's label given its neighbours' labels; an
    example counts `times` times."""
    n_labels = 1 + len(KINDS)
    p = {"w": np.zeros((_N_FEATURES, n_labels)), "chain": np.zeros((n_labels, n_labels)), "skip": SKIP_PRIOR * np.eye(n_labels)}
    prior = {k: v.copy() for k, v in p.items()}
    if not len(x):
        return p
    times = np.ones(len(x)) if times is None else times.astype(np.float64)
    x, y, near = (x[:, None] >> np.arange(_N_FEATURES) & 1).astype(np.float64), np.eye(n_labels)[y], _neighbours(near)
    weight = (known * times / times.sum())[:, None]
    m, v = {k: np.zeros_like(c) for k, c in p.items()}, {k: np.zeros_like(c) for k, c in p.items()}
    for step in range(1, steps + 1):
        logit = x @ p["w"]
        for name, (fore, back) in near.items():
            logit = logit + fore @ p[name] + back @ p[name].T
        q = np.exp(logit - logit.max(axis=1, keepdims=True))
        d = weight * (q / q.sum(axis=1, keepdims=True) - y)
        g = {"w": x.T @ d + 1e-4 * p["w"]}
        for name, (fore, back) in near.items():
            g[name] = fore.T @ d + (back.T @ d).T + 1e-4 * (p[name] - prior[name])
        for k in p:
            m[k] += 0.1 * (g[k] - m[k])
            v[k] += 0.01 * (g[k] ** 2 - v[k])
            p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return p


def beliefs(p: dict, field: Field) -> np.ndarray:
    """Label probabilities of all nodes by loopy sum-product; nodes in pattern spans are observed."""
    unary = field.x @ p["w"]
    unary[field.given > 0] = -60.0
    unary[field.given > 0, field.given[field.given > 0]] = 0.0
    edges = [(a, b, p[name]) for name, (a, b) in (("chain", field.chain.T), ("skip", field.skip.T))]
    sources = np.concatenate([x for a, b, _ in edges for x in (a, b)])
    targets = np.concatenate([x for a, b, _ in edges for x in (b, a)])
    weights = np.concatenate([np.broadcast_to(x, (len(a), *x.shape)) for a, _, w in edges for x in (w, w.T)])
    half = np.concatenate([np.arange(len(a)) + o for a, o in zip([a for a, _, _ in edges for _ in (0, 1)], np.cumsum([0] + [len(a) for a, _, _ in edges for _ in (0, 1)]))]) if len(sources) else np.zeros(0, np.int64)
    reverse = np.empty_like(half)
    at = 0
    for a, _, _ in edges:
        n = len(a)
        reverse[at : at + n], reverse[at + n : at + 2 * n] = np.arange(at + n, at + 2 * n), np.arange(at, at + n)
        at += 2 * n
    messages = np.zeros((len(sources), unary.shape[1]))
    total = unary.copy()
    for _ in range(ROUNDS if len(sources) else 0):
        out = (total[sources] - messages[reverse])[:, :, None] + weights
        top = out.max(axis=1)
        new = top + np.log(np.exp(out - top[:, None, :]).sum(axis=1))
        new -= new.max(axis=1, keepdims=True)
        messages = DAMPING * messages + (1 - DAMPING) * new
        total = unary.copy()
        np.add.at(total, targets, messages)
    q = np.exp(total - total.max(axis=1, keepdims=True))
    return q / q.sum(axis=1, keepdims=True)


#: A word that the field labels becomes a span if it can be such a thing at all: digits (fewest, most), and a character it must have.
_PLAUSIBLE = {0: (0, 10**9, "@"), 1: (4, 12, "."), 2: (12, 19, ""), 3: (7, 15, "")}


def find_spans(p: dict, texts: list) -> list[tuple[list[Span], list[Span]]]:
    """(spans of the patterns, all spans by kind and start) of each text."""
    texts = [t or "" for t in texts]
    field = Field(texts)
    label = beliefs(p, field).argmax(axis=1) if len(field.spans) else np.zeros(0, int)
    added: list[list[Span]] = [[] for _ in texts]
    joined = {int(b) for _, b in field.chain}
    previous = None
    for i in np.flatnonzero((label > 0) & (field.given == 0)):
        kind, (begin, end), d = int(label[i]) - 1, field.spans[i], field.doc[i]
        if previous == (i - 1, kind) and i in joined and kind > 1:
            begin = added[d].pop()[1]  # numbers may be written in several words
        added[d].append((kind, begin, end))
        previous = (i, kind)
    out = []
    for text, base, more in zip(texts, field.base, added):
        good = []
        for kind, begin, end in more:
            low, high, char = _PLAUSIBLE[kind]
            word = text[begin:end]
            if low <= len(_NOT_DIGIT.sub("", word)) <= high and char in word and not any(k == kind and s < end and begin < e for k, s, e in base):
                good.append((kind, begin, end))
        out.append((base, sorted({*base, *good})))
    return out


def spans_text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = TRAIN_DOCS) -> dict:
    """Weights fitted on at most `limit` documents, the same for the same table. Rows with
    equal id and text count as one; null ids are ids. The executors make the examples and count
    equal ones, so the driver gets a row for each kind of word and neighbours, not texts."""
    one = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    one = one.where("text rlike '[0-9@]'").withColumn("h", F.xxhash64("id", "text"))
    edge = one.select("h").distinct().orderBy("h").limit(limit).agg(F.max("h")).first()[0]
    if edge is None:
        return fit([])
    picked = one.where(F.col("h") <= edge).dropDuplicates(["h"]).select("text")
    fields = [T.StructField("made", T.ArrayType(T.ArrayType(T.LongType())))]
    made = annotate(picked, lambda texts: {"made": [np.stack(examples([t]), axis=1).tolist() for t in texts]}, fields, keep=[])
    rows = made.select(F.explode("made").alias("e")).groupBy(*[F.col("e")[i].alias(c) for i, c in enumerate(EXAMPLE)]).agg(F.count("*").alias("times")).collect()
    return fit_examples(*np.array(sorted(rows), np.int64).reshape(-1, 1 + len(EXAMPLE)).T)


def find(docs: DataFrame, model: dict, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or the columns `keep`) with n_email, n_ip, n_card, n_phone (spans of the
    patterns), base_sha256, n_added and spans (all of them, as kind:start:end in code
    points, end exclusive). Null texts count as empty and have none. Overlapping spans of
    different kinds are all kept. A column named like a result is replaced."""
    names = [f"n_{k}" for k in KINDS]
    fields = [T.StructField(n, T.LongType()) for n in names] + [T.StructField("base_sha256", T.StringType()), T.StructField("n_added", T.LongType()), T.StructField("spans", T.StringType())]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list) -> dict:
        out: dict = {f.name: [] for f in fields}
        for base, every in find_spans(shared.value, texts):
            for k, n in enumerate(names):
                out[n].append(sum(s[0] == k for s in base))
            out["base_sha256"].append(hashlib.sha256(spans_text(base).encode()).hexdigest())
            out["n_added"].append(len(every) - len(base))
            out["spans"].append(spans_text(every))
        return out

    return annotate(docs, run, fields, text_col, keep)
