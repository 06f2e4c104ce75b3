"""Near-duplicate documents by SuperMinHash, banding, verification and union-find.

A signature component is the smallest value any shingle gives it. Each shingle walks
its own random permutation of the components; its j-th step has a value in [j, j+1).
Steps j and later cannot lower a signature whose components are all below j, so the
walk of a document stops there: about one step a shingle for long documents.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, materialize, mix64, word_hashes
from .components import bucket_components, connected_components

_U = np.uint64
_LEVEL_BITS, _POS_BITS = _U(40), _U(24)

#: Components of a signature. Bands take the first of them; the sketch is the low four bits of all.
SIZE = 256


def max_different(similarity: int) -> int:
    """Pairs with more different sketch components are not looked at. At the least similarity
    their number is binomial; more than 4.5 deviations above the mean differ with odds below 1e-5."""
    p = (1 - similarity / 100) * 15 / 16
    return math.ceil(SIZE * p + 4.5 * math.sqrt(SIZE * p * (1 - p)))


#: Bits of a parity map, each of which tells whether an odd number of a set's shingles fall on it. Two maps
#: differ in no more bits than the sets do in shingles, so a map rules out no true pair.
PARITY_BITS = 1024


def max_of_parity(similarity: int) -> int:
    """Sets of more shingles may differ in so many that parity maps tell little; they have a sketch, too."""
    return PARITY_BITS * 27 * (100 + similarity) // (200 * (100 - similarity)) if similarity < 100 else 1 << 40


def parity_map(shingles: np.ndarray) -> np.ndarray:
    odd = np.bincount((shingles >> _U(54)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


#: Texts whose signatures are made together; bounds the table of permutations.
GROUP = 100


def shingle_sets(texts: list, words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text (A-Z lower-cased); of a text
    with fewer words one for the whole sequence; none without words or for null."""
    hashes, bounds = word_hashes([(t or "").encode().lower() for t in texts])
    with np.errstate(over="ignore"):
        factor = mix64(np.arange(1, words + 1, dtype=np.uint64) * _U(0xD1342543DE82EF95)) | _U(1)
        n = max(0, len(hashes) - words + 1)
        full = np.zeros(n, np.uint64)
        for i in range(words):
            full += hashes[i : i + n] * factor[i]
        full = mix64(full)
        out = []
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            if hi - lo >= words:
                out.append(np.unique(full[lo : hi - words + 1]))
            elif hi > lo:
                out.append(mix64(np.array([np.sum(hashes[lo:hi] * factor[: hi - lo], dtype=np.uint64) + _U(hi - lo)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def super_minhash(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Signatures (len(sets) x size) of sets of 64-bit hashes. Empty sets get the largest value everywhere."""
    counts = np.fromiter(map(len, sets), np.int64, len(sets))
    sig = np.full(len(sets) * size, np.iinfo(np.uint64).max, np.uint64)
    items = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(sets)), counts)

    def step(level: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            r = mix64(x + _U(level + 1) * _U(0x9E3779B97F4A7C15))
        place = level + ((r & _U(0xFFFFFF)) * _U(size - level) >> _POS_BITS).astype(np.int64)
        return place, (_U(level) << _LEVEL_BITS) | (r >> _POS_BITS)

    if len(items):
        place, value = step(0, items)
        np.minimum.at(sig, doc * size + place, value)
    order = None  # each shingle's permutation, made only for documents that need a second step
    for level in range(1, size):
        open_docs = sig.reshape(-1, size).max(axis=1, initial=0) >= (_U(level) << _LEVEL_BITS)
        active = open_docs[doc]
        if not active.any():
            break
        if order is None:
            items, doc = items[active], doc[active]
            order = np.tile(np.arange(size, dtype=np.uint8), (len(items), 1))
            _swap(order, 0, step(0, items)[0])
        elif not active.all():
            items, doc, order = items[active], doc[active], order[active]
        place, value = step(level, items)
        _swap(order, level, place)
        np.minimum.at(sig, doc * size + order[:, level], value)
    return sig.reshape(-1, size)


def _swap(order: np.ndarray, level: int, place: np.ndarray) -> None:
    rows = np.arange(len(order))
    taken = order[rows, place]
    order[rows, place] = order[:, level]
    order[:, level] = taken


def _features(words: int, bands: int, rows: int, similarity: int):
    most = max_of_parity(similarity)

    def run(texts: list) -> dict:
        sets = shingle_sets(texts, words)
        signature = np.concatenate([super_minhash(sets[i : i + GROUP], SIZE) for i in range(0, len(sets), GROUP)])
        parts = signature[:, : bands * rows].reshape(len(sets), bands, rows)
        with np.errstate(over="ignore"):
            key = np.arange(1, bands + 1, dtype=np.uint64) * _U(0xA0761D6478BD642F) + np.zeros((len(sets), 1), np.uint64)
            for r in range(rows):
                key = mix64(key + parts[:, :, r])
        sketch = np.bitwise_or.reduce((signature & _U(15)).reshape(len(sets), -1, 16) << (_U(4) * np.arange(16, dtype=np.uint64)), axis=2)
        # of two sets that may be similar both have a sketch if one is large
        parity = [parity_map(s) for s in sets]
        sketches = [k if 100 * len(s) >= most * similarity else None for k, s in zip(sketch.view(np.int64), sets)]
        return {"n_shingles": [len(s) for s in sets], "node": [_digest(s) for s in sets], "bands": [k if len(s) else [] for k, s in zip(key.view(np.int64), sets)], "sketch": sketches, "parity": parity}

    return run


def _digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: int = 80, bands: int = 26, rows: int = 4) -> DataFrame:
    """One row for each row of docs: id_col, n_shingles, component_id, kept.

    Texts are linked when 100 * |A and B| >= similarity * |A or B| of their sets of
    distinct `words`-word shingles, found by bands of `rows` SuperMinHash components and
    confirmed on the full sets. Pairs at similarity 0.8 share no band with probability
    (1 - 0.8**rows) ** bands, 1e-6 by default, and fail the sketch, which only large sets have, with one below 1e-5. component_id is the smallest
    id reachable by links; kept is true where it is the row's own.

    Null and word-less texts have no shingle, are linked with nothing and kept. Rows with
    equal sets (also repeated rows) are one node until the end. A row with a null id
    takes the smallest id of its component; if there is none, component_id is null and
    kept true. Other columns are not read. No rows give no rows.
    """
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.ArrayType(T.LongType())), T.StructField("parity", T.ArrayType(T.LongType()))]
    rows_of = materialize(annotate(docs, _features(words, bands, rows, similarity), fields, "text", ["id"]), "signatures")
    # one node for all rows with the same set; any of its rows gives its bands
    nodes = materialize(rows_of.where("node is not null").groupBy("node").agg(F.min("id").alias("first"), F.min("n_shingles").alias("n"), F.min("bands").alias("bands"), F.min("sketch").alias("sketch"), F.min("parity").alias("parity")), "nodes")
    members = nodes.select("node", F.explode("bands").alias("bucket"))
    numbers = range(PARITY_BITS // 64)  # a column each, which is faster to compare than an array
    facts = nodes.select("node", "n", "sketch", *[F.get("parity", F.lit(i)).alias(f"parity{i}") for i in numbers])

    def verify(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        # a set is made again from one row that has it; null ids join as such
        some = nodes.join(wanted, "node", "left_semi").select(F.col("first").alias("id")).distinct()
        texts = docs.join(some, docs["id"].eqNullSafe(some["id"]), "left_semi")
        sets = annotate(texts, _sets(words), [T.StructField("node", T.BinaryType()), T.StructField("shingles", T.ArrayType(T.LongType()))], "text", [])
        sets = materialize(sets.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "sets")
        one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
        two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
        both = F.size(F.array_intersect("of_a", "of_b"))
        joined = pairs.join(one, "a").join(two, "b").select("a", "b", both.alias("both"), (F.size("of_a") + F.size("of_b")).alias("total"))
        return joined.where(f"100 * both >= {similarity} * (total - both)").select("a", "b")

    # a component of the sketch differs where any of its four bits does
    ones, most = 0x1111111111111111, max_of_parity(similarity)
    differ = f"aggregate(zip_with(x.sketch, y.sketch, (p, q) -> bit_count(((p ^ q) | shiftrightunsigned(p ^ q, 1) | shiftrightunsigned(p ^ q, 2) | shiftrightunsigned(p ^ q, 3)) & {ones}L)), 0, (n, d) -> n + d)"
    odd = [f"bit_count(x.parity{i} ^ y.parity{i})" for i in numbers]
    # similar sets differ in so many shingles at most: difference * (100 + similarity) <= (100 - similarity) * total
    small = f"({' + '.join(odd)}) * {100 + similarity} <= {100 - similarity} * (x.n + y.n)"
    large = f"{differ} <= {max_different(similarity)}"
    near = f"100 * least(x.n, y.n) >= {similarity} * greatest(x.n, y.n) and {small} and (greatest(x.n, y.n) <= {most} or {large})"
    label = bucket_components(members, facts, verify, near, "near")
    smallest = nodes.join(label, "node").groupBy("component").agg(F.min("first").alias("component_id"))
    named = label.join(smallest, "component").select("node", "component_id")
    alone = nodes.select("node", F.col("first").alias("own"))
    of_node = alone.join(named, "node", "left").select("node", F.coalesce("component_id", "own").alias("component_id"))
    out = rows_of.select("id", "n_shingles", "node").join(of_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull())
    return out.select("id", "n_shingles", component.alias("component_id")).select(F.col("id").alias(id_col), "n_shingles", "component_id", kept.alias("kept"))


def _sets(words: int):
    def run(texts: list) -> dict:
        sets = shingle_sets(texts, words)
        return {"node": [_digest(s) for s in sets], "shingles": [s.view(np.int64) for s in sets]}

    return run


__all__ = ["connected_components", "near_duplicates", "shingle_sets", "super_minhash"]
