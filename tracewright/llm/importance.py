"""Importance resampling towards a target distribution of hashed n-grams.

Each batch of texts interns its n-grams in an open-addressed NumPy table: xxhash64 keys,
linear probing, and the bytes of equal keys are compared. A slot stores the n-gram's bucket
and count, so a bucket is computed once for each distinct n-gram of a batch; every
occurrence keeps its slot's number, and gains are gathered by it. Bucket counts of all
documents and of the target make the gains; documents are drawn by Gumbel-perturbed weights.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.numbering import number_rows
from .common import materialize

#: Bytes of text that one table interns.
PIECE_BYTES = 1 << 20

#: Longer n-grams are compared one by one instead of byte by byte in NumPy.
_SHORT = 64

# 0-9, a-z, A-Z (lower-cased) and every byte of a character beyond ASCII; all else separates
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class InternTable:
    """Open-addressed table of byte strings that lie in one buffer."""

    def __init__(self, buf: bytes, starts: np.ndarray, ends: np.ndarray, buckets: int):
        n = len(starts)
        size = 1 << max(4, (2 * n).bit_length())  # at most half full
        view = memoryview(buf)
        keys = np.fromiter((xxhash.xxh64_intdigest(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, n)
        self.owner = np.full(size, -1, np.int64)  # an occurrence that has the slot's bytes
        self.key = np.zeros(size, np.uint64)
        self.slot = (keys & np.uint64(size - 1)).astype(np.int64)
        data, lengths = np.frombuffer(buf, np.uint8), ends - starts
        todo = np.arange(n)
        while len(todo):
            at = self.slot[todo]
            free = self.owner[at] < 0
            self.owner[at[free]] = todo[free]  # of several that claim a slot one stays
            self.key[at] = keys[self.owner[at]]
            mine = self.owner[at]
            same = (self.key[at] == keys[todo]) & (lengths[mine] == lengths[todo])
            same[same] = _equal_bytes(buf, data, starts, lengths, todo[same], mine[same])
            todo = todo[~same]
            self.slot[todo] = (self.slot[todo] + 1) & (size - 1)
        self.count = np.bincount(self.slot, minlength=size)
        self.bucket = np.zeros(size, np.int64)
        used = np.flatnonzero(self.owner >= 0)
        of = self.owner[used]
        self.bucket[used] = [zlib.crc32(view[a:b]) % buckets for a, b in zip(starts[of].tolist(), ends[of].tolist())]
        self.used = used


def _equal_bytes(buf, data, starts, lengths, one, other) -> np.ndarray:
    """Whether the strings of each pair, equally long, have the same bytes."""
    out = np.ones(len(one), bool)
    apart = np.flatnonzero(one != other)
    short = apart[lengths[one[apart]] <= _SHORT]
    for i in apart[lengths[one[apart]] > _SHORT].tolist():
        a, b, n = int(starts[one[i]]), int(starts[other[i]]), int(lengths[one[i]])
        out[i] = buf[a : a + n] == buf[b : b + n]
    n = lengths[one[short]]
    for width in range(int(n.max(initial=0))):  # one byte of all strings at a time
        longer = short[n > width]
        out[longer] &= data[starts[one[longer]] + width] == data[starts[other[longer]] + width]
    return out


def _pieces(text: bytes, overlap: int, limit: int) -> Iterator[bytes]:
    """A text's lower-cased words, one space between, in pieces; each begins with the last `overlap` words of the one before."""
    at, carried = 0, []
    while at < len(text):
        end = min(len(text), at + limit)
        while end < len(text) and _LOWER[text[end]] != 32:  # a word is never cut
            end += 1
        words = carried + text[at:end].translate(_LOWER).split()
        if len(words) > len(carried):
            yield len(carried), words
        carried = words[max(0, len(words) - overlap) :] if overlap else []
        at = end


def _tables(batch: pa.RecordBatch, max_n: int, buckets: int, limit: int):
    """(table, row of each occurrence, words of each row) of about `limit` bytes of a batch's texts at a time."""
    group, held = [], 0
    for row, text in enumerate(batch.column("text")):
        body = text.as_buffer()
        for carried, words in _pieces(body.to_pybytes() if body else b"", max_n - 1, limit):
            group.append((row, carried, words))
            held += sum(map(len, words))
            if held > limit:
                yield _intern(group, max_n, buckets)
                group, held = [], 0
    if group:
        yield _intern(group, max_n, buckets)


def _intern(group, max_n: int, buckets: int):
    counts = np.fromiter((len(words) for _, _, words in group), np.int64, len(group))
    fresh = np.fromiter((c for _, c, _ in group), np.int64, len(group))
    rows = np.fromiter((r for r, _, _ in group), np.int64, len(group))
    buf = b" ".join(w for _, _, words in group for w in words)
    spaces = np.flatnonzero(np.frombuffer(buf, np.uint8) == 32)
    starts, ends = np.concatenate(([0], spaces + 1)), np.append(spaces, len(buf))
    piece = np.repeat(np.arange(len(group)), counts)
    inside = np.arange(len(starts)) - (np.cumsum(counts) - counts)[piece]
    lo, hi, of = [], [], []
    for n in range(1, max_n + 1):
        # runs that stay in their piece and end in a word that the piece before had not
        last = inside + n - 1
        ok = np.flatnonzero((last < counts[piece]) & (last >= fresh[piece]))
        lo.append(starts[ok])
        hi.append(ends[ok + n - 1])
        of.append(rows[piece[ok]])
    n_words = np.bincount(rows, weights=counts - fresh).astype(np.int64)
    return InternTable(buf, np.concatenate(lo), np.concatenate(hi), buckets), np.concatenate(of), n_words


def bucket_counts(texts: DataFrame, text_col: str, max_n: int, buckets: int, piece_bytes: int = PIECE_BYTES) -> np.ndarray:
    """Occurrences of all n-grams by bucket. Each task sums its own; `buckets` numbers come to the driver."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for table, _, _ in _tables(batch, max_n, buckets, piece_bytes):
                total += np.bincount(table.bucket[table.used], weights=table.count[table.used], minlength=buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["bucket", "n"])

    one = texts.select(F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    out = np.zeros(buckets, np.int64)
    for r in one.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(target share / raw share)) of each bucket, shares with one added to every bucket."""
    size, total, wanted = len(raw), float(raw.sum()), float(target.sum())
    ratio = (target + 1.0) * (total + size) / ((raw + 1.0) * (wanted + size))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, text_col: str = "text", keep: list[str] | None = None, max_n: int = 1, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """The columns `keep` of docs (all by default) with n_words, n_features and weight, the sum of the gains of all n-grams."""
    made = ("n_words", "n_features", "weight")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in made]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(c, T.LongType()) for c in made])
    buckets = len(gain)

    def run(batches):
        for batch in batches:
            sums = np.zeros((3, batch.num_rows), np.int64)
            for table, of, n_words in _tables(batch, max_n, buckets, piece_bytes):
                sums[0, : len(n_words)] += n_words
                if not len(of):
                    continue
                order = np.argsort(of, kind="stable")
                rows, first = np.unique(of[order], return_index=True)
                sums[1, rows] += np.diff(np.append(first, len(of)))
                sums[2, rows] += np.add.reduceat(gain[table.bucket][table.slot[order]], first)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))] + [pa.array(s) for s in sums], names=[*kept, *made])

    one = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").cast("string").cast("binary").alias("text" if "text" not in kept else "__text"))
    if "text" in kept:  # the kept text stays beside the one that is read
        one = one.withColumnRenamed("text", "__kept").withColumnRenamed("__text", "text")
    return one.mapInArrow(run, schema)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", keep: list[str] | None = None, max_n: int = 1, buckets: int = 10_000, min_words: int = 20, percent: int = 10, seed: str = "2024", piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """The columns `keep` of docs (all by default) with n_words, n_features, weight, score and rank.

    Lower-cases A-Z only; words are runs of digits, ASCII letters and characters beyond ASCII.
    Features are all runs of 1 to max_n words, repeats counted, hashed by crc32 into buckets.
    score is the weight plus Gumbel noise in thousandths that the seed and the id decide (a
    null id counts as empty). Of the N rows with min_words words or more, rank numbers the
    floor(percent * N / 100) highest scores 1, 2, 3 ..., ties by the smaller id, nulls last;
    repeated rows are drawn one by one. Other rows have no rank. Null and empty texts have no
    features and weight 0. Empty docs give no rows, an empty target only the smoothing.
    Columns named like a result are replaced. Texts of any length are read in pieces.
    """
    made = ("n_words", "n_features", "weight", "score", "rank")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in made]
    gain = gains(bucket_counts(docs, text_col, max_n, buckets, piece_bytes), bucket_counts(target, target_col, max_n, buckets, piece_bytes))
    noise = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), noise), 256), 1, 8), 16, 10).cast("double")
    weighed = weigh(docs.withColumn("__id", F.col(f"`{id_col}`")).withColumn("__noise", F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))), gain, text_col, [*kept, "__id", "__noise"], max_n, piece_bytes)
    scored = materialize(weighed.withColumn("score", F.col("weight") + F.col("__noise")).drop("__noise"), "importance")
    able = scored.where(F.col("n_words") >= min_words)
    drawn = able.count() * percent // 100
    ranked = number_rows(able, [F.col("score").desc(), F.col("__id").asc_nulls_last()], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).drop("__id")
