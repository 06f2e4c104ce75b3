"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

Every document is a reference for those with larger ids. Its text is cut into blocks by its
content: of each 50 consecutive words the smallest hash of 20 words is the anchor, and the
windows that share an anchor are one block. Equal windows have equal anchors, so a window
needs to be looked for only in the blocks under its own anchor's hash.

1. The index has each distinct block under its anchor, with its smallest document id. Parsing
   a document greedily takes its blocks whole: one that an earlier document has, word for
   word, is copied as one factor of 50 words or more.
2. At factor boundaries (the first of its kind of a block, where others under the same anchor
   differ) the block is parsed window by window against the windows of those other blocks.
3. Factors that touch or overlap become duplicate spans.

Copies of a block cost one index entry; pairs of documents never occur, and grouping is by
hash with a map-side part. Blocks and windows are told apart by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, mix64, word_hashes

#: Words of an anchor; a window has 50 - 20 + 1 = 31 of them.
ANCHOR = 20

#: Bytes of text that are looked at together; longer texts are read in overlapping pieces.
PIECE_BYTES = 1 << 20

_ODD = np.uint64(0x9FB21C651E98DF25)


def pieces(text: bytes, overlap: int, limit: int) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first word, words) of pieces of a text; each begins with the last `overlap` words of the one before."""
    at, first, carried = 0, 0, []
    while at < len(text):
        end = min(len(text), at + limit)
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":  # a word is never cut
            end += 1
        words = carried + text[at:end].split()
        yield first, words
        carried = words[max(0, len(words) - overlap) :] if overlap else []
        first += len(words) - len(carried)
        at = end


def _grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, from runs of powers of two."""
    runs, size, powers = hashes, 1, {}
    with np.errstate(over="ignore"):
        while size <= n:
            powers[size] = runs
            if 2 * size > n or len(runs) <= size:
                break
            runs = mix64(runs[:-size] * _ODD + runs[size:])
            size *= 2
        out, have = None, 0
        for size in sorted(powers, reverse=True):
            if n - have >= size:
                part = powers[size][have:]
                out = part if out is None else mix64(out[: len(part)] * _ODD + part[: len(out)])
                have += size
    return out[: len(hashes) - n + 1]


def _window_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n consecutive numbers."""
    size = 1
    while 2 * size <= n:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (n - size)], x[n - size :])


class Words:
    """Words of several pieces of text in one buffer, each followed by one space."""

    def __init__(self, texts: list[list[bytes]]):
        self.counts = np.fromiter(map(len, texts), np.int64, len(texts))
        self.first = np.concatenate(([0], np.cumsum(self.counts)))
        self.buf = b" ".join(w for words in texts for w in words)
        spaces = np.flatnonzero(np.frombuffer(self.buf, np.uint8) == 32)
        self.starts = np.concatenate(([0], spaces + 1)).tolist()
        self.ends = np.append(spaces, len(self.buf)).tolist()

    def digest(self, lo: int, hi: int, mark: int) -> bytes:
        """128 bits of the words lo to hi (inclusive)."""
        return xxhash.xxh3_128_digest(self.buf[self.starts[lo] : self.ends[hi]], seed=mark)


def blocks(w: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, anchor word, first window, last window) of each block of the buffer, windows by their first word."""
    none = np.zeros(0, np.int64)
    if int(w.counts.sum()) < window:
        return none.astype(np.uint64), none, none, none
    grams = _grams(word_hashes([w.buf])[0], anchor)
    with np.errstate(over="ignore"):
        # of equal hashes the leftmost
        packed = (mix64(grams) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    owner = (_window_min(packed, window - anchor + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # windows that end in another piece are none
    ok = np.zeros(len(owner), bool)
    for lo, n in zip(w.first.tolist(), w.counts.tolist()):
        if n >= window:
            ok[lo : lo + n - window + 1] = True
    starts = np.flatnonzero(ok)
    if not len(starts):
        return none.astype(np.uint64), none, none, none
    of = owner[starts]
    cut = np.flatnonzero((np.diff(of) != 0) | (np.diff(starts) != 1)) + 1
    lo, hi = np.concatenate(([0], cut)), np.append(cut, len(starts)) - 1
    return grams[of[lo]], of[lo], starts[lo], starts[hi]


def _each(batch: pa.RecordBatch, overlap: int, limit: int):
    """Groups of (row, first word, words) of about `limit` bytes from a batch's text column."""
    group, held = [], 0
    for row, text in enumerate(batch.column("text")):
        text = text.as_buffer()
        for first, words in pieces(text.to_pybytes() if text else b"", overlap, limit):
            if len(words) > overlap:
                group.append((row, first, words))
                held += sum(map(len, words))
            if held > limit:
                yield group
                group, held = [], 0
    if group:
        yield group


_BLOCK = "doc_id {id}, row long, lo int, hi int, anchor long, b1 long, b2 long"


def _index_blocks(window: int, anchor: int, limit: int):
    def run(batches):
        for batch in batches:
            for group in _each(batch, window - 1, limit):
                w = Words([words for _, _, words in group])
                hashes, at, lo, hi = blocks(w, window, anchor)
                piece = np.searchsorted(w.first, lo, side="right") - 1
                rows = np.array([g[0] for g in group])[piece] if len(lo) else lo
                shift = np.array([g[1] for g in group])[piece] - w.first[piece] if len(lo) else lo
                # the anchor's place tells apart blocks of equal words
                digests = np.frombuffer(b"".join(map(w.digest, lo.tolist(), (hi + window - 1).tolist(), (at - lo).tolist())), np.int64).reshape(-1, 2)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(take), batch.column("row").take(take), pa.array((lo + shift).astype(np.int32)), pa.array((hi + shift).astype(np.int32)), pa.array(hashes.view(np.int64)), pa.array(digests[:, 0]), pa.array(digests[:, 1])],
                    names=["doc_id", "row", "lo", "hi", "anchor", "b1", "b2"],
                )

    return run


def _windows(window: int, limit: int):
    """128 bits of every window that the row's `spans` (first and last window) name."""

    def run(batches):
        for batch in batches:
            wanted = [sorted((s["lo"], s["hi"]) for s in spans) for spans in batch.column("spans").to_pylist()]
            for group in _each(batch, window - 1, limit):
                w = Words([words for _, _, words in group])
                rows, starts, digests = [], [], []
                for i, (row, first, words) in enumerate(group):
                    base, last = int(w.first[i]) - first, first + len(words) - window
                    for lo, hi in wanted[row]:
                        # a window belongs to the piece that has it whole; the next piece begins after it
                        for s in range(max(lo, first), min(hi, last) + 1):
                            rows.append(row)
                            starts.append(s)
                            digests.append(w.digest(base + s, base + s + window - 1, 0))
                d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("row").take(take), pa.array(starts, pa.int32()), pa.array(d[:, 0]), pa.array(d[:, 1])], names=["doc_id", "row", "start", "w1", "w2"])

    return run


def factors(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans (first word, end) that touch or overlap, as one each, in order."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def _cut(names: list[str], limit: int):
    def run(batches):
        for batch in batches:
            texts, totals, gone, cut = [], [], [], []
            for text, spans in zip(batch.column("__text"), batch.column("__spans").to_pylist()):
                dup = factors([(s["lo"], s["hi"]) for s in spans or ()])
                body, n, kept = text.as_buffer(), 0, []
                at = 0
                for first, words in pieces(body.to_pybytes() if body else b"", 0, limit):
                    n = first + len(words)
                    lo = first
                    while at < len(dup) and dup[at][0] < n:
                        kept += words[lo - first : max(dup[at][0], lo) - first]
                        lo = min(dup[at][1], n)
                        if dup[at][1] > n:
                            break
                        at += 1
                    kept += words[lo - first :]
                texts.append(b" ".join(kept).decode("utf-8", "replace"))
                totals.append(n)
                gone.append(n - len(kept))
                cut.append([{"lo": lo, "hi": hi} for lo, hi in dup])
            made = [pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(gone, pa.int64()), pa.array(cut, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(names))] + made, names=[*names, "text", "n_words", "n_removed", "spans"])

    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, keep: list[str] | None = None, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """The columns `keep` of docs (all but the text by default) with text (the kept words, one
    space between), n_words, n_removed and spans (first word and end of what was removed).

    A word is `[^\\x20\\x09-\\x0D]+`, unchanged. Removed is each word covered by `window`
    consecutive words that also stand, in this order, in a row with a smaller id. Windows are
    judged on the input. Rows of equal ids are not smaller than each other, and a null id is
    neither smaller nor larger: its words all stay. Null and empty texts have no words; texts
    shorter than the window stay whole. Texts of any length take part, in pieces of a bounded
    size. An empty table gives no rows; columns named like a result are replaced. Bytes that
    are no UTF-8 can't occur in a string column.
    """
    if window <= ANCHOR:
        raise ValueError(f"a window has more than {ANCHOR} words")
    made = ("text", "n_words", "n_removed", "spans")
    id_type = docs.schema[id_col].dataType.simpleString()
    text = F.col(f"`{text_col}`").cast("string").cast("binary")
    doc_id = F.col(f"`{id_col}`")
    row = F.xxhash64(doc_id, text)  # rows of one id are told apart by their text
    # whitespace between 50 words at least
    texts = docs.where(doc_id.isNotNull() & (F.length(text) >= 2 * window - 1)).select(doc_id.alias("doc_id"), row.alias("row"), text.alias("text"))

    found = materialize(texts.mapInArrow(_index_blocks(window, ANCHOR, piece_bytes), _BLOCK.format(id=id_type)), "substring-blocks")
    by_anchor = found.groupBy("anchor").agg(F.min("doc_id").alias("first_of_anchor"), F.max("doc_id").alias("last_of_anchor"), F.min("b1").alias("b1_lo"), F.max("b1").alias("b1_hi"), F.min("b2").alias("b2_lo"), F.max("b2").alias("b2_hi"))
    shared = by_anchor.where("first_of_anchor < last_of_anchor").select("anchor", "first_of_anchor", F.expr("b1_lo < b1_hi or b2_lo < b2_hi").alias("several"))
    # groups are written before rows are joined to them: a join of two plain shuffles can split a hot key
    met = materialize(found.join(materialize(shared, "substring-anchors"), "anchor"), "substring-met")
    firsts = materialize(met.groupBy("anchor", "b1", "b2").agg(F.min("doc_id").alias("first")), "substring-firsts")
    parsed = met.join(firsts, ["anchor", "b1", "b2"])
    parsed = materialize(parsed.select("doc_id", "row", "lo", "hi", "several", (F.col("first") < F.col("doc_id")).alias("copied")), "substring-parsed")
    whole = parsed.where("copied").select("doc_id", "row", "lo", (F.col("hi") + window).alias("hi"))
    # boundaries: firsts of their kind under an anchor with other blocks
    edges = parsed.where("not copied and several").groupBy("doc_id", "row").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    edge_texts = texts.join(edges, ["doc_id", "row"])
    seen = materialize(edge_texts.select("doc_id", "row", "text", "spans").mapInArrow(_windows(window, piece_bytes), f"doc_id {id_type}, row long, start int, w1 long, w2 long"), "substring-windows")
    again = seen.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("w1", "w2", "first")
    again = materialize(again, "substring-again")
    single = seen.join(again, ["w1", "w2"]).where("first < doc_id").select("doc_id", "row", F.col("start").alias("lo"), (F.col("start") + window).alias("hi"))
    spans = whole.unionByName(single).groupBy(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).agg(F.collect_set(F.struct("lo", "hi")).alias("__spans"))

    kept = [c for c in (docs.columns if keep is None else keep) if c not in made and c != text_col]
    every = docs.select(*[F.col(f"`{c}`") for c in kept], text.alias("__text"), doc_id.alias("__key"), row.alias("__of"))
    joined = every.join(spans, (F.col("__key") == F.col("__id")) & (F.col("__of") == F.col("__row")), "left")
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType())])))])
    return joined.select(*kept, "__text", "__spans").mapInArrow(_cut(kept, piece_bytes), schema)
