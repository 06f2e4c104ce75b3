"""Byte-level BPE encoding and decoding with a public vocabulary file.

A piece of text is merged with a priority queue of merge ranks over a doubly linked
list of symbols. An entry names a rank and a left symbol; it is stale, and skipped, when
that symbol and its neighbour are no longer the pair of that rank. Decoding
concatenates vocabulary strings.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate

#: The published pattern of this vocabulary, with white space spelled as the Unicode property.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")

#: Pieces in one generation of a worker's cache; two generations are kept.
CACHE_PIECES = 400_000


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary:
    printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and b != 0x20]
    shifted = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(shifted)}


class ByteBPE:
    """encode(text) -> ids and decode(ids) -> text for a tokenizer file of the `tokenizers` library."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        vocab: dict[str, int] = model["vocab"]
        alphabet = byte_alphabet()
        back = {c: b for b, c in alphabet.items()}
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", ())}
        self.strings = {i: bytes(back[c] for c in s) for s, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.first = [vocab[alphabet[b]] for b in range(256)]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.pairs = [vocab[a] << 32 | vocab[b] for a, b in merges]
        self.rank = {p: r for r, p in enumerate(self.pairs)}
        self.merged = [vocab[a + b] for a, b in merges]
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._new: dict = {}
        self._old: dict = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        symbols = [self.first[b] for b in piece]
        n = len(symbols)
        rank = self.rank
        queue = [r << 40 | i for i in range(n - 1) if (r := rank.get(symbols[i] << 32 | symbols[i + 1])) is not None]
        if not queue:
            return symbols
        heapq.heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            entry = heapq.heappop(queue)
            r, left = entry >> 40, entry & 0xFFFFFFFFFF
            right = after[left]
            if right >= n or symbols[left] < 0 or symbols[left] << 32 | symbols[right] != self.pairs[r]:
                continue  # stale
            made = symbols[left] = self.merged[r]
            symbols[right] = -1
            follow = after[left] = after[right]
            if follow < n:
                before[follow] = left
                if (s := rank.get(made << 32 | symbols[follow])) is not None:
                    heapq.heappush(queue, s << 40 | left)
            ahead = before[left]
            if ahead >= 0 and (s := rank.get(symbols[ahead] << 32 | made)) is not None:
                heapq.heappush(queue, s << 40 | ahead)
        return [s for s in symbols if s >= 0]

    def _piece(self, piece: str) -> tuple[str, int, bytes, list[int]]:
        """(ids as text, number of ids, decoded bytes, ids) of a piece, remembered."""
        found = self._old.get(piece)
        if found is None:
            ids = self.merge(piece.encode())
            found = (",".join(map(str, ids)), len(ids), self.decode_bytes(ids), ids)
        if len(self._new) >= CACHE_PIECES:
            self._old, self._new = self._new, {}
        if len(piece) <= 64:
            self._new[piece] = found
        return found

    def pieces(self, text: str | None) -> list[tuple[str, int, bytes, list[int]]]:
        out, known = [], self._new.get
        for part in self.split.split(text or "") if self.split else [text or ""]:
            if part in self.special:
                ids = [self.special[part]]
                out.append((str(ids[0]), 1, self.decode_bytes(ids), ids))
                continue
            for piece in PIECES.findall(part):
                out.append(known(piece) or self._piece(piece))
                known = self._new.get
        return out

    def encode(self, text: str | None) -> list[int]:
        return [i for _, _, _, ids in self.pieces(text) for i in ids]

    def decode_bytes(self, ids) -> bytes:
        return b"".join([self.strings[i] for i in ids])

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_LOADED: dict[str, ByteBPE] = {}


def _load(spec: str) -> ByteBPE:
    key = hashlib.sha1(spec.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = ByteBPE(spec)
    return _LOADED[key]


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text", keep: list[str] | None = None, ids: bool = True, digests: bool = False) -> DataFrame:
    """docs (or the columns `keep`) with n_tokens and, as asked for, ids (array of int)
    and the digests ids_sha256 (of decimal ids joined by commas) and decoded_sha256 (of
    the text that the ids decode to).

    vocabulary: path of the tokenizer file, read on the driver and broadcast. A text that
    holds the string of a special token has that token there. Null texts count as empty:
    no ids. Texts are encoded whole; equal texts give equal ids. Columns named like a
    result are replaced.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    fields = [T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids
    fields += [T.StructField(n, T.StringType()) for n in ("ids_sha256", "decoded_sha256")] * digests

    def run(texts: list) -> dict:
        bpe = _state(spec)
        out: dict = {f.name: [] for f in fields}
        for text in texts:
            found = bpe.pieces(text)
            out["n_tokens"].append(sum([p[1] for p in found]))
            if ids:
                out["ids"].append([i for p in found for i in p[3]])
            if digests:
                out["ids_sha256"].append(hashlib.sha256(",".join([p[0] for p in found]).encode()).hexdigest())
                decoded = b"".join([p[2] for p in found]).decode("utf-8", "replace")
                out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
        return out

    return annotate(docs, run, fields, text_col, keep)


def _state(spec) -> ByteBPE:
    own = getattr(spec, "_bpe", None)
    if own is None:
        own = spec._bpe = _load(spec.value)
    return own


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """encoded (or the columns `keep`) with the string column `decoded`; null ids give the empty text."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = encoded.sparkSession.sparkContext.broadcast(f.read())
    kept = [c for c in (encoded.columns if keep is None else keep) if c != "decoded"]
    schema = T.StructType([encoded.schema[c] for c in kept] + [T.StructField("decoded", T.StringType())])

    def run(batches):
        import pyarrow as pa

        bpe = _state(spec)
        for batch in batches:
            decoded = [bpe.decode(i or ()) for i in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))] + [pa.array(decoded, pa.string())], names=[*kept, "decoded"])

    return encoded.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{ids_col}`").alias("__ids")).mapInArrow(run, schema)
