"""What the operators share: scratch tables in the cluster's shared folder and
the Arrow loop that adds columns computed from a text column."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.scratch import releasable, write_parquet

#: Bytes of text that a Python worker turns into numpy arrays at a time.
CHUNK_BYTES = 2 << 20

#: White space of the word definition `[^\x20\x09-\x0D]+`; bytes.split() has the same set.
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Only a local
    session may lack it; it then gets one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends
    at files that outlive any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    write_parquet(df, path)
    return releasable(spark.read.schema(df.schema).parquet(path), path)


def slices(text: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes of text, or of one row."""
    if not len(text):
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(text):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield lo, hi
        lo = hi


def annotate(
    docs: DataFrame,
    fn: Callable[[list], dict],
    fields: list[T.StructField],
    text_col: str = "text",
    keep: Iterable[str] | None = None,
) -> DataFrame:
    """The `keep` columns of docs (all by default) and the fields that fn makes of
    a list of texts (str or None). A kept column with the name of a field is
    replaced by it."""
    names = [f.name for f in fields]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]
    schema = T.StructType([docs.schema[c] for c in kept] + fields)
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").cast("string").alias("__text"))
    types = [_arrow(f.dataType) for f in fields]

    def run(batches):
        for batch in batches:
            text = batch.column(len(kept))
            for lo, hi in slices(text):
                made = fn(text.slice(lo, hi - lo).to_pylist())
                arrays = [batch.column(i).slice(lo, hi - lo) for i in range(len(kept))]
                arrays += [pa.array(made[n], type=t, from_pandas=False) for n, t in zip(names, types)]
                yield pa.RecordBatch.from_arrays(arrays, names=kept + names)

    return source.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    simple = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.StringType: pa.string(), T.DoubleType: pa.float64(), T.BooleanType: pa.bool_(), T.BinaryType: pa.binary(), T.FloatType: pa.float32()}
    return pa.list_(_arrow(kind.elementType)) if isinstance(kind, T.ArrayType) else simple[type(kind)]


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of the documents that no model learns from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the splitmix finalizer)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[ord(c) for c in SPACES]] = True
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE[_SPACE] = 0


def word_hashes(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the white-space separated words of all docs, in order, and
    for each doc the index of its first word (one entry more at the end)."""
    buf = np.frombuffer(b"\n".join(docs) + b"\n", np.uint8)
    space = _SPACE[buf]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    lengths = np.fromiter(map(len, docs), np.int64, len(docs)) + 1
    bounds = np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    place = np.arange(len(buf), dtype=np.int64)
    place -= np.repeat(starts, np.diff(np.append(starts, len(buf)))) if starts[0] == 0 else np.concatenate((place[: starts[0]], np.repeat(starts, np.diff(np.append(starts, len(buf))))))
    longest = int(place.max()) + 1
    with np.errstate(over="ignore"):
        # odd factors without a pattern: powers of one would let words with a pattern collide
        factors = mix64(np.arange(1, longest + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)) | np.uint64(1)
        return mix64(np.add.reduceat(_BYTE[buf] * factors[place], starts)), bounds
