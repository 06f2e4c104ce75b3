"""Centroid clustering (Lloyd's rounds) with heap-ordered bounds.

A vector's gap is the distance to its second nearest centroid less the distance to its
nearest. While the centroids that moved since have moved by less than the gap, its nearest
centroid can't have changed. Each cluster accumulates a drift: its own centroid's moves and
the largest move of any other. A vector is entered in its cluster's heap under gap + the
drift at that time, and expires once the drift reaches that key.

The heaps are sorted runs on shared files: each round writes one run with the vectors that
it scanned, sorted by (cluster, key) in each part. Popping is a range read of the earlier
runs: keys above the drift of the last round and up to this round's. So a round reads and
writes what has expired, no vector is rewritten while its bound holds, and there is no
shuffle of vectors. Sums are kept by differences: a vector that changes cluster is taken
from one sum and put to the other. All distances and sums are whole numbers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

#: Components whose distances in 64 dimensions fit a long; larger ones raise an error.
LIMIT = 1 << 27

#: Slack of bounds for rounding: gaps shrink and drifts grow by this share.
SLACK = 1e-9


def quantise(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: float) -> DataFrame:
    """(id, q): floor(scale * x) of vectors with exactly dims components, none null or non-finite."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    one = vectors.where((F.size(v) == dims) & whole)
    q = F.transform(v, lambda x: F.when(F.abs(x * scale) >= LIMIT, F.raise_error(F.lit(f"component beyond {LIMIT} / {scale}")).cast("int")).otherwise(F.floor(x * scale).cast("int")))
    return one.select(F.col(f"`{id_col}`").alias("id"), q.alias("q"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("q")
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1) if n else np.zeros((0, 1), np.int64)


def distances(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows of v to all centres, exact."""
    largest = max(int(np.abs(v).max(initial=0)), int(np.abs(centres).max(initial=0)))
    if 4 * largest * largest * v.shape[1] < 1 << 53:  # every step is a whole number that a double holds
        a, b = v.astype(np.float64), centres.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((v - c) ** 2).sum(1) for c in centres], axis=1)


def scan(centres: np.ndarray, drift: np.ndarray):
    """Assigns each vector to the nearest centre (ties: the smaller number); key is when that must be looked at again."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                d = distances(_matrix(batch), centres)
                rows = np.arange(len(d))
                best = d.argmin(1)
                nearest = d[rows, best]
                if d.shape[1] > 1:
                    d[rows, best] = np.iinfo(np.int64).max
                    second = np.sqrt(d.min(1).astype(np.float64))
                    gap = second - np.sqrt(nearest.astype(np.float64)) - SLACK * (1 + second)
                else:
                    gap = np.full(len(d), np.inf)
                key = gap + drift[best]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("q"), pa.array(best.astype(np.int32)), pa.array(key), batch.column("was")], names=["id", "q", "cluster", "key", "was"])

    return run


def _moves(batches):
    """Per cluster, what comes and goes: one row for each cluster and batch run."""
    sums: dict[int, np.ndarray] = {}
    counts: dict[int, int] = {}
    for batch in batches:
        v = _matrix(batch)
        for name, sign in (("cluster", 1), ("was", -1)):
            of = batch.column(name).to_numpy()
            order = np.argsort(of, kind="stable")
            ids, starts = np.unique(of[order], return_index=True)
            if not len(ids):
                continue
            for c, s, n in zip(ids.tolist(), np.add.reduceat(v[order], starts, axis=0), np.diff(np.append(starts, len(of))).tolist()):
                if c >= 0:
                    sums[c] = sums.get(c, 0) + sign * s
                    counts[c] = counts.get(c, 0) + sign * n
    ids = sorted(sums)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array([counts[c] for c in ids], pa.int64()), pa.array([sums[c].tolist() for c in ids], pa.list_(pa.int64()))], names=["cluster", "n", "sums"])


def _own_distance(centres: np.ndarray):
    def run(batches):
        for batch in batches:
            diff = _matrix(batch) - centres[batch.column("cluster").to_numpy()] if batch.num_rows else np.zeros((0, 1), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("cluster"), pa.array((diff * diff).sum(1), pa.int64())], names=["id", "cluster", "distance"])

    return run


def _between(low: np.ndarray | None, high: np.ndarray) -> Column:
    """Entries of each cluster's heap with keys above low and up to high: ranges that Parquet statistics can skip by."""
    out = F.lit(False)
    for c, top in enumerate(high.tolist()):
        inside = (F.col("cluster") == c) & (F.col("key") <= top)
        out = out | (inside if low is None else inside & (F.col("key") > float(low[c])))
    return out


def cluster_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 40, rounds: int = 5, dims: int = 64, scale: float = 256, seed: str = "2"
) -> tuple[DataFrame, DataFrame]:
    """(assigned, centres). assigned: id_col, cluster, distance (squared) of each kept vector;
    centres: cluster, centroid (whole components), n, cluster_inertia, inertia.

    Kept are vectors of exactly dims components, none null, NaN or infinite; a component x
    becomes floor(scale * x). One of magnitude 2**27 / scale or more raises an error, as its
    distances don't fit. The first centres are the k kept vectors with the smallest sha256
    of `seed:id` (a null id counts as empty; equal hashes by components), fewer if fewer are
    kept. `rounds` times all are assigned to the nearest centre (ties: the smaller number) and
    centres become the floor of the mean (an empty one stays); then all are assigned again.
    Repeated rows and ids count each. No kept vectors give empty results. Other columns are
    not read. To the driver come k rows a round.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema[id_col].dataType
    kept = quantise(vectors, id_col, vector_col, dims, scale)
    by = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = kept.select("q", by.alias("hash")).orderBy("hash", "q").limit(k).collect()
    if not first:
        none = spark.createDataFrame([], T.StructType([T.StructField(id_col, id_type), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]))
        return none, spark.createDataFrame([], "cluster int, centroid array<long>, n long, cluster_inertia long, inertia long")
    centres = np.array([r.q for r in first], np.int64)
    k = len(centres)
    sums, counts = [[0] * dims for _ in range(k)], [0] * k
    drift, before = np.zeros(k), None
    schema = T.StructType([T.StructField("id", id_type), T.StructField("q", T.ArrayType(T.IntegerType())), T.StructField("cluster", T.IntegerType()), T.StructField("key", T.DoubleType()), T.StructField("was", T.IntegerType())])
    runs: list[DataFrame] = []
    for turn in range(rounds + 1):
        if turn:
            popped = [r.where(_between(before if i < turn - 1 else None, drift)).select("id", "q", F.col("cluster").alias("was")) for i, r in enumerate(runs)]
        else:
            popped = [kept.withColumn("was", F.lit(-1))]
        due = popped[0]
        for more in popped[1:]:
            due = due.unionByName(more)
        run = due.mapInArrow(scan(centres, drift), schema).sortWithinPartitions("cluster", "key")
        runs.append(materialize(run, "centroid-heaps"))
        if turn == rounds:
            break
        # partial sums in each task, then k rows
        moved = runs[-1].where("cluster <> was").mapInArrow(_moves, "cluster int, n long, sums array<long>")
        for r in moved.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(dims)]).alias("sums")).collect():
            counts[r.cluster] += r.n
            sums[r.cluster] = [a + b for a, b in zip(sums[r.cluster], r.sums)]
        new = np.array([[s // counts[c] for s in sums[c]] if counts[c] else centres[c] for c in range(k)], np.int64)
        went = [math.sqrt(sum(int(x) ** 2 for x in row)) * (1 + SLACK) for row in new - centres]
        other = [max((w for j, w in enumerate(went) if j != c), default=0.0) for c in range(k)]
        before, drift, centres = drift, (drift + went + other) * (1 + SLACK), new
    live = [r if i == rounds else r.where(~_between(None, drift)) for i, r in enumerate(runs)]
    every = live[0]
    for more in live[1:]:
        every = every.unionByName(more)
    out = T.StructType([schema["id"], schema["cluster"], T.StructField("distance", T.LongType())])
    assigned = materialize(every.select("id", "q", "cluster").mapInArrow(_own_distance(centres), out), "centroid-assigned")
    stats = {r.cluster: (r.n, int(r.d)) for r in assigned.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.col("distance").cast("decimal(20,0)")).alias("d")).collect()}
    total = sum(d for _, d in stats.values())
    table = spark.createDataFrame([(c, centres[c].tolist(), *stats.get(c, (0, 0)), total) for c in range(k)], "cluster int, centroid array<long>, n long, cluster_inertia long, inertia long")
    return assigned.withColumnRenamed("id", id_col), table
