"""Exact duplicates through an extendible-hash index on shared files.

The index key of a text is the first 64 bits of the SHA-256 of its normalised bytes.
A directory of 2**depth entries maps leading key bits to buckets; it doubles while a
bucket with more keys than its capacity needs another bit. Buckets that are overfull
when the counted bits are used up are split on by as many bits of the key as their count
asks for. The directory deals buckets to owner tasks: each owns a run of whole buckets
in the order of keys, chains the entries of equal keys, compares their bytes, and writes
its part of the index, ordered by bucket, to the shared folder.
Equal texts of one input task are combined before they are sent, so a text with very
many copies costs its owner one row for each input task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, materialize, slices

_DROP = bytes(map(ord, SPACES))

#: Bytes of distinct texts that a task remembers in order to combine copies; older ones are forgotten, which costs a row more and changes no result.
COMBINE_BYTES = 48 << 20

#: Leading key bits that are counted to size the directory: 2**14 counts at most go to the driver.
COUNTED_BITS = 14

#: Buckets that each owner task has on average at least: small tables have smaller buckets.
OWNED = 8

_ROWS = T.StructType([T.StructField("rep", T.StringType()), T.StructField("n_points", T.LongType()), T.StructField("key", T.LongType()), T.StructField("sha", T.StringType()), T.StructField("body", T.BinaryType())])


def _digest_rows(batches):
    """A row for each document; the first of equal texts in this task carries the bytes and the others name it."""
    task, n, seen, held = hashlib.blake2b(digest_size=6), 0, {}, 0
    prefix = None
    for batch in batches:
        for lo, hi in slices(batch.column(1)):
            ids = batch.column(0).slice(lo, hi - lo)
            out = {f.name: [] for f in _ROWS}
            for doc_id, text in zip(ids.to_pylist(), batch.column(1).slice(lo, hi - lo).to_pylist()):
                text = text or ""
                body = text.encode().translate(None, _DROP)
                sha = hashlib.sha256(body).digest()
                if prefix is None:  # differs between tasks: only one of them has this row first
                    task.update(repr((_partition(), doc_id)).encode())
                    prefix = task.hexdigest()
                rep, fresh = None, None
                for name, other in seen.get(sha, ()):
                    if other == body:
                        rep = name
                if rep is None:
                    rep, fresh = f"{prefix}-{n}", body
                    n += 1
                    seen.setdefault(sha, []).append((rep, body))
                    held += len(body) + 200
                    while held > COMBINE_BYTES and len(seen) > 1:
                        held -= sum(len(b) + 200 for _, b in seen.pop(next(iter(seen))))
                for name, value in zip(out, (rep, len(text), int.from_bytes(sha[:8], "big", signed=True), sha.hex(), fresh)):
                    out[name].append(value)
            yield pa.RecordBatch.from_arrays([ids] + [pa.array(out[f.name], t) for f, t in zip(_ROWS, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()))], names=["id", *_ROWS.names])


def _partition() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


def build_directory(counts: dict[int, int], capacity: int, counted_bits: int = COUNTED_BITS) -> tuple[int, np.ndarray, list[tuple[int, int, int]]]:
    """(depth, directory, buckets) for keys counted by their leading counted_bits.

    directory has 2**depth entries, the bucket of each prefix; buckets are
    (local depth, prefix, keys). Starts with one bucket; an overfull bucket is split by
    its next bit, and the directory doubles when that bucket already uses all its bits.
    """
    total = np.zeros(1 << counted_bits, np.int64)
    for k, n in counts.items():
        total[k] = n
    sums = np.concatenate(([0], np.cumsum(total)))
    depth, directory, buckets, todo = 0, np.zeros(1, np.int64), [(0, 0, int(sums[-1]))], [0]
    while todo:
        b = todo.pop()
        local, prefix, n = buckets[b]
        if n <= capacity or local == counted_bits:
            continue
        if local == depth:
            directory, depth = np.repeat(directory, 2), depth + 1
        span = counted_bits - local - 1
        halves = [int(sums[(p + 1) << span] - sums[p << span]) for p in (2 * prefix, 2 * prefix + 1)]
        buckets[b] = (local + 1, 2 * prefix, halves[0])
        buckets.append((local + 1, 2 * prefix + 1, halves[1]))
        width = depth - local - 1
        directory[(2 * prefix + 1) << width : (2 * prefix + 2) << width] = len(buckets) - 1
        todo += [b, len(buckets) - 1]
    return depth, directory, buckets


def deal_buckets(buckets: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(local depth, extra bits, number, keys before, keys) of each bucket of build_directory().

    extra is what an overfull bucket is split on by; its 2**extra parts are numbered from
    number on. Numbers and keys before go by the order of keys over all buckets."""
    before, number, dealt = 0, 0, {}
    for b in sorted(range(len(buckets)), key=lambda b: buckets[b][1] / (1 << buckets[b][0])):
        local, _, n = buckets[b]
        extra = min(max(-(-n // capacity) - 1, 0).bit_length(), 63 - local)
        dealt[b] = (local, extra, number, before, n)
        before, number = before + n, number + (1 << extra)
    return [dealt[b] for b in range(len(buckets))]


#: The task that owns a bucket: that in whose equal share of all keys its first one is. A bucket has one owner, and an owner a run of buckets.
_OWNER_OF = "cast(((before + part * n div shiftleft(1L, extra)) * {owners} div {total}) as int)"


def _owner(batches):
    """Reads its buckets sorted by key; holds the chain of one key at a time."""
    at, chain = None, []
    for batch in batches:
        keys, reps, bodies = (batch.column(n).to_pylist() for n in ("key", "rep", "body"))
        links = []
        for key, body in zip(keys, bodies):
            if key != at:
                at, chain = key, []
            for link, other in enumerate(chain):
                if other == body:
                    break
            else:
                link = len(chain)
                chain.append(body)
            links.append(link)
        yield pa.RecordBatch.from_arrays([batch.column("bucket"), pa.array(reps, pa.string()), pa.array(keys, pa.int64()), pa.array(links, pa.int32())], names=["bucket", "rep", "key", "link"])


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 20_000) -> DataFrame:
    """One row for each row of docs: id_col (of its own type), keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same bytes after deleting white space
    `[\\x20\\x09-\\x0D]`; null counts as empty, so null, empty and blank texts are one
    group. The row with the most code points in its original text stays, of those the
    one with the smallest id (null ids last). Repeated rows count each in group_size and,
    being indistinguishable, are all kept or all dropped. kept is null-safe: a row stays
    where its id is keep_id. Other columns are not read. No rows give no rows. capacity:
    entries (distinct texts of input tasks) in a bucket before it is split.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(_digest_rows, T.StructType([T.StructField("id", docs.schema[id_col].dataType), *_ROWS]))
    rows = materialize(rows, "exact-rows")
    entries = rows.where("body is not null").select("key", "rep", "body")
    # leading bits of the key as an unsigned number
    prefix = F.shiftrightunsigned("key", 64 - COUNTED_BITS).cast("int")
    counts = {r.prefix: r.n for r in entries.groupBy(prefix.alias("prefix")).agg(F.count("*").alias("n")).collect()}
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    capacity = max(min(capacity, sum(counts.values()) // (OWNED * parts)), 1)
    depth, directory, buckets = build_directory(counts, capacity, COUNTED_BITS)
    table = [(slot, *dealt) for slot, dealt in enumerate(map(deal_buckets(buckets, capacity).__getitem__, directory.tolist()))]
    table = spark.createDataFrame(table, "slot long, local int, extra int, number long, before long, n long")
    slot = F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")
    placed = entries.withColumn("slot", slot).join(F.broadcast(table), "slot")
    placed = placed.withColumn("part", F.expr("if(extra = 0, 0L, shiftrightunsigned(shiftleft(key, local), 64 - extra))"))
    owner = F.expr(_OWNER_OF.format(owners=parts, total=max(sum(counts.values()), 1)))
    placed = placed.select((F.col("number") + F.col("part")).alias("bucket"), owner.alias("owner"), "key", "rep", "body")
    owned = placed.repartitionById(parts, "owner").sortWithinPartitions("bucket", "key")
    chained = materialize(owned.select("bucket", "key", "rep", "body").mapInArrow(_owner, "bucket long, rep string, key long, link int"), "exact-index")
    # a text's rows of one task come to one row before any join, so copies never share a join key beyond a task's
    best = F.min(F.struct((-F.col("n_points")).alias("shorter"), F.col("id").isNull().alias("no_id"), "id"))
    per_rep = rows.groupBy("rep").agg(best.alias("best"), F.count("*").alias("n")).join(chained, "rep")
    groups = per_rep.groupBy("key", "link").agg(F.min("best").alias("best"), F.sum("n").alias("group_size"))
    of_rep = materialize(chained.join(groups, ["key", "link"]).select("rep", F.col("best.id").alias("keep_id"), "group_size"), "exact-groups")
    out = rows.select("id", "rep", "sha").join(of_rep, "rep")
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))
