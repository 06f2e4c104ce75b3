"""Consecutive numbers over a table of any size.

A window without a partition, or over one hot group, sorts all rows in one task. Here rows
are cut into ranges and sorted within them; a range's numbers begin where the counts of the
ranges before it end, and a group's numbers begin at its smallest one.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import settle

#: monotonically_increasing_id() has the partition above these bits and the row below.
_ROW_BITS = 33


def number_rows(df: DataFrame, order: Sequence[str | Column], name: str = "number", within: Sequence[str] = ()) -> DataFrame:
    """df with `name` (long): 1, 2, 3 ... in `order`, anew in each group of the columns
    `within` (nulls are a group). Rows with equal order keys get numbers in no fixed order.
    df is written once, so numbers don't change when the result is read again. An empty table
    gives an empty one; a column called `name` is replaced."""
    spark = df.sparkSession
    keys = [F.col(f"`{c}`") for c in within] + [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.drop(name).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = settle(ranged.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", _ROW_BITS)
    row = F.col("__at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    # a row for each range: as many as there are shuffle partitions
    counts = sorted(map(tuple, placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()))
    starts = accumulate((n for _, n in counts), initial=1)
    before = spark.createDataFrame([(p, s) for (p, _), s in zip(counts, starts)], "__part long, __start long")
    out = placed.join(F.broadcast(before), part == F.col("__part")).withColumn(name, F.col("__start") + row).drop("__at", "__part", "__start")
    if not within:
        return out
    firsts = out.groupBy(*[F.col(f"`{c}`").alias(f"__g{i}") for i, c in enumerate(within)]).agg(F.min(name).alias("__first"))
    same = [F.col(f"`{c}`").eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(within)]
    return out.join(firsts, same).withColumn(name, F.col(name) - F.col("__first") + 1).select(*df.drop(name).columns, name)
