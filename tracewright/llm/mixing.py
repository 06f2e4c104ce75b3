"""Mixing sources to target weights by capped water-filling and seeded repetitions.

Every document of a source is taken floor(target / size) times; a seeded part of them
once more. That part is a range of a hash of id and text, cut where the sizes below it sum
up to the fractional part of the target. The cut is found from two histograms of 4096
hash ranges each, so no task sees a source's documents together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Plans of more sources than this are joined without a broadcast.
BROADCAST_SOURCES = 10_000

_BITS = 12


def n_words(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in the text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def water_fill(sizes: list[int], weights: list[float], max_epochs: float = 3) -> list[float]:
    """Targets that share the total of sizes by weight, none above max_epochs times its
    size; the excess of clamped sources goes to the others by weight until none is above."""
    targets, open_ = [0.0] * len(sizes), list(range(len(sizes)))
    left = float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > max_epochs * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / total
            break
        for i in over:
            targets[i] = float(max_epochs * sizes[i])
        left -= sum(targets[i] for i in over)
        full = set(over)
        open_ = [i for i in open_ if i not in full]
    return targets


def _place(id_col: Column, text_col: Column, seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_col, text_col), 64 - 2 * _BITS)


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(1, 2, 3), max_epochs: int = 3, seed: int = 7) -> DataFrame:
    """One row for each source: source, source_size, target, epochs (whole repetitions)
    and cut: documents whose place is below it are taken once more."""
    spark = docs.sparkSession
    one = docs.select(F.col(f"`{source_col}`").alias("source"), n_words(F.col(f"`{text_col}`")).alias("size"), _place(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), seed).alias("place"))
    bins = one.groupBy("source", F.shiftrightunsigned("place", _BITS).alias("hi"), (F.col("place") % (1 << _BITS)).alias("lo")).agg(F.sum("size").alias("size"))
    bins = materialize(bins, "mix-bins")
    totals = {r.source: r.size for r in bins.groupBy("source").agg(F.sum("size").alias("size")).collect()}  # a row for each source
    sources = sorted((s for s in totals if s is not None)) + [None] * (None in totals)
    sizes = [totals[s] for s in sources]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(sources))], max_epochs)
    whole = [min(max_epochs, math.floor(t / s)) if s else 0 for s, t in zip(sizes, targets)]
    need = [t - w * s for s, t, w in zip(sizes, targets, whole)]
    plan = spark.createDataFrame([*zip(sources, sizes, targets, whole, need)], "source string, source_size long, target double, epochs int, need double")
    plan = F.broadcast(plan) if len(sources) <= BROADCAST_SOURCES else plan
    by = Window.partitionBy("source").orderBy("hi")
    coarse = bins.groupBy("source", "hi").agg(F.sum("size").alias("size")).withColumn("upto", F.sum("size").over(by))
    # the first range that goes beyond what is needed; without one, all documents are taken again
    needs = plan.select(F.col("source").alias("of"), "need")
    edge = coarse.join(needs, F.expr("source <=> of")).where("upto > need").groupBy("of").agg(F.min_by(F.struct("hi", (F.col("need") - F.col("upto") + F.col("size")).alias("rest")), "hi").alias("e"))
    edge = edge.select("of", F.col("e.hi").alias("at"), F.col("e.rest").alias("rest"))
    edge = F.broadcast(edge) if len(sources) <= BROADCAST_SOURCES else edge
    fine = bins.join(edge, F.expr("source <=> of and hi = at")).withColumn("upto", F.sum("size").over(Window.partitionBy("source").orderBy("lo")))
    # up to the fine range whose end is nearest
    taken = F.col("upto") - F.col("size") / 2 <= F.col("rest")
    cut = fine.groupBy("of", "at").agg(F.max(F.when(taken, F.col("lo") + 1)).alias("lo"))
    cut = cut.select("of", (F.col("at") * (1 << _BITS) + F.coalesce("lo", F.lit(0))).alias("cut"))
    out = plan.join(cut, F.expr("source <=> of"), "left")
    everything = F.when(F.col("need") > 0, F.lit(1 << 2 * _BITS)).otherwise(F.lit(0))
    return materialize(out.select("source", "source_size", "target", "epochs", F.coalesce("cut", everything).cast("long").alias("cut")), "mix-plan")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None, weights=(1, 2, 3), max_epochs: int = 3, seed: int = 7) -> DataFrame:
    """docs (or the columns `keep`) with size, source_size, target, repeats and taken = repeats * size.

    Sources in code point order, null as a source of its own and last, get the weights in
    turn. No document is repeated more than max_epochs times. A source's taken words are
    within half the words of the documents that share the cut's hash range of its target;
    rows with equal id and text are taken alike, so ids may be null or shared. Null and empty texts
    have size 0 and are repeated like others. An empty table gives no rows; columns named
    like a result are replaced. The seed, ids and texts alone decide, so reruns agree.
    """
    plan = plan_mix(docs, id_col, text_col, source_col, weights, max_epochs, seed)
    plan = plan.select(F.col("source").alias("__source"), "source_size", "target", "epochs", "cut")
    small = plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    made = ("size", "source_size", "target", "repeats", "taken")
    kept = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep) if c not in made]
    one = docs.select(*kept, F.col(f"`{source_col}`").cast("string").alias("__of"), n_words(F.col(f"`{text_col}`")).alias("size"), _place(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), seed).alias("__place"))
    joined = one.join(F.broadcast(plan) if small else plan, F.expr("__of <=> __source"))
    repeats = F.least(F.lit(max_epochs), F.col("epochs") + (F.col("__place") < F.col("cut")).cast("int")).cast("int")
    return joined.select(*kept, "size", "source_size", "target", repeats.alias("repeats"), (repeats * F.col("size")).cast("long").alias("taken"))


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each row `repeats` times."""
    return mixed.where("repeats > 0").select(*columns, F.explode(F.sequence(F.lit(1), F.col("repeats"))).alias("__nth")).drop("__nth")
