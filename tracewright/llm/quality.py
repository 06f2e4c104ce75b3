"""Quality rules: text statistics and a log-likelihood ratio of hashed n-grams between
trusted target texts and the raw corpus. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Hash buckets of word n-grams (one and two words).
BUCKETS = 1 << 15

#: Log-ratios are whole numbers of this unit, so that sums do not depend on their order.
UNIT = 1 << 20

#: Least mean log-ratio of an n-gram in a kept text: on labelled texts of the small tables good ones
#: have -0.08 and more, bad ones that no base rule fails -0.19 and less.
THRESHOLD = -0.15

_SPACE = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACE), "")


#: n-gram buckets of the words w; w is bound once by the caller's lambda.
_GRAMS = f"concat(transform(w, x -> cast(pmod(xxhash64(x), {BUCKETS}) as int)), transform(slice(w, 1, greatest(0, size(w) - 1)), (x, i) -> cast(pmod(xxhash64(x, w[i + 1]), {BUCKETS}) as int)))"

#: Words in 8-word windows that occur twice or more in w. Windows are compared by hash;
#: only in a text with a repeat are they sorted, and covered words counted in order.
_REPEATS = """transform(array(transform(sequence(0, size(w) - 8), i -> xxhash64(w[i], w[i+1], w[i+2], w[i+3], w[i+4], w[i+5], w[i+6], w[i+7]))), h ->
  if(size(array_distinct(h)) = size(h), 0L,
    aggregate(
      transform(array(sort_array(transform(h, (x, i) -> struct(x as h, i as i)))), s ->
        sort_array(transform(filter(s, (x, j) -> (j > 0 and s[greatest(j - 1, 0)].h = x.h) or (j < size(s) - 1 and s[least(j + 1, size(s) - 1)].h = x.h)), x -> x.i)))[0],
      struct(0L as n, 0 as upto),
      (a, i) -> struct(a.n + (i + 8 - greatest(i, a.upto)) as n, i + 8 as upto),
      a -> a.n)))[0]"""


def log_ratios(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_docs: int | None = None) -> DataFrame:
    """(bucket, ratio): the log of a bucket's share of the target n-grams over its share
    of the corpus n-grams, in units. target: ids of trusted rows of docs, all of which are counted;
    with target_docs only those with so many smallest hashes."""
    trusted = target.select(F.col(f"`{id_col}`").alias("tid")).where("tid is not null").distinct()
    if target_docs is not None:
        trusted = trusted.orderBy(F.xxhash64("tid"), "tid").limit(target_docs)
    # as a table it has a known size: few ids are broadcast, many are joined by sorting
    trusted = materialize(trusted, "trusted")
    one = docs.select(F.col(f"`{id_col}`").alias("id"), words_of(F.col(f"`{text_col}`")).alias("words"))
    flagged = one.join(trusted, F.col("id") == F.col("tid"), "left").select("words", F.col("tid").isNotNull().cast("long").alias("t"))
    grams = flagged.select("t", F.explode(F.expr(f"transform(array(words), w -> {_GRAMS})[0]")).alias("bucket"))
    counts = materialize(grams.groupBy("bucket").agg(F.sum("t").alias("t"), F.count("*").alias("r")), "gram-counts")
    spark = docs.sparkSession
    every = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").fillna(0, ["t", "r"])
    total = counts.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("tt"), F.coalesce(F.sum("r"), F.lit(0)).alias("rr"))
    both = every.join(F.broadcast(total))  # one row
    share_t = F.log((F.col("t") + 0.5) / (F.col("tt") + 0.5 * BUCKETS))
    share_r = F.log((F.col("r") + 0.5) / (F.col("rr") + 0.5 * BUCKETS))
    return both.select("bucket", F.when(F.col("tt") > 0, F.round((share_t - share_r) * UNIT)).otherwise(0).cast("long").alias("ratio"))


def assess(docs: DataFrame, ratios: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: id_col, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, llr, kept.

    Words are `[^\\x20\\x09-\\x0D]+`. base_failed: fewer than 20 words, or more than 30 in 100
    words inside 8-word windows that occur twice or more in the text. llr is the mean
    log-ratio of the text's n-grams (0 without words); kept needs llr >= threshold and no
    base failure. Null texts count as empty; repeated rows and null ids give a row each;
    other columns are not read.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    # BUCKETS numbers, one row
    table = ratios.agg(F.array_sort(F.collect_list(F.struct("bucket", "ratio"))).alias("r")).select(F.transform("r", lambda x: x["ratio"]).alias("r")).scalar()
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    one = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), table.alias("ratio"))
    bound = f"""transform(array(array_remove(split(text, '[\\\\x20\\\\x09-\\\\x0D]+'), '')), w -> struct(
        cast(size(w) as long) as n_words,
        if(size(w) < 8, 0L, {_REPEATS}) as n_repeat_words,
        greatest(1, 2 * size(w) - 1) as n_grams,
        aggregate({_GRAMS}, 0L, (a, g) -> a + ratio[g]) as total))"""
    made = one.select("id", F.length(F.regexp_replace("text", _SPACE, "")).cast("long").alias("word_chars"), F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long").alias("n_dup_lines"), F.inline(F.expr(bound)))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    llr = F.col("total") / (F.col("n_grams") * float(UNIT))
    out = made.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), llr.alias("llr"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
