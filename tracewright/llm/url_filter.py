"""URL filter: allow and block rules on host and path, the longest fitting rule wins.

A rule fits its host and every subdomain of it when the url's path starts with the
rule's path. Hosts are keyed by their labels in reverse order (`com.example.`), so
that a rule's host covers one interval of the sorted keys and intervals nest. Urls
and rules are dealt out by key range (a rule to each range that its interval
touches), sorted, and swept once while a stack holds the rules whose interval is open.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Sampled keys for each key range: about this many times the ranges are sampled.
SAMPLES_PER_RANGE = 40


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or without `://`."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty for null or without `://`."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse order, each followed by a dot: `a.example.com` gives `com.example.a.`."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", ranges: int | None = None) -> DataFrame:
    """One row for each row of pages: id_col, host, path, rule, verdict.

    rules: verdict, host, path; path starts with `/` or is empty. The longest rule
    (code points of host and path) wins, of equals the one whose text comes first, then
    `allow` before `block`. Rules with a null host or verdict are ignored; a null path
    counts as empty. Without a fitting rule, rule is null and the verdict `default`.
    Null urls, empty urls and urls without `://` have empty host and path, which no
    rule with a host fits. Repeated rows and null ids give a row each; other columns of
    pages are not read.
    """
    spark = pages.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    url = F.col(f"`{url_col}`").cast("string")
    urls = pages.select(F.col(f"`{id_col}`").alias("id"), url_host(url).alias("host"), url_path(url).alias("path"))
    # the id at the end lets ranges cut through many rows of one url
    urls = urls.withColumn("key", F.concat_ws("\x00", host_key(F.col("host")), "path", F.coalesce(F.col("id").cast("string"), F.lit(""))))
    # keys with a small hash: each task sends its share of the sample, not a sample of its own
    part = min(1.0, SAMPLES_PER_RANGE * ranges / max(1, urls.count()))
    found = urls.select("key").where(F.shiftrightunsigned(F.xxhash64("key"), 11) < int(part * 2**53)).distinct().collect()
    keys = sorted(r.key for r in found)
    cuts = np.array(sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if len(keys) > ranges else [], dtype=object)

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy(), side="right").astype("int32") if len(cuts) else np.zeros(len(key), "int32"))

    empty = F.lit(None).cast("string")
    one = urls.withColumn("range", range_of("key")).select("range", "key", F.lit(1).alias("kind"), "id", "host", "path", empty.alias("rule"), empty.alias("verdict"))
    host = F.translate(F.col("host").cast("string"), _UPPER, _LOWER)
    kept = rules.where("host is not null and verdict is not null").select(host.alias("host"), F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), "verdict").distinct()
    kept = kept.withColumn("key", host_key(F.col("host")))
    first, last = range_of("key"), range_of(F.concat("key", F.lit("\U0010ffff")))
    spread = kept.withColumn("range", F.explode(F.sequence(first, last)))
    two = spread.select("range", "key", F.lit(0).alias("kind"), F.lit(None).cast(urls.schema["id"].dataType).alias("id"), "host", "path", F.concat("host", "path").alias("rule"), "verdict")
    swept = one.unionByName(two).repartition(ranges, "range").sortWithinPartitions("range", "key", "kind")
    schema = urls.select("id", "host", "path").schema.add("rule", "string").add("verdict", "string")
    return swept.mapInPandas(_sweep(default), schema).withColumnRenamed("id", id_col)


def _sweep(default: str):
    def run(batches):
        stack: list[tuple[str, list[tuple]]] = []  # open intervals, the outer ones first
        at = None
        for batch in batches:
            rules, verdicts, is_url = [], [], (batch["kind"] == 1).to_numpy()
            for rng, key, kind, path, rule, verdict in zip(batch["range"], batch["key"], batch["kind"], batch["path"], batch["rule"], batch["verdict"]):
                if rng != at:
                    stack.clear()
                    at = rng
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, []))
                    stack[-1][1].append((-len(rule), rule, verdict, path))
                    continue
                best = min((r for _, own in stack for r in own if path.startswith(r[3])), default=None)
                rules.append(best and best[1])
                verdicts.append(best[2] if best else default)
            out = batch.loc[is_url, ["id", "host", "path"]].reset_index(drop=True)
            out["rule"], out["verdict"] = pd.Series(rules, dtype=object), pd.Series(verdicts, dtype=object)
            yield out

    return run
