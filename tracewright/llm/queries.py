"""The opN_ queries: each applies its operator to its whole table and returns digests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, exact_dedup, importance, language_id, line_dedup, minhash, mixing, pii, quality, sql, substrings, toxicity, url_filter
from .common import held_out

#: The rules of op1: verdict, host, path.
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def vocabulary() -> str:
    """Path of the tokenizer file; another one may be given to bpe.encode()."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules)


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, similarity=80)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~held_out()))
    return language_id.identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model, keep=["doc_id", "held_out"])


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), vocabulary(), keep=["doc_id"], ids=False, digests=True)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.train(docs), keep=["doc_id"])


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return quality.assess(docs, quality.log_ratios(docs, trusted))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return toxicity.score(docs.select("doc_id", held_out().alias("held_out"), "text"), model, keep=["doc_id", "held_out"])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centres = centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))
    # a row for each of the 40 centroids
    digest = centres.select("cluster", "cluster_inertia", "inertia", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))
    return assigned.join(F.broadcast(digest), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.dedup_substrings(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_url_filter, op2_minhash, op3_exact_dedup, op4_language_id, op5_bpe, op6_line_dedup, op7_pii, op8_quality, op9_toxicity, op10_mixing, op11_centroids, op12_substring_dedup, op13_importance)
    return {f.__name__: f for f in every}


_OP1 = """
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules AS (
  SELECT * FROM (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')) t(verdict, rhost, rpath)),
fits AS (
  SELECT page_id, rhost || rpath AS rule, verdict FROM named JOIN rules
    ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC) = 1)
SELECT n.page_id, coalesce(n.host, '') AS host, coalesce(n.path, '') AS path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM named n LEFT JOIN fits f USING (page_id)
"""

_OP3 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body FROM documents),
g AS (
  SELECT body, first(doc_id ORDER BY n_points DESC, doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.body) AS text_sha256
FROM d JOIN g ON d.body = g.body
"""


def oracle_sql() -> dict[str, str]:
    """Where SQL expresses the whole result; the others are tested against brute force."""
    return {"op1_url_filter": _OP1, "op3_exact_dedup": _OP3, "op11_centroids": sql.OP11, "op12_substring_dedup": sql.OP12, "op13_importance": sql.OP13}
