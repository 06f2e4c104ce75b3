"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate

#: Hash buckets of n-grams, as a power of two, and the n-gram lengths.
BUCKET_BITS, LENGTHS = 14, (1, 2, 3)

#: Labelled documents of each language that are learned from, about: those with a hash of id, text and language below a bound that so many are expected to keep.
TRAIN_PER_LANGUAGE = 1500

_LETTER = regex.compile(r"\p{L}")
_U = np.uint32


def ngram_buckets(text: str) -> np.ndarray:
    """The bucket of every n-gram of the lower-cased text."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), _U)
    out, h = [], np.zeros(len(points), _U)
    with np.errstate(over="ignore"):
        for n in range(1, max(LENGTHS) + 1):
            if len(points) < n:
                break
            h = (h[: len(points) - n + 1] ^ (points[n - 1 :] + _U(n))) * _U(0x9E3779B1)
            h ^= h >> _U(15)
            if n in LENGTHS:
                out.append((h * _U(0x85EBCA6B)) >> _U(32 - BUCKET_BITS))
    return np.concatenate(out) if out else np.zeros(0, _U)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = TRAIN_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities of buckets x languages) from the rows of docs with a
    language and text, about per_language of each language (all, if it has no more). Rows
    are picked by a hash of id, text and language, so repeated rows are picked alike; ids may
    be null or equal. A language of which no picked row has an n-gram is learned from all of
    its rows; one without any n-gram is not learned."""
    size = 1 << BUCKET_BITS
    one = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).where("lang is not null and text is not null")
    one = one.withColumn("h", F.shiftrightunsigned(F.xxhash64("id", "text", "lang"), 11))
    # a row for each language
    limits = {r.lang: int(min(1, per_language / r.n) * 2**53) for r in one.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(limits)
    if not langs:
        return [], np.zeros((size, 0), np.float32)
    pick = F.lit(False)
    for lang in langs:
        pick = pick | ((F.col("lang") == lang) & (F.col("h") < limits[lang]))
    index = {lang: i for i, lang in enumerate(langs)}

    def count(batches):
        total = np.zeros((len(langs), size), np.int64)
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[index[lang]] += np.bincount(ngram_buckets(text), minlength=size)
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(bucket, pa.int32()), pa.array(total[lang, bucket], pa.int64())], names=["lang", "bucket", "n"])

    def counted(rows: DataFrame) -> np.ndarray:
        sums = rows.select("text", "lang").mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
        table = sums.toPandas()  # buckets x languages rows at most
        out = np.zeros((size, len(langs)), np.int64)
        out[table["bucket"].to_numpy(np.int64), table["lang"].to_numpy(np.int64)] = table["n"].to_numpy()
        return out

    found = counted(one.where(pick))
    if missed := [lang for lang, n in zip(langs, found.sum(axis=0)) if not n]:
        found += counted(one.where(F.col("lang").isin(missed)))
    known = found.sum(axis=0) > 0
    langs, total = [lang for lang, has in zip(langs, known) if has], found[:, known] + 0.5
    return langs, np.log(total / total.sum(axis=0)).astype(np.float32)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or the columns `keep`) with lang_pred and score, the posterior of lang_pred
    under equal priors. Null texts, texts without a letter, and all texts if no language
    was learned, get `und` and score 0. Equal posteriors go to the language that comes
    first in code point order. A column named like a result is replaced."""
    langs, logp = model
    shared = docs.sparkSession.sparkContext.broadcast(logp)

    def predict(texts: list) -> dict:
        table, pred, score = shared.value, [], []
        for text in texts:
            if not langs or text is None or not _LETTER.search(text):
                pred.append("und")
                score.append(0.0)
                continue
            counts = np.bincount(ngram_buckets(text), minlength=len(table))
            seen = np.flatnonzero(counts)
            total = counts[seen].astype(np.float64) @ table[seen]
            best = int(np.argmax(total))
            pred.append(langs[best])
            score.append(float(1 / np.exp(total - total[best]).sum()))
        return {"lang_pred": pred, "score": score}

    return annotate(docs, predict, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], text_col, keep)


__all__ = ["identify", "ngram_buckets", "train"]
