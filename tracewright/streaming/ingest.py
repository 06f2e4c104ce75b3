"""Streaming ingest, an extension: documents that arrive as files become records in a table.

Each micro-batch is decoded by the same plans as a batch read and appended under its
number, so a batch that is run again after a failure replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.read import from_content


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (doc_id, text), one row for each file that appears in folder."""
    files = spark.readStream.format("text").option("wholetext", True).load(folder)
    return files.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def ingest(stream: DataFrame, table: str, checkpoint: str, format: str | None = None, once: bool = False) -> StreamingQuery:
    """Writes the records of the documents of stream below the folder table, partitioned by
    batch. checkpoint: a shared folder. once: take what is there and stop."""

    def write(batch: DataFrame, number: int) -> None:
        from_content(batch, format).write.mode("overwrite").parquet(f"{table}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
