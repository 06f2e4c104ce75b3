"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local session may lack it; it then gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"


#: Whether Spark deletes a query's shuffle files when it ends, or when the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_parquet(df: DataFrame, path: str) -> None:
    """Write df as Parquet. What was shuffled for it goes when it is written: nothing reads that
    again, and over a chain of tables the disk holds the shuffles of one, not of all."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)


#: Where the tables lie that may be released.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def releasable(table: DataFrame, path: str) -> DataFrame:
    """table, which release() deletes with the folder path."""
    _PATHS[table] = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete the files of written tables that no plan reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(_PATHS.pop(table))
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def settle(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read back: what depends on how rows are dealt is fixed, and
    lineage ends at files that outlive any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    write_parquet(df, path)
    return spark.read.schema(df.schema).parquet(path)
