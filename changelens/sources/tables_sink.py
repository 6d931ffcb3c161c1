"""Parquet sinks: facts of a generation, and what several parts of a query read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, the warehouse serves in
    local mode; a cluster must name a folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_changelens"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def write_generation(df: DataFrame, partition: str, folder: str | None = None) -> str:
    """Write df partitioned by a column, one shuffle so that a partition is few files.
    Without a folder, a new shared one is used."""
    path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}" if folder else shared_folder(df.sparkSession)
    df.repartition(partition).write.partitionBy(partition).parquet(path)
    return path


def refresh(df: DataFrame, partition: str, path: str) -> None:
    """Replace the partitions that df has rows of, and leave all others as they are."""
    df.repartition(partition).write.partitionBy(partition).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def stored(df: DataFrame) -> DataFrame:
    """df, written once to a shared folder and read back: what several parts of a query need
    is computed once, and a lost executor costs nothing. The files go when the application
    ends."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)
