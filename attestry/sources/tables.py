"""Reading the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One table of a data folder; pruning and pushdown are left to Catalyst."""
    return spread(spark.read.parquet(f"{folder}/{table}.parquet"))


def spread(rows: DataFrame) -> DataFrame:
    """A scan of fewer splits than the session has cores, spread over them.

    A small file is one split, and wide expressions behind it would run in one
    task. Larger tables have more splits and are left as they are.
    """
    spark = rows.sparkSession
    try:
        cores = spark.sparkContext.defaultParallelism
        splits = rows.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - a remote session shows neither
        return rows
    return rows.repartition(cores) if 0 < splits < cores else rows
