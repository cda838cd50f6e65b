"""Incremental indexing: a folder of page files becomes sources and chunks as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from attestry.operators import catalog, index

PAGE_SCHEMA = "url string, html string, fetched_at timestamp"


def index_batch(pages: DataFrame, size: int = 8) -> tuple[DataFrame, DataFrame]:
    """Sources and chunks of a batch; of a page fetched twice in it the last state counts."""
    last = catalog.latest(pages, ["url"], "fetched_at")
    rows = index.indexed(index.extracted(last), size)
    times = last.select("url", F.col("fetched_at").alias("indexed_at"))
    return index.source_rows(rows).join(times, "url"), index.chunk_rows(rows)


def start_index(spark: SparkSession, folder: str, out: str, checkpoint: str, size: int = 8) -> StreamingQuery:
    """Follow ``folder`` and append change logs ``out/sources`` and ``out/chunks``.

    Each log row carries the batch that wrote it, so a batch that is retried is
    recognised; ``current`` reads the state now stored.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        sources, chunks = index_batch(batch, size)
        for name, rows in (("sources", sources), ("chunks", chunks)):
            rows.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        batch.unpersist()

    pages = spark.readStream.schema(PAGE_SCHEMA).parquet(folder)
    return (
        pages.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """Sources and chunks as last indexed: a source's chunks are those of its last batch."""
    sources = spark.read.option("basePath", f"{out}/sources").parquet(f"{out}/sources/batch=*")
    chunks = spark.read.option("basePath", f"{out}/chunks").parquet(f"{out}/chunks/batch=*")
    last = sources.groupBy("url_hash").agg(F.max("batch").alias("batch"))
    return (
        sources.join(last, ["url_hash", "batch"]).drop("batch"),
        chunks.join(last.withColumnRenamed("url_hash", "source_id"), ["source_id", "batch"]).drop("batch"),
    )


def claim_rate(events: DataFrame, late: str = "10 minutes", every: str = "5 minutes") -> DataFrame:
    """Verified and failed claims by window of their time; works on a stream and on a table."""
    return (
        events.withWatermark("created_at", late)
        .groupBy(F.window("created_at", every))
        .agg(F.count_if("verified").alias("passed"), F.count_if(~F.col("verified")).alias("failed"))
        .select(F.col("window.start").alias("start"), "passed", "failed")
    )
