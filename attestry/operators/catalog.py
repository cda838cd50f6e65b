"""Stored collections: latest states, deletes, listings and counts.

A collection is an append-only change log; what is stored now is derived from
it. ``latest`` merges field by field, so that a field absent (null) in a later
change keeps its earlier value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _row_text(fields: list[str], types: dict[str, str]) -> Column:
    """A text of a whole row, by which rows of one version are ordered."""
    parts = [F.array_join(c, ",") if types[c].startswith("array<string") else F.col(c).cast("string") for c in fields]
    return F.md5(F.concat_ws("\x1f", *(F.coalesce(p, F.lit("")) for p in parts)))


def latest(changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row for each key: of every other column the latest value that isn't null.

    Changes without a version count as older than all others. Changes of one
    version are ordered as whole rows, by the MD5 of their values, so that ties
    have one result and never mix two rows but for nulls. Rows with a null key are
    no documents. All states merge in partial aggregates, so a key with many
    changes is never gathered.
    """
    fields = [c for c in changes.columns if c not in keys]
    present = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    place = F.struct(F.col(version).alias("version"), _row_text([c for c in fields if c != version], dict(changes.dtypes)).alias("row"))
    ordered = changes.where(present).withColumn("_place", place)
    newest = {c: F.max(F.when(F.col(c).isNotNull(), F.struct("_place", F.col(c).alias("value"))))["value"] for c in fields}
    return ordered.groupBy(*keys).agg(*(v.alias(c) for c, v in newest.items()))


def once(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows delivered several times unchanged, once; null keys are left out."""
    return rows.dropna(subset=keys).dropDuplicates(keys)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def lookup(rows: DataFrame, column: str, value: object) -> DataFrame:
    """At most one row whose column has a value."""
    return rows.where(F.col(column) == F.lit(value)).limit(1)


def listed(rows: DataFrame, column: str, value: object, order: str) -> DataFrame:
    """The rows of one text or source in the order of a column; ids as text, so that C10 comes before C2."""
    return rows.where(F.col(column) == F.lit(value)).orderBy(order)


def delete(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows left when those with the given keys are deleted."""
    return rows.join(keys.select(*on).distinct(), on, "left_anti")


def delete_sources(sources: DataFrame, chunks: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources and chunks left when the sources ``keys.url_hash`` go with all their chunks."""
    gone = keys.select("url_hash").distinct()
    return (
        sources.join(gone, "url_hash", "left_anti"),
        chunks.join(gone.withColumnRenamed("url_hash", "source_id"), "source_id", "left_anti"),
    )


def list_sources(sources: DataFrame) -> DataFrame:
    """The listing of stored sources."""
    return latest(sources, ["url_hash"], "indexed_at").select(
        "url", "shi_prefix", "total_chunks", "url_hash", "indexed_at"
    )


def count_sources(sources: DataFrame) -> DataFrame:
    return sources.where("url_hash IS NOT NULL").agg(F.countDistinct("url_hash").alias("n_sources"))


def counts(collections: dict[str, DataFrame]) -> DataFrame:
    """``collection, n_rows`` of each collection, 0 for an empty one."""
    parts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("collection"), "n_rows") for n, df in collections.items()]
    return reduce(DataFrame.unionByName, parts)


def conflicts(sources: DataFrame) -> DataFrame:
    """Fingerprints that several addresses claim: ``shi_prefix, n_urls, first_url``."""
    return (
        latest(sources, ["url_hash"], "indexed_at")
        .where("shi_prefix IS NOT NULL")
        .groupBy("shi_prefix")
        .agg(F.count("*").alias("n_urls"), F.min("url").alias("first_url"))
        .where("n_urls > 1")
    )
