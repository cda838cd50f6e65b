"""From pages to sources and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.html import body_text, page_body
from attestry.functions.text import chunk_selector, fingerprint, group_chunks, split_sentences, url_hash


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with a column; the generator keeps later expressions from computing it again."""
    return rows.select(*(c for c in rows.columns if c != name), F.explode(F.array(value)).alias(name))


def _texts(pages: DataFrame) -> DataFrame:
    """``url, text`` of all pages."""
    bodies = _once(pages.select("url", "html"), "html", page_body(F.col("html")))
    return _once(bodies, "html", body_text(F.col("html"))).withColumnRenamed("html", "text")


def extracted(pages: DataFrame) -> DataFrame:
    """``url, text`` of ``url, html``; pages without text are left out (see ``quarantine``)."""
    return _texts(pages.where("url IS NOT NULL")).where("text <> ''")


def quarantine(pages: DataFrame) -> DataFrame:
    """Pages that can't be indexed, with the reason."""
    return _texts(pages).where("url IS NULL OR text IS NULL OR text = ''").select(
        "url", F.when(F.col("url").isNull(), "no address").otherwise("no text").alias("reason")
    )


def indexed(texts: DataFrame, size: int = 8) -> DataFrame:
    """``url, url_hash, shi_prefix, text, groups``: the sentences of each chunk; size is held between 5 and 15."""
    size = max(5, min(15, size))
    return texts.withColumn("groups", group_chunks(split_sentences(F.col("text")), size)).select(
        "url", url_hash(F.col("url")).alias("url_hash"), fingerprint(F.col("text")).alias("shi_prefix"), "text", "groups"
    )


def source_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        "url", "url_hash", "shi_prefix", F.size("groups").alias("total_chunks"), F.length("text").alias("full_text_length")
    )


def chunk_rows(rows: DataFrame) -> DataFrame:
    exploded = rows.select(
        "url", F.col("url_hash").alias("source_id"), "shi_prefix", F.posexplode("groups").alias("chunk_index", "sentences")
    )
    return exploded.select(
        "source_id", "chunk_index", F.array_join("sentences", " ").alias("text"), "sentences",
        chunk_selector(F.col("url"), F.col("chunk_index")).alias("css_selector"), "shi_prefix", "url",
    )


def summary(chunks: DataFrame, preview: int = 200) -> DataFrame:
    """What the index reports of each chunk."""
    return chunks.select(
        "source_id", F.col("chunk_index").alias("index"), F.size("sentences").alias("sentence_count"), "css_selector",
        F.substring("text", 1, preview).alias("text_preview"),
    )


def replace(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Stored rows of indexed sources replaced by the fresh ones."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh, allowMissingColumns=True)
