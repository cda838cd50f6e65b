"""Lines repeated across one source's documents (problem 5).

Every line keeps the set of its documents as a compressed bitmap: only the
64-bit words that hold a bit are stored, one row a word, so a line of one
document costs one row and a line of a million documents about 16 thousand.
Variants of a line (case, spacing, digits) share a key, their bitmaps are united
by ``bit_or``, cardinalities are exact popcounts, and the occurrences to delete
are found by looking up the document's bit.

A word row never holds more than 64 documents, so neither a hot source nor a hot
line is ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.sources.scratch import materialize

WORD_BITS = 6


def line_key(line: Column) -> Column:
    """Normal form of a line: lower case, single spaces, each digit run as ``0``."""
    spaced = F.regexp_replace(F.lower(line), "[ \\t\\u00a0]+", " ")
    return F.btrim(F.regexp_replace(spaced, "[0-9]+", "0"), F.lit(" "))


def _word(doc: Column) -> Column:
    return F.shiftright(doc, WORD_BITS)


def _bit(doc: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), doc.bitwiseAND(63).cast("int"))


def line_elements(chunks: DataFrame) -> DataFrame:
    """One row per line element: ``source_id, key1, key2, chunk_id, sentence_no``.

    The normal form is carried as two independent 64-bit hashes.
    """
    lines = chunks.where("source_id IS NOT NULL AND chunk_id IS NOT NULL").select(
        "source_id", "chunk_id", F.posexplode("sentences").alias("sentence_no", "line")
    )
    key = line_key(F.col("line"))
    return (
        lines.where("line IS NOT NULL")
        .withColumn("key", key)
        .select(
            "source_id",
            F.xxhash64("key").alias("key1"),
            F.xxhash64(F.lit("line"), "key").alias("key2"),
            "chunk_id",
            "sentence_no",
        )
    )


def line_bitmaps(elements: DataFrame) -> DataFrame:
    """Compressed bitmap of each line: ``source_id, key1, key2, word, bits``."""
    return elements.groupBy("source_id", "key1", "key2", _word(F.col("chunk_id")).alias("word")).agg(
        F.bit_or(_bit(F.col("chunk_id"))).alias("bits")
    )


def source_sizes(chunks: DataFrame) -> DataFrame:
    """Exact number of distinct documents of each source: ``source_id, n_docs``."""
    words = (
        chunks.where("source_id IS NOT NULL AND chunk_id IS NOT NULL")
        .groupBy("source_id", _word(F.col("chunk_id")).alias("word"))
        .agg(F.bit_or(_bit(F.col("chunk_id"))).alias("bits"))
    )
    return words.groupBy("source_id").agg(F.sum(F.bit_count("bits")).alias("n_docs"))


def repeated_lines(bitmaps: DataFrame, sizes: DataFrame, min_docs: int = 8, min_percent: int = 5) -> DataFrame:
    """Lines in at least ``min_docs`` documents and ``min_percent`` % of their source.

    ``source_id, key1, key2, n_line, n_docs`` from the bitmaps of the lines and the
    sizes of the sources.
    """
    counted = bitmaps.groupBy("source_id", "key1", "key2").agg(F.sum(F.bit_count("bits")).alias("n_line")).where(F.col("n_line") >= min_docs)
    return counted.join(sizes, "source_id").where(F.col("n_line") * 100 >= F.col("n_docs") * min_percent)


def repeated_line_elements(chunks: DataFrame, min_docs: int = 8, min_percent: int = 5) -> DataFrame:
    """Occurrences of repeated lines: ``chunk_id, sentence_no``, each once.

    Rows with a null source or document id belong to no source and are left out;
    null lines are no lines. Repeated deliveries of a chunk, ties and extra columns
    don't change the result; an empty table gives an empty one. The lines are cut
    and their keys computed once.
    """
    elements = materialize(line_elements(chunks), "lines")
    bitmaps = materialize(line_bitmaps(elements), "bitmaps")
    hits = repeated_lines(bitmaps, source_sizes(chunks), min_docs, min_percent).select("source_id", "key1", "key2")
    return (
        elements.withColumn("word", _word(F.col("chunk_id")))
        .join(bitmaps.join(hits, ["source_id", "key1", "key2"]), ["source_id", "key1", "key2", "word"])
        .where(F.col("bits").bitwiseAND(_bit(F.col("chunk_id"))) != 0)
        .select("chunk_id", F.col("sentence_no").cast("int").alias("sentence_no"))
        .distinct()
    )


def remove_repeated_lines(chunks: DataFrame, min_docs: int = 8, min_percent: int = 5) -> DataFrame:
    """``chunk_id, sentences, text`` of every chunk without its repeated lines.

    A chunk without arrays keeps its text; one that loses all lines gets ``""``.
    """
    found = (
        repeated_line_elements(chunks, min_docs, min_percent)
        .groupBy("chunk_id")
        .agg(F.collect_set("sentence_no").alias("drop_no"))
    )
    once = chunks.select("chunk_id", "sentences", "text").dropDuplicates(["chunk_id"])
    kept = F.filter("sentences", lambda s, i: ~F.array_contains("drop_no", i))
    sentences = F.when(F.col("drop_no").isNull(), F.col("sentences")).otherwise(kept)
    return (
        once.join(found, "chunk_id", "left")
        .withColumn("sentences", sentences)
        .select(
            "chunk_id",
            "sentences",
            F.when(F.col("drop_no").isNull(), F.col("text")).otherwise(F.array_join("sentences", " ")).alias("text"),
        )
    )
