"""Long exact spans shared between records (problem 8): seed and extend.

Seeds. Each stretch of ``min_length`` characters elects the smallest hash among
its k-grams (winnowing), so equal stretches elect the same anchor wherever they
stand. Only anchors of at least two different texts go on.

Extension. Records are joined on those anchors; each pair of records is extended
once per diagonal, over everything both share on it, which gives the maximal
repeats. Anchors with more than ``pair_limit`` places are not joined, as that
would emit all pairs of a hot passage. Their places are extended without pairs,
and just as exactly: every stretch of ``min_length`` characters that elected the
anchor is hashed (128 bits), and a hash of two texts marks its characters as
shared. Both ways together see each shared stretch, since equal stretches share
their anchor.

Identical texts are represented by the one with the smallest id; all of such a
text is shared. No key ever gathers more than its two extreme ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.hashing import batches, code_points, sliding_min, window_hashes
from attestry.sources.scratch import materialize

_BLOCK = 1_000_000  # characters of a text that are hashed at once


def _stretches(text: str, length: int) -> Iterator[tuple[int, str]]:
    """A long text in blocks that overlap so that no stretch is lost."""
    for start in range(0, max(1, len(text) - length + 1), _BLOCK):
        yield start, text[start : start + _BLOCK + length - 1]


def _elected(points: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of the anchor that each stretch of ``length`` characters elects."""
    grams = window_hashes(points, gram)
    width = length - gram + 1
    # 40 bits of the hash, then the place from the right: the minimum is the smallest hash, rightmost
    n = len(grams)
    place = np.arange(n, dtype=np.uint64)
    low = np.uint64((1 << 24) - 1)
    key = (grams & ~low) | (low - place)
    best = sliding_min(key, width)
    at = (low - (best & low)).astype(np.int64)
    return grams[at].view(np.int64), at


def _anchor_rows(length: int, gram: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            for a, b in batches(texts):
                doc, pos, hashes = [], [], []
                pieces = [(i, s, p) for i in range(a, b) for s, p in _stretches(texts[i], length) if len(p) >= length]
                for c, d in batches([p for _, _, p in pieces], 2 * _BLOCK):
                    points, ends = code_points([p for _, _, p in pieces[c:d]])
                    anchor, at = _elected(points, length, gram)
                    owner = np.searchsorted(ends, np.arange(len(at)), side="right") - 1
                    whole = np.arange(len(at)) + length <= ends[owner + 1]
                    at, anchor, owner = at[whole], anchor[whole], owner[whole]
                    new = np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else np.zeros(0, bool)
                    at, anchor, owner = at[new], anchor[new], owner[new]
                    shift = np.array([s for _, s, _ in pieces[c:d]], np.int64)
                    index = np.array([i for i, _, _ in pieces[c:d]], np.int64)
                    doc.append(np.array(ids, np.int64)[index[owner]])
                    pos.append((at - ends[owner] + shift[owner]).astype(np.int32))
                    hashes.append(anchor)
                if doc:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(x)) for x in (doc, pos, hashes)], ["doc_id", "pos", "anchor"]
                    )

    return run


def anchors(texts: DataFrame, min_length: int = 200, gram: int = 50) -> DataFrame:
    """Winnowed anchors of ``doc_id, text``: ``doc_id, pos INT, anchor BIGINT``."""
    return texts.select("doc_id", "text").mapInArrow(
        _anchor_rows(min_length, gram), "doc_id long, pos int, anchor long"
    )


def _common_runs(rows: pd.DataFrame, min_length: int) -> Iterator[tuple[int, int, int]]:
    """Maximal repeats of each pair on its diagonal, as spans of both records."""
    for a, b, diagonal, left, right in zip(
        rows["doc_a"], rows["doc_b"], rows["diagonal"], rows["text_a"], rows["text_b"], strict=True
    ):
        x = np.frombuffer(left.encode("utf-32-le", "surrogatepass"), np.uint32)
        y = np.frombuffer(right.encode("utf-32-le", "surrogatepass"), np.uint32)
        start = max(0, -diagonal)
        n = min(len(x) - start, len(y) - start - diagonal)
        same = np.zeros(n + 2, np.int8)
        same[1:-1] = x[start : start + n] == y[start + diagonal : start + diagonal + n]
        turn = np.diff(same)
        begin, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        for s, e in zip(begin, end, strict=True):
            if e - s >= min_length:
                yield a, start + s, start + e
                yield b, start + diagonal + s, start + diagonal + e


def _pair_spans(anchor_rows: DataFrame, texts: DataFrame, min_length: int) -> DataFrame:
    """Extend each pair of records once per diagonal."""
    a = anchor_rows.select("anchor", F.col("doc_id").alias("doc_a"), F.col("pos").alias("pos_a"))
    b = anchor_rows.select("anchor", F.col("doc_id").alias("doc_b"), F.col("pos").alias("pos_b"))
    pairs = (
        a.join(b, "anchor")
        .where("doc_a < doc_b")
        .select("doc_a", "doc_b", (F.col("pos_b") - F.col("pos_a")).alias("diagonal"))
        .distinct()
    )
    with_texts = pairs.join(
        texts.select(F.col("doc_id").alias("doc_a"), F.col("text").alias("text_a")), "doc_a"
    ).join(texts.select(F.col("doc_id").alias("doc_b"), F.col("text").alias("text_b")), "doc_b")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            yield pd.DataFrame(_common_runs(rows, min_length), columns=["doc_id", "start_pos", "end_pos"])

    return with_texts.mapInPandas(run, "doc_id long, start_pos int, end_pos int")


def _stretch_hashes(length: int, gram: int):
    """For hot places: both hashes of each stretch that elected one of them."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for doc, places, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                hot = np.array(sorted(places), np.int64)
                for shift, piece in _stretches(text, length):
                    points, _ = code_points([piece])
                    if len(points) < length:
                        continue
                    _, at = _elected(points, length, gram)
                    mine = np.flatnonzero(np.isin(at + shift, hot))
                    if len(mine):
                        h1 = window_hashes(points, length, 0)[mine].view(np.int64)
                        h2 = window_hashes(points, length, 1)[mine].view(np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(mine), doc, np.int64)), pa.array((mine + shift).astype(np.int32)), pa.array(h1), pa.array(h2)],
                            ["doc_id", "pos", "h1", "h2"],
                        )

    return run


def _hot_spans(hot_places: DataFrame, texts: DataFrame, min_length: int, gram: int) -> DataFrame:
    """Shared stretches at hot anchors, found by their hashes instead of by pairs."""
    by_doc = hot_places.groupBy("doc_id").agg(F.collect_list("pos").alias("places"))
    hashed = by_doc.join(texts, "doc_id").select("doc_id", "places", "text").mapInArrow(
        _stretch_hashes(min_length, gram), "doc_id long, pos int, h1 long, h2 long"
    )
    hashed = materialize(hashed, "stretches")
    shared = (
        hashed.groupBy("h1", "h2")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .where("first < last")
        .select("h1", "h2")
    )
    return hashed.join(shared, ["h1", "h2"], "left_semi").select(
        "doc_id", F.col("pos").alias("start_pos"), (F.col("pos") + min_length).alias("end_pos")
    )


def merge_spans(spans: DataFrame) -> DataFrame:
    """Unite overlapping and touching spans of each record into longest runs."""
    order = Window.partitionBy("doc_id").orderBy("start_pos", "end_pos")
    before = F.max("end_pos").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("before").isNull() | (F.col("start_pos") > F.col("before")), 1).otherwise(0)
    return (
        spans.withColumn("before", before)
        .withColumn("run", F.sum(opens).over(order))
        .groupBy("doc_id", "run")
        .agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"))
        .drop("run")
    )


def shared_spans(
    documents: DataFrame, min_length: int = 200, gram: int = 50, pair_limit: int = 8
) -> DataFrame:
    """Longest runs of characters that stand verbatim in another record too.

    ``doc_id, start_pos INT, end_pos INT``; positions count characters, the end
    is exclusive. A character is shared if some stretch of ``min_length``
    characters around it occurs in the text of another ``doc_id``. Null ids,
    null texts and shorter texts have no rows; a row delivered twice counts once.
    """
    docs = documents.where(
        F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.length("text") >= min_length)
    ).select("doc_id", "text")

    named = docs.select(
        "doc_id",
        F.length("text").alias("size"),
        F.xxhash64("text").alias("t1"),
        F.xxhash64(F.lit("text"), "text").alias("t2"),
    )
    groups = (
        named.groupBy("t1", "t2")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .where("first < last")
    )
    copies = named.join(groups, ["t1", "t2"]).select("doc_id", "size", "first")
    copies = materialize(copies, "copies")
    whole = copies.select("doc_id", F.lit(0).alias("start_pos"), F.col("size").alias("end_pos"))

    seeds = materialize(anchors(docs, min_length, gram), "anchors")
    joined = (
        seeds.groupBy("anchor")
        .agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .where("first < last")
        .select("anchor", "n")
    )
    places = seeds.join(joined, "anchor").join(
        copies.where("doc_id <> first").select("doc_id").distinct(), "doc_id", "left_anti"
    )
    places = materialize(places, "places")
    texts = materialize(docs.join(places.select("doc_id").distinct(), "doc_id", "left_semi"), "texts")

    pairs = _pair_spans(places.where(F.col("n") <= pair_limit), texts, min_length)
    hot = _hot_spans(places.where(F.col("n") > pair_limit), texts, min_length, gram)
    return merge_spans(whole.unionByName(pairs).unionByName(hot))


def shared_report(documents: DataFrame, min_length: int = 200) -> DataFrame:
    """How much of each record is shared: ``doc_id, n_chars, shared_chars, shared_part``.

    One row for each ``doc_id``; null and empty texts have 0 of 0 characters and part 0.
    """
    found = shared_spans(documents, min_length).groupBy("doc_id").agg(
        F.sum(F.col("end_pos") - F.col("start_pos")).alias("shared_chars")
    )
    sizes = documents.groupBy("doc_id").agg(F.coalesce(F.max(F.length("text")), F.lit(0)).alias("n_chars"))
    out = sizes.join(found, "doc_id", "left").fillna(0, ["shared_chars"])
    part = F.coalesce(F.try_divide(F.col("shared_chars"), F.col("n_chars")), F.lit(0.0))
    return out.withColumn("shared_part", part)
