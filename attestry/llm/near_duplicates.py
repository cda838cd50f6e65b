"""Near-duplicate records under small edits (problem 1).

A text is the set of its distinct ``shingle``-character substrings. Its sketch
has ``bands * rows`` coordinates, filled by rounds of hashed bin placement: in
round i every element falls into one bin with a value in [i, i + 1) and a bin
keeps its smallest value. The first rounds spread the elements over all bins;
from round ``bands * rows`` on, each round offers every element to one given bin,
so that all coordinates fill, at an expected cost near one hash an element
instead of one an element and coordinate. Two sets agree in a coordinate with
probability J, their Jaccard similarity.

``bands`` groups of ``rows`` coordinates are the candidates' keys, both chosen from
the number of records (``banding``): more rows keep chance meetings rare, more
bands keep the probability of a miss. With 80 bands of 6 a pair at exactly J = 0.7
is missed with probability (1 - 0.7^6)^80 < 5e-5, one at 0.75 with 2e-7. Candidates are thinned by 256 one-bit coordinates (a pair
at the threshold is lost with probability below 1e-8) and then verified exactly.

Exact copies are represented by the smallest id before anything is sketched, so
a group of copies of any size costs one sketch. There is no cap on buckets,
partners or candidates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.hashing import batches, code_points, mix64, window_hashes
from attestry.sources.scratch import materialize

#: Rows of ids that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000

_SIGNS = 4  # 64-bit words of one-bit coordinates
_BUCKET_ROWS = 500_000  # bucket rows that one task of the join is to read, up to ``_MOST_TASKS``
_MOST_TASKS = 20_000


def banding(n: int, threshold: float, miss: float = 5e-5, chance: float = 1 / 12, records: float = 5e6) -> tuple[int, int]:
    """Bands and rows for ``n`` records: ``miss`` is the probability of missing a pair at the threshold.

    Six rows up to ``records``, then one more for each ``1 / chance`` times as many,
    so that texts that agree in a coordinate by ``chance`` meet about as rarely for
    each record at any size.
    """
    rows = 6 + max(0, math.ceil(math.log(max(n, 1) / records) / math.log(1 / chance)))
    return math.ceil(math.log(miss) / math.log1p(-(threshold**rows))), rows


def sketch_batch(texts: list[str], size: int, shingle: int) -> np.ndarray:
    """Sketches (one row a text) of texts that have at least one shingle each."""
    points, ends = code_points(texts)
    hashes = window_hashes(points, shingle)
    owner = np.repeat(np.arange(len(texts)), np.diff(ends))[: len(hashes)]
    whole = np.arange(len(hashes)) + shingle <= ends[owner + 1]
    hashes, owner = hashes[whole], owner[whole]
    sketch = np.full(len(texts) * size, np.iinfo(np.uint64).max, np.uint64)
    empty = np.ones(len(texts) * size, bool)
    low = np.uint64(0xFFFFFFFF)
    for i in range(2 * size):
        g = mix64(hashes + np.uint64((2 * i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        if i < size:
            place = ((g >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        else:
            place = i - size
        place = owner * size + place
        free = empty[place]
        np.minimum.at(sketch, place[free], (np.uint64(i) << np.uint64(32)) | (g[free] & low))
        empty[place[free]] = False
        open_rows = empty.reshape(len(texts), size).any(axis=1)
        if not open_rows.any():
            break
        keep = open_rows[owner]
        hashes, owner = hashes[keep], owner[keep]
    return sketch.reshape(len(texts), size)


def _band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sketch.reshape(len(sketch), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sketch), bands)).copy()
    for r in range(rows):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key


def _one_bits(sketch: np.ndarray) -> np.ndarray:
    """The lowest bits of evenly spread coordinates, packed."""
    at = np.linspace(0, sketch.shape[1] - 1, _SIGNS * 64).astype(int)
    bits = (mix64(sketch[:, at]) & np.uint64(1)).astype(np.uint8)
    return np.ascontiguousarray(np.packbits(bits, axis=1)).view(np.uint64)


def _sketch_rows(bands: int, rows: int, shingle: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column(1).to_pylist()
            for a, b in batches(texts, 400_000):
                sketch = sketch_batch(texts[a:b], bands * rows, shingle)
                keys = _band_keys(sketch, bands, rows).view(np.int64)
                signs = _one_bits(sketch).view(np.int64)
                offsets = pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).slice(a, b - a), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))]
                    + [pa.array(np.ascontiguousarray(signs[:, k])) for k in range(_SIGNS)],
                    ["id", "keys", *(f"s{k}" for k in range(_SIGNS))],
                )

    return run


def _verified(threshold: float, shingle: int):
    def shingles(text: str) -> set[str]:
        return {text[i : i + shingle] for i in range(len(text) - shingle + 1)}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, b_set = None, set()
        for rows in parts:
            kept = []
            for a, b, left, right in zip(rows["id_a"], rows["id_b"], rows["text_a"], rows["text_b"], strict=True):
                if known != b:
                    known, b_set = b, shingles(right)
                a_set = shingles(left)
                common = len(a_set & b_set)
                if common >= threshold * (len(a_set) + len(b_set) - common):
                    kept.append((a, b))
            yield pd.DataFrame(kept, columns=["id_a", "id_b"]).astype("int64")

    return run


def exact_copies(records: DataFrame) -> DataFrame:
    """Members of groups of equal texts: ``id, first``; ``first`` is the smallest id."""
    named = records.select(
        "id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("text"), "text").alias("t2")
    )
    groups = (
        named.groupBy("t1", "t2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    )
    return named.join(groups, ["t1", "t2"]).select("id", "first").distinct()


def similar_texts(
    records: DataFrame, threshold: float = 0.7, shingle: int = 5, min_chars: int = 250,
    bands: int | None = None, rows: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Pairs of similar representatives ``id_a < id_b`` and the copies they stand for.

    ``records`` has ``id BIGINT, text``. Null ids, null texts and texts under
    ``min_chars`` take no part; an id delivered twice counts once. ``bands`` and
    ``rows`` are those of ``banding`` where they aren't given.
    """
    chosen = banding(records.count(), threshold)
    bands, rows = bands or chosen[0], rows or chosen[1]
    texts = records.where(
        F.col("id").isNotNull() & F.col("text").isNotNull() & (F.length("text") >= max(min_chars, shingle))
    ).select("id", "text")
    copies = materialize(exact_copies(texts), "copies")
    others = copies.where("id <> first").select("id")
    if others.count() <= BROADCAST_ROWS:
        others = F.broadcast(others)
    texts = texts.join(others, "id", "left_anti")

    signs = [f"s{k}" for k in range(_SIGNS)]
    sketches = materialize(
        texts.mapInArrow(
            _sketch_rows(bands, rows, shingle),
            "id long, keys array<long>, " + ", ".join(f"{s} long" for s in signs),
        ),
        "sketches",
    )
    spark = records.sparkSession
    tasks = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), sketches.count() * bands // _BUCKET_ROWS), _MOST_TASKS)
    bucket = sketches.select("id", F.explode("keys").alias("key")).repartition(tasks, "key")
    candidates = (
        bucket.withColumnRenamed("id", "id_a")
        .join(bucket.withColumnRenamed("id", "id_b"), "key")
        .where("id_a < id_b")
        .select("id_a", "id_b")
        .distinct()
    )
    sides = [
        sketches.select(F.col("id").alias(f"id_{x}"), *(F.col(s).alias(f"{s}_{x}") for s in signs)).distinct()
        for x in "ab"
    ]
    differing = sum((F.bit_count(F.col(f"{s}_a").bitwiseXOR(F.col(f"{s}_b"))) for s in signs), F.lit(0))
    agree = (1 + threshold) / 2
    bits = 64 * _SIGNS
    most = int(bits * (1 - agree) + 6 * (bits * agree * (1 - agree)) ** 0.5)
    likely = (
        candidates.join(sides[0], "id_a").join(sides[1], "id_b").where(differing <= most).select("id_a", "id_b")
    )
    likely = materialize(likely, "candidates")
    ids = likely.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    needed = materialize(texts.join(ids, "id", "left_semi").dropDuplicates(["id"]), "texts")
    pairs = (
        likely.join(needed.select(F.col("id").alias("id_a"), F.col("text").alias("text_a")), "id_a")
        .join(needed.select(F.col("id").alias("id_b"), F.col("text").alias("text_b")), "id_b")
        .mapInPandas(_verified(threshold, shingle), "id_a long, id_b long")
    )
    return pairs, copies


def similar_pairs(records: DataFrame, **options) -> DataFrame:
    """All pairs of different ids with similar texts: ``id_a < id_b``, each once.

    Copies are expanded: every member of a group is paired with the members of
    every similar group and of its own.
    """
    pairs, copies = similar_texts(records, **options)
    a = copies.select(F.col("first").alias("id_a"), F.col("id").alias("member_a"))
    b = copies.select(F.col("first").alias("id_b"), F.col("id").alias("member_b"))
    across = (
        pairs.join(a, "id_a", "left")
        .join(b, "id_b", "left")
        .select(F.coalesce("member_a", "id_a").alias("x"), F.coalesce("member_b", "id_b").alias("y"))
    )
    within = (
        a.withColumnRenamed("id_a", "first")
        .join(b.withColumnRenamed("id_b", "first"), "first")
        .where("member_a < member_b")
        .select(F.col("member_a").alias("x"), F.col("member_b").alias("y"))
    )
    return across.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def similar_classes(records: DataFrame, **options) -> DataFrame:
    """One row for each record: ``id, class_id, n_links``.

    ``class_id`` is the smallest id with the same text, ``n_links`` the number of
    different texts that are similar to it. Records that can't be compared (null
    or short text) are their own class with no link.
    """
    pairs, copies = similar_texts(records, **options)
    links = (
        pairs.select(F.explode(F.array("id_a", "id_b")).alias("class_id"))
        .groupBy("class_id")
        .agg(F.count("*").alias("n_links"))
    )
    ids = records.where("id IS NOT NULL").select("id").distinct()
    named = ids.join(copies, "id", "left").select("id", F.coalesce("first", "id").alias("class_id"))
    return named.join(links, "class_id", "left").fillna(0, ["n_links"]).select("id", "class_id", "n_links")
