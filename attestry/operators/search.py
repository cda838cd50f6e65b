"""Keyword and vector search, confidence and neighbour context."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions.match import cosine, tier

#: Query vectors and rows that are compared in one block.
BLOCK = 1024
#: Vectors of one partition, and query vectors that may be broadcast.
PART, QUERIES = 1 << 20, 1 << 14


def keyword_score(query: str):
    """Number of sentences that contain the query."""
    q = F.lit(query.lower())
    return F.size(F.filter(F.coalesce("sentences", F.array().cast("array<string>")), lambda s: F.contains(F.lower(s), q)))


def keyword_search(chunks: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """The best chunks whose text or any sentence contains the query, without regard to case.

    ``source_id, chunk_index, url, text, score``; ties go by source and index. A
    chunk delivered twice counts once. An empty query is contained everywhere.
    """
    q = F.lit(query.lower())
    hit = F.coalesce(F.contains(F.lower("text"), q), F.lit(False)) | (keyword_score(query) > 0)
    found = chunks.where(hit).select(
        "source_id", "chunk_index", F.coalesce("url", F.lit("")).alias("url"), "text", keyword_score(query).alias("score")
    )
    return _top(found, limit)


def _top(found: DataFrame, limit: int) -> DataFrame:
    """The best of ``source_id, chunk_index, url, text, score``; a chunk found several times counts once.

    Only keys and scores are shuffled; texts are read for the ``limit`` best, which are broadcast.
    """
    names = ("source_id", "chunk_index", "score")
    best = found.groupBy("source_id", "chunk_index").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "source_id", "chunk_index").limit(limit)
    best = F.broadcast(best.select(*(F.col(c).alias(f"_{c}") for c in names)))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names))
    rows = found.join(best, same, "left_semi").groupBy(*names).agg(F.min(F.struct("url", "text")).alias("row"))
    return rows.select("source_id", "chunk_index", "row.url", "row.text", "score").orderBy(F.desc("score"), "source_id", "chunk_index")


def vector_search(vectors: DataFrame, query: list[float], limit: int = 5, min_score: float = 0.7) -> DataFrame:
    """The nearest rows ``id, score`` of ``id, embedding`` to one vector, scores to 4 places."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return (
        vectors.where("embedding IS NOT NULL AND size(embedding) > 0")
        .select("id", cosine(F.col("embedding"), q).alias("exact"))
        .where(F.col("exact") >= min_score)
        .select("id", F.round("exact", 4).alias("score"))
        .orderBy(F.desc("score"), "id")
        .limit(limit)
    )


def _matrix(ids: pa.Array, vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of rows of one dimension, read from the flat buffer."""
    m = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return ids.to_numpy(), np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def nearest(vectors: DataFrame, queries: DataFrame, limit: int = 10, min_score: float = -1.0, parts: int | None = None) -> DataFrame:
    """Nearest rows of every query vector: ``query_id, id, score``, by blocks.

    The queries are packed into blocks of about ``BLOCK``, the vectors spread over
    ``parts`` partitions (by default as many as there are shuffle partitions, more
    for more than ``PART`` vectors each). Each partition meets each block of
    queries of its dimension in turn: a matrix product for each ``BLOCK`` vectors,
    of which a query keeps its best rows, and one row of bests for each partition
    and query is ranked. A query isn't its own neighbour. Null and empty vectors
    take no part; zero vectors score 0. Exact, with scores to 4 places and ties by
    id; an id given twice counts once.
    """
    spark = vectors.sparkSession
    n_q = max(1, -(-queries.count() // BLOCK))
    n_v = vectors.count()
    parts = parts or max(1, min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_v // PART)), -(-n_v // BLOCK)))

    def good(rows: DataFrame) -> DataFrame:
        once = rows.where("id IS NOT NULL AND size(embedding) > 0").groupBy("id").agg(F.min("embedding").alias("embedding"))
        return once.withColumn("dim", F.size("embedding"))

    packed = (
        good(queries).groupBy("dim", F.pmod(F.xxhash64("id"), F.lit(n_q)).alias("q"))
        .agg(F.collect_list(F.struct("id", "embedding")).alias("rows"))
        .select("dim", "q", F.transform("rows", lambda r: r["id"]).alias("q_ids"), F.flatten(F.transform("rows", lambda r: r["embedding"])).alias("q_flat"))
    )
    blocks = (
        good(vectors).groupBy("dim", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n_v // BLOCK)))).alias("v"))
        .agg(F.collect_list(F.struct("id", "embedding")).alias("rows"))
        .select("dim", "v", F.transform("rows", lambda r: r["id"]).alias("v_ids"), F.flatten(F.transform("rows", lambda r: r["embedding"])).alias("v_flat"))
        .repartition(parts, "dim", "v")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, q_ids, q_flat, v_ids, v_flat = batch.columns
            for k, dim in enumerate(dims.to_pylist()):
                qi, q_m = _matrix(q_ids[k].values, pa.FixedSizeListArray.from_arrays(q_flat[k].values, dim))
                vi, v_m = _matrix(v_ids[k].values, pa.FixedSizeListArray.from_arrays(v_flat[k].values, dim))
                score = q_m @ v_m.T
                score[qi[:, None] == vi[None, :]] = -np.inf
                rounded = np.round(score, 4)
                out = [np.lexsort((vi, -rounded[i]))[: limit + 8] for i in range(len(qi))]
                rows = np.repeat(np.arange(len(qi)), [len(o) for o in out])
                cols = np.concatenate(out)
                keep = score[rows, cols] >= min_score
                rows, cols = rows[keep], cols[keep]
                yield pa.RecordBatch.from_arrays([pa.array(qi[rows]), pa.array(vi[cols]), pa.array(score[rows, cols])], ["query_id", "id", "exact"])

    if n_q * BLOCK <= QUERIES:  # a proven bound: ids and vectors of at most that many queries
        packed = F.broadcast(packed)
    met = blocks.join(packed, "dim").select("dim", "q_ids", "q_flat", "v_ids", "v_flat")
    found = met.mapInArrow(run, "query_id long, id long, exact double").withColumn("score", F.round("exact", 4))
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= limit).select("query_id", "id", "score", "rank")


def neighbours(chunks: DataFrame, reach: int = 2, stretch: int = 1024) -> DataFrame:
    """Each chunk's text with that of its neighbours in the same source.

    ``source_id, chunk_index, context, n_chunks``: texts of the indexes within
    ``reach``, in order, joined by a blank line; missing indexes are skipped and
    null texts left out. A source is worked on in stretches of indexes, whose
    borders are given the chunks they need of the next stretch, so that no
    window holds a whole source.
    """
    rows = (
        chunks.select("source_id", "chunk_index", "text")
        .dropna(subset=["source_id", "chunk_index"])
        .dropDuplicates(["source_id", "chunk_index"])
    )
    part = lambda i: F.floor(i / F.lit(stretch))
    homes = F.array_distinct(F.array(part(F.col("chunk_index")), part(F.col("chunk_index") - reach), part(F.col("chunk_index") + reach)))
    around = Window.partitionBy("source_id", "stretch").orderBy("chunk_index").rangeBetween(-reach, reach)
    return (
        rows.withColumn("stretch", F.explode(homes))
        .withColumn("texts", F.collect_list("text").over(around))
        .withColumn("n_chunks", F.count("*").over(around))
        .where(F.col("stretch") == part(F.col("chunk_index")))
        .select("source_id", "chunk_index", F.array_join("texts", "\n\n").alias("context"), "n_chunks")
    )


def check_indexed(chunks: DataFrame, sources: DataFrame, query: str, limit: int = 5, hits: DataFrame | None = None) -> DataFrame:
    """One row: whether the stored chunks can answer a query, and how surely.

    ``query, n_results, best_score, coverage, confidence, tier, answerable,
    sources_matched``, from the given hits (as those of ``search``, which looks for
    vectors first) or the keyword hits. Without a hit the tier is LOW with confidence 0.
    """
    hits = keyword_search(chunks, query, limit) if hits is None else hits
    total = sources.agg(F.countDistinct("url_hash").alias("total"))
    found = hits.agg(
        F.count("*").alias("n_results"),
        F.coalesce(F.max("score"), F.lit(0)).alias("best_score"),
        F.countDistinct(F.nullif("url", F.lit(""))).alias("sources_matched"),
    )
    coverage = F.least(F.col("n_results") / F.greatest(total.scalar(), F.lit(1)), F.lit(1.0))
    blend = F.least(F.lit(0.7) * F.col("best_score") + F.lit(0.3) * F.col("coverage"), F.lit(1.0))
    return (
        found.withColumn("coverage", coverage)
        .withColumn("blend", F.when(F.col("n_results") == 0, 0.0).otherwise(blend))
        .select(
            F.lit(query).alias("query"), "n_results", "best_score", F.round("coverage", 4).alias("coverage"),
            F.round("blend", 4).alias("confidence"), tier(F.col("blend")).alias("tier"),
            (F.col("blend") >= 0.7).alias("answerable"), "sources_matched",
        )
    )


def check_hits(
    chunks: DataFrame, query: str, limit: int = 5, reach: int = 2, preview: int = 1200, hits: DataFrame | None = None
) -> DataFrame:
    """The hits of a query with their neighbours, of the sources that were hit only."""
    hits = keyword_search(chunks, query, limit) if hits is None else hits
    near = chunks.join(hits.select("source_id").distinct(), "source_id", "left_semi")
    return (
        hits.join(neighbours(near, reach), ["source_id", "chunk_index"])
        .select(
            "source_id", "chunk_index", "score", "url", F.substring("context", 1, preview).alias("text_preview"),
            (F.length("context") > F.length("text")).alias("expanded"),
        )
    )


def search(
    chunks: DataFrame, query: str, vector: list[float] | None = None, limit: int = 5, most: int = 20, min_score: float = 0.7,
    embed: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Vector hits of at least ``min_score`` if there are any, otherwise keyword hits; at most ``most``, one at least.

    The query's vector is the given one or ``embed`` of the query; with neither, or
    with an empty one, only keywords are looked for.
    """
    limit = max(1, min(limit, most))
    words = keyword_search(chunks, query, limit).select("source_id", "chunk_index", "url", "text", F.col("score").cast("double").alias("score"))
    if vector:
        q = F.array(*(F.lit(float(x)) for x in vector))
    elif embed and (own := chunks.sparkSession.range(1).select(embed(F.lit(query))).first()[0]):
        q = F.array(*(F.lit(float(x)) for x in own))
    else:
        return words
    # the generator keeps the filter from being pushed below the score, which would compute it twice
    scored = chunks.where("size(embedding) > 0").withColumn("exact", F.explode(F.array(cosine(F.col("embedding"), q))))
    near = _top(
        scored.where(F.col("exact") >= min_score).select(
            "source_id", "chunk_index", F.coalesce("url", F.lit("")).alias("url"), "text", F.round("exact", 4).alias("score")
        ), limit,
    )
    return near.unionByName(words.where(near.agg(F.count("*")).scalar() == 0))
