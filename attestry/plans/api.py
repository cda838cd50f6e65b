"""The operations of the service as plain functions over DataFrames.

A ``Store`` names the collections; every operation returns DataFrames and leaves
writing to the caller, except ``reset``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions.markers import grounded_text
from attestry.operators import catalog, crawl, index, search, verify
from attestry.sources.tables import read

COLLECTIONS = ("sources", "chunks", "claims", "relationships", "registry")
TASK_SCHEMA = (
    "task_id string, status string, start_url string, started_at timestamp, completed_at timestamp, "
    "progress struct<phase:string,urls_discovered:bigint,urls_indexed:bigint,total_to_index:bigint>, error string"
)


@dataclass(frozen=True)
class Store:
    """The stored collections of one folder or of given frames."""

    sources: DataFrame
    chunks: DataFrame
    claims: DataFrame | None = None
    relationships: DataFrame | None = None
    registry: DataFrame | None = None

    @classmethod
    def of(cls, spark: SparkSession, folder: str) -> Store:
        return cls(*(read(spark, folder, name) for name in COLLECTIONS))


def index_pages(store: Store, pages: DataFrame, sentences_per_chunk: int = 8) -> Store:
    """The store with pages indexed; earlier chunks of the same address are replaced."""
    rows = index.indexed(index.extracted(pages), sentences_per_chunk)
    sources = index.source_rows(rows).withColumn("indexed_at", F.current_timestamp())
    chunks = index.chunk_rows(rows)
    return Store(
        index.replace(store.sources, sources, "url_hash"), index.replace(store.chunks, chunks, "source_id"),
        store.claims, store.relationships, store.registry,
    )


def check_indexed(
    store: Store, query: str, vector: list[float] | None = None, embed: Callable[[Column], Column] | None = None
) -> tuple[DataFrame, DataFrame]:
    """The answerability of a query (one row) and its hits in their context; by vectors first, if the query has one."""
    hits = search.search(store.chunks, query, vector, embed=embed)
    return search.check_indexed(store.chunks, store.sources, query, hits=hits), search.check_hits(store.chunks, query, hits=hits)


def search_sources(
    store: Store, query: str, vector: list[float] | None = None, limit: int = 5, embed: Callable[[Column], Column] | None = None
) -> DataFrame:
    return search.search(store.chunks, query, vector, limit, embed=embed)


def list_sources(store: Store) -> DataFrame:
    return catalog.list_sources(store.sources)


def count_sources(store: Store) -> DataFrame:
    return catalog.count_sources(store.sources)


def reset(spark: SparkSession, confirm: bool = False, names: tuple[str, ...] = COLLECTIONS) -> list[str]:
    """Drop the collections that exist as catalog tables; names what was dropped."""
    if not confirm:
        raise ValueError("reset needs confirm=True")
    there = [n for n in names if spark.catalog.tableExists(n)]
    for n in there:
        spark.sql(f"DROP TABLE {n}")
    return there


def clear(store: Store) -> tuple[Store, DataFrame]:
    """An empty store of the same schemas, and how many rows each collection lost."""
    frames = {n: getattr(store, n) for n in COLLECTIONS if getattr(store, n) is not None}
    return Store(**{n: df.limit(0) for n, df in frames.items()}), catalog.counts(frames)


def generate_grounded_text(claims: DataFrame) -> DataFrame:
    """``grounded`` for rows ``claim, shi_prefix, css_selector, rel_type, claim_ids, synthesis_text``."""
    columns = ("claim", "shi_prefix", "css_selector", "rel_type", "claim_ids", "synthesis_text")
    return claims.withColumn("grounded", grounded_text(*(F.col(c) for c in columns)))


def verify_claims(store: Store, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every claim of ``text_id, text`` with its verdict, and the verdict of each text."""
    rows = verify.verify_claims(texts, store.sources, store.chunks)
    return rows, verify.verdicts(rows)


def verify_pages(store: Store, texts: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same against pages ``url, html`` fetched anew, whose fingerprints are computed again."""
    rows = verify.verify_pages(texts, store.sources, index.extracted(pages))
    return rows, verify.verdicts(rows)


def build_registry(texts: DataFrame) -> DataFrame:
    """The audit records of texts as structs and as JSON."""
    return verify.registry_json(verify.registry(texts)).withColumn("generated_at", F.current_timestamp())


def crawl_and_index(
    store: Store, pages: DataFrame, start_url: str, max_depth: int = 2, max_urls: int = 50, include: str | None = None,
    exclude: str | None = None, external: bool = False, sentences_per_chunk: int = 8,
) -> tuple[Store, DataFrame]:
    """Discover pages of a snapshot from one address, index those at hand, and sum up."""
    found = crawl.crawl(crawl.page_links(pages, include, exclude, external), start_url, max_depth, max_urls)
    chosen = pages.join(found.select("url"), "url", "left_semi")
    after = index_pages(store, chosen, sentences_per_chunk)
    return after, crawl.crawl_summary(found, index.extracted(chosen))


def crawl_task(
    store: Store, pages: DataFrame, tasks_path: str, task_id: str, start_url: str, max_depth: int = 2, max_urls: int = 50, **options: object
) -> Store:
    """``crawl_and_index`` as a task whose states are appended to the table of ``TASK_SCHEMA`` at ``tasks_path``.

    Its states are ``running``, then ``completed`` with the numbers found and
    indexed, or ``failed`` with the error, which is raised again.
    """
    spark = pages.sparkSession
    started = datetime.now(UTC)

    def state(status: str, phase: str, found: int = 0, done: int = 0, error: str | None = None) -> None:
        ended = None if status == "running" else datetime.now(UTC)
        row = (task_id, status, start_url, started, ended, (phase, found, done, found), error)
        catalog.append(spark.createDataFrame([row], TASK_SCHEMA), tasks_path)

    state("running", "discovering")
    try:
        after, totals = crawl_and_index(store, pages, start_url, max_depth, max_urls, **options)
        sums = totals.first()
    except Exception as e:
        state("failed", "failed", error=str(e))
        raise
    state("completed", "done", sums.total_discovered, sums.total_indexed)
    return after


def latest_tasks(states: DataFrame) -> DataFrame:
    """The latest state of each task, as one row: those that have ended before those that run."""
    ranked = F.max_by(F.struct(*states.columns), F.struct(F.coalesce("completed_at", "started_at"), F.col("completed_at").isNotNull()))
    return states.groupBy("task_id").agg(ranked.alias("t")).select("t.*")


def crawl_status(tasks: DataFrame, task_id: str) -> DataFrame:
    """One task of the table of ``TASK_SCHEMA``."""
    return catalog.lookup(latest_tasks(tasks), "task_id", task_id)


def crawl_tasks(tasks: DataFrame) -> DataFrame:
    return latest_tasks(tasks).select("task_id", "status", "start_url", "started_at", "progress.urls_indexed").orderBy("started_at", "task_id")
