"""Links of pages and bounded breadth-first discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions.html import decoded_href, hrefs, link_source
from attestry.functions.urls import is_page, is_skipped_link, resolve
from attestry.sources.scratch import materialize


def page_links(
    pages: DataFrame, include: str | None = None, exclude: str | None = None, external: bool = False
) -> DataFrame:
    """``url, pos, link``: the accepted links of each page, the first place of each."""
    # generators part the steps, so that no step is computed again inside a later condition
    sources = pages.where("url IS NOT NULL AND html IS NOT NULL").select("url", F.explode(F.array(link_source(F.col("html")))).alias("source"))
    raw = sources.select("url", F.posexplode(hrefs(F.col("source"))).alias("pos", "href"))
    named = raw.select("url", "pos", F.explode(F.array(decoded_href(F.col("href")))).alias("href")).where(~is_skipped_link(F.col("href")))
    found = named.select("url", "pos", F.explode(F.array(resolve(F.col("url"), F.col("href")))).alias("to"))
    links = found.where(is_page(F.col("url"), F.col("to"), include, exclude, external)).withColumn("link", F.regexp_replace("to", "/+$", ""))
    return links.groupBy("url", "link").agg(F.min("pos").alias("pos")).select("url", "pos", "link")


def crawl(links: DataFrame, start: str, max_depth: int = 2, max_urls: int = 50) -> DataFrame:
    """The first ``max_urls`` addresses in breadth-first order: ``rank, url, depth``.

    Depth 1 is the start alone. Each level is one join of the frontier with the
    links, ranked by the parent's rank and the place of the link; the loop runs
    ``max_depth - 1`` times at most and moves only row counts to the driver. The
    frontier never holds more than ``max_urls`` rows.
    """
    spark = links.sparkSession
    found = spark.createDataFrame([(1, start, 0)], "rank long, url string, depth int")
    frontier, n = found, 1
    for depth in range(1, max_depth):
        if n >= max_urls:
            break
        new = (
            frontier.join(links, "url")
            .groupBy("link").agg(F.min(F.struct("rank", "pos")).alias("at"))
            .join(found.select(F.col("url").alias("link")), "link", "left_anti")
            .orderBy("at").limit(max_urls - n)
        )
        # ranks by partitions of a total order: the rows before a partition, then the place in it
        placed = materialize(new.withColumn("part", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id()), "level")
        sizes = placed.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("low"), F.min("i").alias("first"))
        earlier = sizes.select("part", "first", (F.sum("n").over(Window.orderBy("low")) - F.col("n")).alias("base"))  # a row for each task
        rank = F.col("base") + F.col("i") - F.col("first") + n + 1
        level = materialize(placed.join(F.broadcast(earlier), "part").select(rank.cast("long").alias("rank"), F.col("link").alias("url"), F.lit(depth).alias("depth")), "ranked")
        size = level.count()
        if not size:
            break
        found, frontier, n = found.unionByName(level), level, n + size
    return found


def crawl_summary(found: DataFrame, indexed: DataFrame) -> DataFrame:
    """``total_discovered, total_indexed, total_failed`` of a crawl."""
    done = indexed.select("url").distinct().withColumn("done", F.lit(True))
    return found.join(done, "url", "left").agg(
        F.count("*").alias("total_discovered"), F.count_if(F.col("done").isNotNull()).alias("total_indexed"),
        F.count_if(F.col("done").isNull()).alias("total_failed"),
    )
