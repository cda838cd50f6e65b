"""Matching claims against whole sources, whose texts are never gathered.

A source's text is its chunks in the order of their indexes. For the exact rule
they are joined by a space, as sentences are inside a chunk, so that a claim may
run over their borders; for the other rules each chunk keeps its own lines. The
rules are joins by words, tokens and figures, merged for each claim, so the work
doesn't grow with claims times chunks of a source.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions.match import tokens
from attestry.sources.scratch import materialize

BLOCK = 8_192
#: A claim is a part of 500 characters, which lower case at most doubles.
MARGIN = 1_000
STRETCH = 1_024

_BETWEEN = r"[\s\p{P}]"
_INNER_WORD = rf"(?<={_BETWEEN})[^\s\p{{P}}]+(?={_BETWEEN})"


def blocks(passages: DataFrame) -> DataFrame:
    """``key, block, low``: texts of ``key, at, text`` in lower case, cut into overlapping blocks.

    Any stretch of ``MARGIN`` characters of a source lies in one of its blocks.
    Positions are sums over stretches of indexes, so no window holds a source.
    """
    low = F.lower("text")
    rows = passages.where("text <> ''").select("key", F.floor(F.col("at") / STRETCH).alias("part"), "at", low.alias("low"))
    rows = rows.repartition("key", "part").distinct().withColumn("n", (F.length("low") + 1).cast("long"))
    before = F.sum("n").over(Window.partitionBy("key", "part").orderBy("at", "low").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    sums = passages.where("text <> ''").select("key", "at", (F.length(low) + 1).cast("long").alias("n"), F.xxhash64(low)).distinct()
    sums = sums.groupBy("key", F.floor(F.col("at") / STRETCH).alias("part")).agg(F.sum("n").alias("m"))
    base = sums.select("key", "part", (F.sum("m").over(Window.partitionBy("key").orderBy("part")) - F.col("m")).alias("base"))
    start = F.coalesce("base", F.lit(0)) + F.col("before")
    placed = rows.withColumn("before", before).join(F.broadcast(base.where("base > 0")), ["key", "part"], "left").select(
        "key", "low", start.alias("start"), (start + F.col("n") - 1).alias("stop")
    )
    first = F.greatest(F.floor((F.col("start") - MARGIN) / BLOCK), F.lit(0))
    spread = placed.withColumn("block", F.explode(F.sequence(first, F.floor((F.col("stop") - 1) / BLOCK))))
    lo = F.greatest("start", F.col("block") * BLOCK)
    hi = F.least("stop", (F.col("block") + 1) * BLOCK + MARGIN)
    piece = F.col("low").substr((lo - F.col("start") + 1).cast("int"), (hi - lo).cast("int"))
    pieces = spread.select("key", "block", F.struct(lo.alias("lo"), piece.alias("piece")).alias("p"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["piece"]), " ")
    return pieces.groupBy("key", "block").agg(joined.alias("low"))


def _complete(claims: DataFrame, passages: DataFrame) -> DataFrame:
    """``key, id, tokens_in, words_in``: whether all tokens of a claim, and all its inner words, occur in its source, wherever."""
    low = F.lower("claim")
    inner = F.array_distinct(F.regexp_extract_all(low, F.lit(_INNER_WORD), F.lit(0)))
    kinds = F.array(F.struct(F.lit(True).alias("token"), F.col("own").alias("items")), F.struct(F.lit(False).alias("token"), inner.alias("items")))
    wanted = claims.select("key", "id", F.explode(kinds).alias("k")).select("key", "id", "k.token", F.explode("k.items").alias("item"))
    items = F.array_union(F.split(F.lower("text"), _BETWEEN + "+"), tokens(F.col("text")))
    there = passages.select("key", F.explode(items).alias("item")).distinct()
    missing = wanted.join(there, ["key", "item"], "left_anti").groupBy("key", "id").agg(
        F.bool_or("token").alias("no_token"), F.bool_or(~F.col("token")).alias("no_word")
    )
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    rows = claims.select("key", "id", F.size("own").alias("n")).join(missing, ["key", "id"], "left")
    return rows.select("key", "id", ((F.col("n") > 0) & no("no_token")).alias("tokens_in"), no("no_word").alias("words_in"))


def _exact(claims: DataFrame, passages: DataFrame) -> DataFrame:
    """Claims that stand in their source, of those whose inner words all occur there."""
    cut = materialize(blocks(passages.join(claims.select("key").distinct(), "key", "left_semi")), "blocks")
    ends = cut.groupBy("key").agg(F.max("block").alias("last"))
    pairs = claims.join(ends, "key").select("key", "id", F.lower("claim").alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("block"))
    return pairs.join(cut, ["key", "block"]).where(F.contains("low", "own")).select("key", "id").distinct()


def _leading(own: Column) -> Column:
    """The tokens, long ones first, of which two sets that overlap by 60 % share one."""
    n = F.size(own)
    ordered = F.transform(F.sort_array(F.transform(own, lambda t: F.struct(-F.length(t), t.alias("t")))), lambda s: s["t"])
    return F.slice(ordered, 1, n - F.floor((n * 3 + 4) / 5).cast("int") + 1)


def _line(claims: DataFrame, passages: DataFrame) -> DataFrame:
    """Claims whose tokens overlap with those of one line by 60 %."""
    claims = claims.where("size(own) > 0")
    sizes = claims.groupBy("key").agg(F.min(F.size("own")).alias("least"), F.max(F.size("own")).alias("most"))
    lines = passages.select("key", F.explode(F.split(F.lower("text"), "\n+")).alias("line")).select("key", tokens(F.col("line")).alias("theirs"))
    lines = lines.join(sizes, "key").where("size(theirs) * 5 >= least * 3 AND size(theirs) * 3 <= most * 5").select("key", "theirs").distinct()
    own = claims.select("key", "id", "own", F.explode(_leading(F.col("own"))).alias("token"))
    pairs = own.join(lines.select("key", "theirs", F.explode(_leading(F.col("theirs"))).alias("token")), ["key", "token"])
    pairs = pairs.where("size(theirs) * 5 >= size(own) * 3 AND size(theirs) * 3 <= size(own) * 5")
    common = F.size(F.array_intersect("own", "theirs"))
    return pairs.where(common * 5 >= (F.size("own") + F.size("theirs") - common) * 3).select("key", "id").distinct()


def _number(claims: DataFrame, passages: DataFrame) -> DataFrame:
    """Claims of which a figure occurs in their source, also within a longer one."""
    figures = F.array_distinct(F.regexp_extract_all("claim", F.lit(r"\$?[0-9]+\.?[0-9]*"), F.lit(0)))
    own = claims.select("key", "id", F.explode(figures).alias("figure"))
    wanted = own.select("key", "figure", F.substring("figure", 1, 3).alias("gram")).distinct()
    runs = passages.select("key", F.explode(F.regexp_extract_all("text", F.lit("[$0-9.]+"), F.lit(0))).alias("run")).where(F.col("run").rlike("[0-9]")).distinct()
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.length("run")), lambda i: F.transform(F.array(*map(F.lit, (1, 2, 3))), lambda n: F.col("run").substr(i, n))))
    found = runs.select("key", "run", F.explode(F.array_distinct(grams)).alias("gram")).join(wanted, ["key", "gram"])
    found = found.where(F.contains("run", "figure")).select("key", "figure").distinct()
    return own.join(found, ["key", "figure"]).select("key", "id").distinct()


def methods(claims: DataFrame, passages: DataFrame) -> DataFrame:
    """``key, id, method``: how claims ``key, claim`` match the source ``key, at, text``.

    ``id`` is the MD5 of the claim. Claims that match by no rule have no row.
    """
    claims = claims.where("key IS NOT NULL AND claim <> ''").distinct().select("key", F.md5("claim").alias("id"), "claim", tokens(F.col("claim")).alias("own"))
    complete = materialize(_complete(claims, passages), "complete")
    possible = materialize(claims.join(complete.where("words_in"), ["key", "id"]).select("key", "id", "claim"), "possible")
    found = [_exact(possible, passages).withColumn("method", F.lit("exact"))]
    found += [df.select("key", "id", F.lit("fuzzy").alias("method")) for df in (complete.where("tokens_in"), _line(claims, passages), _number(claims, passages))]
    return reduce(DataFrame.unionByName, found).groupBy("key", "id").agg(F.min("method").alias("method"))
