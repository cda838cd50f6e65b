"""Mixing sources to target weights by Poisson replication (problem 7).

Each source gets a mean repetition rate from its weight, its size in tokens and
the size of the mixture. A row's count is the inverse of the Poisson distribution
at a uniform number hashed from the seed and the row's id, cut at the source's
cap. The Poisson parameter is the one at which the counts of these very rows, cut
and weighted by their tokens, reach the wanted size, by a histogram of the tokens
over the uniform numbers. Rows are exploded by their count and shuffled globally
by a hash.

Only per-source sums and histograms of a fixed number of bins (one row for each
source of the weights table) meet in one place; the documents are never gathered,
and a source's rows never share a key in a shuffle but in partial sums.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.llm.bpe import VOCABULARY, token_counts
from attestry.sources.scratch import materialize


#: Bins of the uniform numbers in which a source's tokens are summed.
BINS = 4096


def source_name(source: Column) -> Column:
    """Names of sources are compared trimmed and in lower case."""
    return F.lower(F.trim(source))


def copies_at(u: np.ndarray, lam: float, cap: int) -> np.ndarray:
    """Inverse of min(Poisson(lam), cap) at uniform numbers."""
    return np.searchsorted(np.array(_cumulative(lam, cap)), u, side="right")


def poisson_parameter(wanted: float, cap: int, tokens: np.ndarray) -> float:
    """The least parameter whose copies of the binned tokens reach the wanted number.

    ``tokens`` are sums over equal bins of the rows' uniform numbers. Infinite if
    even the cap doesn't exceed what is wanted.
    """
    if not wanted > 0 or cap < 1 or not tokens.sum() > 0:
        return 0.0
    u = (np.arange(len(tokens)) + 0.5) / len(tokens)
    if wanted >= tokens.sum() * cap * (1 - 1e-9):
        return math.inf
    low, high = 0.0, 1.0
    while (tokens * copies_at(u, high, cap)).sum() < wanted:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (tokens * copies_at(u, mid, cap)).sum() < wanted else (low, mid)
    return high


def _cumulative(lam: float, cap: int) -> list[float]:
    """P(count <= k) for k below the cap: as many steps as a row may have copies.

    The terms are taken from their logarithms, so that large parameters have them too.
    """
    if math.isinf(lam) or cap < 1:
        return [0.0] * cap
    if lam <= 0:
        return [1.0] * cap
    logs = np.concatenate([[-lam], -lam + np.cumsum(math.log(lam) - np.log(np.arange(1, cap)))])
    return np.minimum(np.cumsum(np.exp(logs)), 1.0).tolist()


@F.pandas_udf(T.DoubleType())
def _parameter(wanted: pd.Series, cap: pd.Series, tokens: pd.Series) -> pd.Series:
    rows = zip(wanted, cap, tokens, strict=True)
    return pd.Series([poisson_parameter(float(w), int(c), np.array(t, float)) for w, c, t in rows], dtype=float)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _steps(lam: pd.Series, cap: pd.Series) -> pd.Series:
    return pd.Series([_cumulative(float(v), int(c or 0)) for v, c in zip(lam, cap, strict=True)])


def sized_documents(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, source, n_tokens`` with normal source names, computed once."""
    columns = documents.select("doc_id", source_name(F.col("source")).alias("source"), "text")
    return materialize(token_counts(columns, vocabulary), "sized")


def mixing_plan(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7) -> DataFrame:
    """One row for each listed source: how often its rows are to be repeated.

    ``source, target_weight, max_repeats, n_docs, tokens_in, rate, lam, steps``.
    Without ``total_tokens`` the mixture is the largest in which every source
    that has tokens can still reach its weight under its cap. Rates beyond the
    cap are cut to it. A listed source without documents has rate 0; sources
    that aren't listed, and null sources, take no part.
    """
    wanted = targets.groupBy(source_name(F.col("source")).alias("source")).agg(
        F.sum("target_weight").alias("target_weight"), F.max("max_repeats").alias("max_repeats")
    )
    have = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens_in"))
    plan = wanted.where("source IS NOT NULL").join(have, "source", "left")
    plan = plan.fillna(0, ["n_docs", "tokens_in", "max_repeats"]).fillna(0.0, ["target_weight"])
    most = F.when(
        (F.col("tokens_in") > 0) & (F.col("target_weight") > 0),
        F.col("tokens_in") * F.col("max_repeats") / F.col("target_weight"),
    )
    if total_tokens is None:
        plan = plan.withColumn("total", plan.agg(F.min(most)).scalar())
    else:
        plan = plan.withColumn("total", F.lit(float(total_tokens)))
    rate = F.when(
        F.col("tokens_in") > 0,
        F.least(F.col("target_weight") * F.col("total") / F.col("tokens_in"), F.col("max_repeats").cast("double")),
    )
    bins = sized.where("source IS NOT NULL").groupBy("source", F.floor(_uniform(seed, "doc_id") * BINS).cast("int").alias("bin"))
    histogram = (
        bins.agg(F.sum("n_tokens").alias("tokens"))
        .groupBy("source")
        .agg(F.map_from_entries(F.collect_list(F.struct("bin", "tokens"))).alias("by_bin"))
    )
    tokens = F.transform(
        F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.coalesce(F.try_element_at("by_bin", i), F.lit(0)).cast("double")
    )
    return (
        plan.withColumn("rate", F.coalesce(rate, F.lit(0.0)))
        .join(histogram, "source", "left")
        .withColumn("lam", _parameter(F.col("rate") * F.col("tokens_in"), F.col("max_repeats"), tokens))
        .withColumn("steps", _steps("lam", "max_repeats"))
        .drop("total", "by_bin")
    )


def _uniform(seed: int, *columns: str) -> Column:
    """A number in [0, 1) from 53 bits of a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) / F.lit(float(1 << 53))


def mix(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7) -> DataFrame:
    """The mixture: ``doc_id, source, repeat_no, n_tokens, shuffle_key``.

    A row occurs ``repeat_no`` = 0, 1, ... times, never more often than its
    source's cap. The output is range-partitioned and sorted by ``shuffle_key``,
    a hash of id and copy, which is the global shuffle.
    """
    plan = mixing_plan(sized, targets, total_tokens, seed).select("source", "steps")
    u = _uniform(seed, "doc_id")
    counted = sized.join(plan, "source").withColumn("u", u)
    copies = F.size(F.filter("steps", lambda step: step <= F.col("u")))
    return (
        counted.withColumn("copies", copies)
        .where("copies > 0")
        .select("doc_id", "source", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("repeat_no"), "n_tokens")
        .withColumn("shuffle_key", F.xxhash64(F.lit(seed + 1), "doc_id", "repeat_no"))
        .repartitionByRange("shuffle_key")
        .sortWithinPartitions("shuffle_key")
    )


def mix_documents(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None,
                  seed: int = 7, vocabulary: str = VOCABULARY) -> DataFrame:
    """``mix`` over a table of texts, sized by the public tokenizer."""
    return mix(sized_documents(documents, vocabulary), targets, total_tokens, seed)


def mixture_shares(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None,
                   seed: int = 7, vocabulary: str = VOCABULARY) -> DataFrame:
    """Shares reached, one row for each listed source.

    ``source, target_weight, max_repeats, n_docs, tokens_in, rate, rows_out,
    tokens_out, max_used, actual_share``; a source without documents has zeros.
    Empty and null texts have size 0; they take part but add nothing.
    """
    sized = sized_documents(documents, vocabulary)
    plan = mixing_plan(sized, targets, total_tokens, seed).drop("lam")
    copies = F.size(F.filter("steps", lambda step: step <= F.col("u")))
    used = (
        sized.join(plan.select("source", "steps"), "source")
        .withColumn("u", _uniform(seed, "doc_id"))
        .withColumn("copies", copies)
        .groupBy("source")
        .agg(
            F.sum("copies").alias("rows_out"),
            F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens_out"),
            F.max("copies").alias("max_used"),
        )
    )
    out = plan.drop("steps").join(used, "source", "left").fillna(0, ["rows_out", "tokens_out", "max_used"])
    whole = out.agg(F.sum("tokens_out")).scalar()
    return out.withColumn("actual_share", F.coalesce(F.try_divide(F.col("tokens_out"), whole), F.lit(0.0)))
