"""Matching a claim against a source text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestry.functions.fixed import WS
from attestry.functions.text import strip

LINE_OVERLAP = 0.6


def tokens(text: Column) -> Column:
    """Distinct runs of letters a-z, digits and ``$`` in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9$]+"), F.lit(0)))


def claim_text(text: Column, claim_id: Column) -> Column:
    """The sentence before a claim's first marker, looked for in 500 characters; null if there is none."""
    at = F.call_function("locate", F.concat(F.lit("[C"), claim_id.cast("string"), F.lit(":")), text)
    start = F.greatest(at - 500, F.lit(1))
    before = strip(F.substring(text, start, at - start))
    return F.when(at > 0, F.element_at(F.split(before, f"(?<=[.!?]){WS}+"), -1))


def exact_match(claim: Column, source: Column) -> Column:
    return F.contains(F.lower(source), F.lower(claim))


def fuzzy_match(claim: Column, source: Column) -> Column:
    """All tokens occur, or a line overlaps by 60 %, or a figure of the claim occurs."""
    own, theirs = tokens(claim), tokens(source)
    subset = F.size(F.array_except(own, theirs)) == 0
    overlap = F.exists(
        F.split(F.lower(source), "\n+"),
        lambda line: F.transform(
            F.array(tokens(line)),
            lambda t: F.coalesce(
                F.try_divide(F.size(F.array_intersect(own, t)), F.size(F.array_union(own, t))), F.lit(0.0)
            ),
        )[0] >= LINE_OVERLAP,
    )
    figures = F.regexp_extract_all(claim, F.lit(r"\$?[0-9]+\.?[0-9]*"), F.lit(0))
    return (F.size(own) > 0) & (subset | overlap | F.exists(figures, lambda v: F.contains(source, v)))


def match_method(claim: Column, source: Column) -> Column:
    """``exact``, ``fuzzy`` or ``none``; ``none`` where a side is missing or the claim is empty."""
    return (
        F.when((F.length(claim) > 0) & F.coalesce(exact_match(claim, source), F.lit(False)), "exact")
        .when((F.length(claim) > 0) & F.coalesce(fuzzy_match(claim, source), F.lit(False)), "fuzzy")
        .otherwise("none")
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 for empty or zero ones, over the common length for unequal ones."""

    def square(v: Column) -> Column:
        return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))

    n = F.least(F.size(a), F.size(b))
    dot = F.aggregate(
        F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0), lambda s, x: s + x,
    )
    norm = F.sqrt(square(a)) * F.sqrt(square(b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0) & (norm > 0), dot / norm).otherwise(0.0)


def tier(confidence: Column) -> Column:
    return F.when(confidence >= 0.7, "HIGH").when(confidence >= 0.4, "MEDIUM").otherwise("LOW")
