"""Claim and relationship markers: making, parsing and grounded text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestry.functions import fixed
from attestry.functions.text import fingerprint


def claim_marker(claim_id: Column, prefix: Column, selector: Column) -> Column:
    return F.concat(F.lit("[C"), claim_id.cast("string"), F.lit(":"), prefix, F.lit(":css="), selector, F.lit("]"))


def relation_marker(rel_id: Column, rel_type: Column, claim_ids: Column) -> Column:
    """A relationship marker; an unknown type is an error."""
    bad = F.raise_error(F.concat(F.lit("unknown relationship type: "), F.coalesce(rel_type, F.lit("null"))))
    good = F.concat(
        F.lit("(R"), rel_id.cast("string"), F.lit(":"), rel_type, F.lit(":"), F.array_join(claim_ids, ","), F.lit(")")
    )
    return F.when(rel_type.isin(*fixed.RELATION_TYPES), good).otherwise(bad.cast("string"))


def parse_claim_markers(text: Column) -> Column:
    """``ARRAY<STRUCT<claim_id BIGINT, shi_prefix, css_selector, marker>>`` in order; null texts have none."""
    found = F.regexp_extract_all(text, F.lit(fixed.CLAIM_MARKER), F.lit(0))
    return F.transform(
        F.coalesce(found, F.array().cast("array<string>")),
        lambda m: F.struct(
            F.regexp_extract(m, fixed.CLAIM_MARKER, 1).try_cast("bigint").alias("claim_id"),
            F.regexp_extract(m, fixed.CLAIM_MARKER, 2).alias("shi_prefix"),
            F.regexp_extract(m, fixed.CLAIM_MARKER, 3).alias("css_selector"),
            m.alias("marker"),
        ),
    )


def parse_relation_markers(text: Column) -> Column:
    """``ARRAY<STRUCT<rel_id BIGINT, rel_type, claim_ids ARRAY<STRING>, marker>>`` in order."""
    found = F.regexp_extract_all(text, F.lit(fixed.RELATION_MARKER), F.lit(0))
    return F.transform(
        F.coalesce(found, F.array().cast("array<string>")),
        lambda m: F.struct(
            F.regexp_extract(m, fixed.RELATION_MARKER, 1).try_cast("bigint").alias("rel_id"),
            F.regexp_extract(m, fixed.RELATION_MARKER, 2).alias("rel_type"),
            F.split(F.regexp_extract(m, fixed.RELATION_MARKER, 3), ",").alias("claim_ids"),
            m.alias("marker"),
        ),
    )


def grounded_text(
    claim: Column, prefix: Column, selector: Column, rel_type: Column, claim_ids: Column, synthesis: Column
) -> Column:
    """A claim with its marker and, for a known type, the relationship line below it.

    Missing fingerprints are made from the claim, missing selectors and claim ids
    get their defaults; an unknown type adds no line.
    """
    p = F.when(F.length(prefix) > 0, prefix).otherwise(fingerprint(claim))
    s = F.when(F.length(selector) > 0, selector).otherwise(F.lit(fixed.AUTO_SELECTOR))
    ids = F.when(F.size(claim_ids) > 0, claim_ids).otherwise(F.array(F.lit("C1")))
    note = F.when(F.length(synthesis) > 0, synthesis).otherwise(F.concat(F.lit("Relationship: "), rel_type))
    known = rel_type.isin(*fixed.RELATION_TYPES)
    line = F.concat(
        F.lit("\n"), note, F.lit(" (R1:"), rel_type, F.lit(":"), F.array_join(ids, ","), F.lit(")")
    )
    return F.concat(claim, F.lit(" "), claim_marker(F.lit(1), p, s), F.when(known, line).otherwise(F.lit("")))
