"""Verification of claims in grounded texts, and the audit registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions import fixed
from attestry.functions.markers import parse_claim_markers, parse_relation_markers
from attestry.functions.match import claim_text, match_method
from attestry.functions.text import fingerprint, url_hash
from attestry.operators import whole
from attestry.sources.scratch import materialize


def claims_in(texts: DataFrame) -> DataFrame:
    """``text_id, pos, claim_id, shi_prefix, css_selector, claim_text``, one row for each marker of ``text_id, text``."""
    found = texts.where(F.contains("text", F.lit("[C"))).select(
        "text_id", "text", F.posexplode(parse_claim_markers(F.col("text"))).alias("pos", "m")
    )
    return found.select(
        "text_id", "pos", F.col("m.claim_id").alias("claim_id"), F.col("m.shi_prefix").alias("shi_prefix"),
        F.col("m.css_selector").alias("css_selector"), claim_text(F.col("text"), F.col("m.claim_id")).alias("claim_text"),
    )


def relations_in(texts: DataFrame) -> DataFrame:
    """``text_id, pos, rel_id, rel_type, claim_ids``, one row for each relationship marker."""
    found = texts.where(F.contains("text", F.lit("(R"))).select(
        "text_id", F.posexplode(parse_relation_markers(F.col("text"))).alias("pos", "m")
    )
    return found.select("text_id", "pos", "m.rel_id", "m.rel_type", "m.claim_ids")


def verify_claims(texts: DataFrame, sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every claim marker with its verdict.

    ``text_id, pos, claim_id ("C<n>"), source_url, claim_text, shi_valid,
    match_method, verified, reason``. A claim is verified if a source carries its
    fingerprint, the snapshot of that source still has it, and the claim occurs
    anywhere in the snapshot (``exact`` or ``fuzzy``). The snapshot of a source is
    all its chunks, whichever of them the selector names; where chunks name no
    source, those of one fingerprint are one. Missing sources, and selectors of
    unverified claims that name no passage, give a reason; claims of a text never
    overwrite those of another.
    """
    known = sources.where("shi_prefix IS NOT NULL").groupBy("shi_prefix").agg(F.min("url").alias("source_url"))
    by_source = "source_id" in chunks.columns
    known = known.withColumn("key", url_hash(F.col("source_url")) if by_source else F.col("shi_prefix"))
    in_selector = F.regexp_extract(F.coalesce("css_selector", F.lit("")), "([0-9]+)$", 1).try_cast("bigint")
    at = F.coalesce(F.col("chunk_index").cast("bigint"), in_selector) if "chunk_index" in chunks.columns else in_selector
    stored = chunks.select(F.col("source_id" if by_source else "shi_prefix").alias("key"), F.coalesce(at, F.lit(-1)).alias("at"), "text", "css_selector", "shi_prefix")
    passages = stored.where("key IS NOT NULL AND text IS NOT NULL").select("key", "at", "text")
    snapshots = stored.where("key IS NOT NULL").groupBy("key").agg(F.min("shi_prefix").alias("least"), F.max("shi_prefix").alias("most"))
    named = stored.where("css_selector IS NOT NULL AND text IS NOT NULL").select("css_selector", F.lit(True).alias("named")).distinct()

    found = materialize(claims_in(texts).join(known, "shi_prefix", "left").withColumn("id", F.md5("claim_text")), "claims")
    methods = whole.methods(found.select("key", F.col("claim_text").alias("claim")), passages)
    rows = found.join(methods, ["key", "id"], "left").join(snapshots, "key", "left").join(named, "css_selector", "left")
    valid = F.coalesce((F.col("least") == F.col("shi_prefix")) & (F.col("most") == F.col("shi_prefix")), F.lit(False))
    verified = F.col("source_url").isNotNull() & valid & F.col("method").isNotNull()
    reason = F.when(F.col("source_url").isNull(), "source not found").when(~verified & F.col("named").isNull(), "passage not found")
    return rows.select(
        "text_id", "pos", F.concat(F.lit("C"), F.col("claim_id").cast("string")).alias("claim_id"), "source_url", "claim_text",
        valid.alias("shi_valid"), F.when(F.col("source_url").isNotNull(), F.coalesce("method", F.lit("none"))).alias("match_method"),
        verified.alias("verified"), reason.alias("reason"),
    )


def verify_pages(texts: DataFrame, sources: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Every claim marker judged by the page of its source as fetched now.

    The columns of ``verify_claims``. ``snapshot`` has ``url, text``; of an address
    fetched several times the least text counts. A claim is verified if a source
    carries its fingerprint, the fingerprint computed from that source's page is
    still the same, and the claim occurs in the page's whole text. Only pages of
    named sources are read on; a page meets its claims in one row each, and is never
    gathered with others.
    """
    known = sources.where("shi_prefix IS NOT NULL").groupBy("shi_prefix").agg(F.min("url").alias("source_url"))
    found = claims_in(texts).join(known, "shi_prefix", "left")
    wanted = found.select(F.col("source_url").alias("url")).where("url IS NOT NULL").distinct()
    pages = snapshot.where("url IS NOT NULL AND text <> ''").join(wanted, "url", "left_semi").groupBy("url").agg(F.min("text").alias("page"))
    rows = found.join(pages.select(F.col("url").alias("source_url"), "page", fingerprint(F.col("page")).alias("now")), "source_url", "left")
    valid = F.coalesce(F.col("now") == F.col("shi_prefix"), F.lit(False))
    method = F.when(F.col("page").isNotNull(), match_method(F.col("claim_text"), F.col("page")))
    judged = rows.select("text_id", "pos", "claim_id", "source_url", "claim_text", valid.alias("shi_valid"), method.alias("match_method"), F.col("page").isNull().alias("gone"))
    reason = F.when(F.col("source_url").isNull(), "source not found").when(F.col("gone"), "page not fetched")
    return judged.select(
        "text_id", "pos", F.concat(F.lit("C"), F.col("claim_id").cast("string")).alias("claim_id"), "source_url", "claim_text", "shi_valid",
        "match_method", (F.col("shi_valid") & F.coalesce(F.col("match_method") != "none", F.lit(False))).alias("verified"), reason.alias("reason"),
    )


def verdicts(verified: DataFrame) -> DataFrame:
    """``text_id, total, passed, failed, verified`` of each text with claims."""
    passed = F.count_if("verified")
    return verified.groupBy("text_id").agg(
        F.count("*").alias("total"), passed.alias("passed"), (F.count("*") - passed).alias("failed"),
        F.bool_and("verified").alias("verified"),
    )


def registry(texts: DataFrame) -> DataFrame:
    """The audit record of each text with markers: ``text_id, protocol, ssr_entries, rar_entries``."""
    ssr = F.transform(
        parse_claim_markers(F.col("text")),
        lambda m: F.struct(
            F.concat(F.lit("C"), m["claim_id"].cast("string")).alias("claim_id"), m["shi_prefix"].alias("shi_prefix"),
            F.lit("").alias("source_url"), m["css_selector"].alias("css_selector"), F.lit("").alias("claim_text"),
            F.lit(False).alias("verified"),
        ),
    )
    rar = F.transform(
        parse_relation_markers(F.col("text")),
        lambda m: F.struct(
            F.concat(F.lit("R"), m["rel_id"].cast("string")).alias("relationship_id"), m["rel_type"].alias("type"),
            m["claim_ids"].alias("claim_ids"), F.lit("").alias("synthesis_text"),
        ),
    )
    return texts.select("text_id", F.lit(fixed.PROTOCOL).alias("protocol"), ssr.alias("ssr_entries"), rar.alias("rar_entries")).where(
        "size(ssr_entries) > 0 OR size(rar_entries) > 0"
    )


def registry_json(records: DataFrame) -> DataFrame:
    """Records as JSON text, and back: ``json`` and ``same`` (whether the round trip keeps the record)."""
    fields = [c for c in ("protocol", "ssr_entries", "rar_entries") if c in records.columns]
    schema = records.select(F.struct(*fields).alias("r")).schema["r"].dataType
    whole = F.struct(*fields)
    return records.withColumn("json", F.to_json(whole, {"ignoreNullFields": "false"})).withColumn(
        "same", F.to_json(F.from_json("json", schema), {"ignoreNullFields": "false"}) == F.col("json")
    )


def recent(records: DataFrame, limit: int = 10) -> DataFrame:
    """The latest records; ties by their JSON text."""
    return records.orderBy(F.desc("generated_at"), F.to_json(F.struct("ssr_entries"))).limit(limit)
