"""The registered queries of the core."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions import html, markers, match, text, urls
from attestry.functions.embed import hashed_vector
from attestry.functions.fixed import WS
from attestry.operators import catalog, crawl, index, search, verify
from attestry.plans import api
from attestry.plans.oracle import ORACLE_SQL
from attestry.plans.rendering import rendered
from attestry.sources.scratch import materialize
from attestry.sources.tables import read

__all__ = ["ORACLE_SQL", "QUERIES"]

KEYWORD = "harbour"
EMBEDDED = "the crew of the harbour lifted the old crane"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    """Grounded texts by the id that claims refer to."""
    docs = read(spark, folder, "documents").where("doc_id IS NOT NULL")
    return docs.select(F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("text_id"), "text")


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return rendered(read(spark, folder, "documents"))


@query
def fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("text")
    return read(spark, folder, "documents").select(
        "doc_id", text.fingerprint(t).alias("fingerprint"), text.full_fingerprint(t).alias("full_fingerprint"),
        text.fingerprint_matches(t, F.col("shi_prefix")).alias("matches"),
    )


@query
def duplicate_content(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", text.fingerprint(F.col("text")).alias("fingerprint"))
    groups = docs.where("fingerprint IS NOT NULL").groupBy("fingerprint").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))
    return groups.where("n_docs > 1")


@query
def url_identity(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "chunks").where("url IS NOT NULL").select("url", "source_id").distinct()
    own = text.url_hash(F.col("url"))
    return rows.select("url", own.alias("url_hash"), (own == F.col("source_id")).alias("is_source"))


@query
def chunk_selectors(spark: SparkSession, folder: str) -> DataFrame:
    rows = catalog.once(read(spark, folder, "chunks"), ["chunk_id"]).where("url IS NOT NULL")
    own = text.chunk_selector(F.col("url"), F.col("chunk_index"))
    return rows.select("chunk_id", own.alias("selector"), (own == F.col("css_selector")).alias("same"))


@query
def sentence_split(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", F.posexplode(text.split_sentences(F.col("text"))).alias("pos", "sentence"))
    return docs


@query
def chunk_documents(spark: SparkSession, folder: str) -> DataFrame:
    groups = text.group_chunks(text.split_sentences(F.col("text")), 8)
    rows = read(spark, folder, "documents").select("doc_id", F.posexplode(groups).alias("chunk_index", "sentences"))
    return rows.select("doc_id", "chunk_index", F.size("sentences").alias("n_sentences"), F.array_join("sentences", " ").alias("text"))


@query
def index_pages(spark: SparkSession, folder: str) -> DataFrame:
    rows = index.indexed(index.extracted(_pages(spark, folder)))
    return index.source_rows(rows)


@query
def index_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return index.summary(index.chunk_rows(index.indexed(index.extracted(_pages(spark, folder)))))


@query
def index_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("url", F.concat(F.lit("<p>"), F.col("text"), F.lit("</p>")).alias("html"))
    return index.quarantine(docs)


@query
def script_pages(spark: SparkSession, folder: str) -> DataFrame:
    return _pages(spark, folder).select("doc_id", html.needs_scripts(F.col("html")).alias("needs_scripts"))


@query
def page_tables(spark: SparkSession, folder: str) -> DataFrame:
    return _pages(spark, folder).select("doc_id", F.posexplode(html.tables(F.col("html"))).alias("pos", "table_text"))


@query
def page_links(spark: SparkSession, folder: str) -> DataFrame:
    return crawl.page_links(_pages(spark, folder), external=True)


@query
def crawl_pages(spark: SparkSession, folder: str) -> DataFrame:
    snapshot = _pages(spark, folder)
    links = materialize(crawl.page_links(snapshot, external=True), "links")
    start = snapshot.agg(F.min_by("url", "doc_id")).first()[0]
    return crawl.crawl(links, start or "", max_depth=5, max_urls=50)


@query
def same_domain(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "documents").where("url IS NOT NULL AND source IS NOT NULL").select("doc_id", "url", "source")
    other = F.concat(F.lit("http://WWW."), F.col("source"), F.lit(".example:8080/x"))
    return rows.select("doc_id", urls.host(F.col("url")).alias("host"), urls.same_domain(F.col("url"), other).alias("same"))


@query
def keyword_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.keyword_search(read(spark, folder, "chunks"), KEYWORD, 20)


@query
def keyword_counts(spark: SparkSession, folder: str) -> DataFrame:
    """All hits of the keyword by source, not only the best."""
    rows = catalog.once(read(spark, folder, "chunks"), ["chunk_id"]).withColumn("score", search.keyword_score(KEYWORD))
    return rows.groupBy("source_id").agg(F.count_if(F.col("score") > 0).alias("n_chunks"), F.sum("score").alias("n_sentences"))


@query
def check_indexed(spark: SparkSession, folder: str) -> DataFrame:
    return search.check_indexed(read(spark, folder, "chunks"), read(spark, folder, "sources"), KEYWORD)


@query
def check_hits(spark: SparkSession, folder: str) -> DataFrame:
    return search.check_hits(read(spark, folder, "chunks"), KEYWORD)


@query
def search_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors first: chunks with the built-in vector of their text; a limit beyond the most allowed is held there."""
    return search.search(_embedded(spark, folder), EMBEDDED, limit=99, min_score=0.3, embed=hashed_vector)


@query
def search_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """No vector is near enough, so keywords are looked for."""
    return search.search(_embedded(spark, folder), KEYWORD, limit=5, min_score=0.999, embed=hashed_vector)


@query
def check_embedded(spark: SparkSession, folder: str) -> DataFrame:
    """Confidence of a query by the hits of its vector."""
    chunks = _embedded(spark, folder)
    hits = search.search(chunks, EMBEDDED, limit=5, min_score=0.3, embed=hashed_vector)
    return search.check_indexed(chunks, read(spark, folder, "sources"), EMBEDDED, hits=hits)


def _embedded(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "chunks").withColumn("embedding", F.explode(F.array(hashed_vector(F.col("text")))))


@query
def text_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The built-in vectors of all documents, to 4 places."""
    rows = read(spark, folder, "documents").select("doc_id", F.posexplode(hashed_vector(F.col("text"))).alias("place", "x"))
    return rows.where("x <> 0").select("doc_id", "place", F.round(F.col("x").cast("double"), 4).alias("x"))


@query
def source_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks of the first source in their order."""
    rows = catalog.once(read(spark, folder, "chunks"), ["source_id", "chunk_index"])
    first = rows.agg(F.min("source_id")).scalar()
    return catalog.listed(rows, "source_id", first, "chunk_index").select("source_id", "chunk_index", "css_selector", "text")


@query
def text_claims(spark: SparkSession, folder: str) -> DataFrame:
    """The claims of the first text by id as text."""
    rows = catalog.latest(read(spark, folder, "claims"), ["text_id", "claim_id"], "created_at")
    return catalog.listed(rows, "text_id", rows.agg(F.min("text_id")).scalar(), "claim_id").select("text_id", "claim_id", "claim_text", "verified")


@query
def text_relationships(spark: SparkSession, folder: str) -> DataFrame:
    """The relationships of the first text that has some, by id as text."""
    rows = catalog.latest(read(spark, folder, "relationships"), ["text_id", "rel_id"], "created_at")
    found = catalog.listed(rows, "text_id", rows.agg(F.min("text_id")).scalar(), "rel_id")
    return found.select("text_id", "rel_id", "rel_type", F.array_join("claim_ids", ",").alias("claim_ids"))


@query
def source_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """One stored source by its key."""
    rows = catalog.latest(read(spark, folder, "sources"), ["url_hash"], "indexed_at")
    return catalog.lookup(rows, "url_hash", rows.agg(F.max("url_hash")).scalar())


@query
def relation_records(spark: SparkSession, folder: str) -> DataFrame:
    """Audit records of relationships, with their markers made again."""
    rows = verify.registry(_texts(spark, folder)).select("text_id", F.posexplode("rar_entries").alias("pos", "e"))
    number = F.substring("e.relationship_id", 2, 20).cast("bigint")
    return rows.select(
        "text_id", "pos", F.col("e.relationship_id").alias("relationship_id"), F.col("e.type").alias("type"), F.array_join("e.claim_ids", ",").alias("claim_ids"),
        F.col("e.synthesis_text").alias("synthesis_text"), markers.relation_marker(number, F.col("e.type"), F.col("e.claim_ids")).alias("marker"),
    )


@query
def chunk_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks by a size of 1, which is held at 5."""
    texts = read(spark, folder, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("string").alias("url"), "text")
    rows = index.indexed(texts, 1).select("url", F.explode("groups").alias("g"))
    return rows.groupBy(F.col("url").cast("bigint").alias("doc_id")).agg(F.count("*").alias("n_chunks"), F.sum(F.size("g")).alias("n_sentences"))


@query
def page_links_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """Links of the own site only that match one pattern and not another."""
    return crawl.page_links(_pages(spark, folder), include="/(?:up|plain)", exclude="[05]$")


@query
def crawl_totals(spark: SparkSession, folder: str) -> DataFrame:
    """A crawl that indexes what it finds, summed up."""
    snapshot = _pages(spark, folder).select("url", "html")
    start = snapshot.agg(F.min("url")).first()[0]
    store = api.Store(read(spark, folder, "sources"), read(spark, folder, "chunks"))
    return api.crawl_and_index(store, snapshot, start or "", max_depth=3, max_urls=30, external=True)[1]


@query
def neighbour_expand(spark: SparkSession, folder: str) -> DataFrame:
    return search.neighbours(read(spark, folder, "chunks"))


@query
def vector_search(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return search.nearest(rows, rows.where("id % 50 = 0"), 10)


@query
def chunk_vectors(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "chunks").where("embedding IS NOT NULL").select(F.col("chunk_id").alias("id"), "embedding")
    return search.nearest(rows, rows.where("id % 50 = 0"), 5, 0.7)


@query
def cosine_pairs(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "embeddings")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(after, "vec_id").select("vec_id", F.round(match.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query
def claim_markers(spark: SparkSession, folder: str) -> DataFrame:
    return verify.claims_in(_texts(spark, folder))


@query
def relation_markers(spark: SparkSession, folder: str) -> DataFrame:
    found = verify.relations_in(_texts(spark, folder))
    return found.select("text_id", "pos", "rel_id", "rel_type", F.array_join("claim_ids", ",").alias("claim_ids"))


@query
def marker_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Markers made again from what was parsed."""
    rows = _texts(spark, folder).select(
        "text_id", F.posexplode(markers.parse_claim_markers(F.col("text"))).alias("pos", "m")
    )
    made = markers.claim_marker(F.col("m.claim_id"), F.col("m.shi_prefix"), F.col("m.css_selector"))
    return rows.select("text_id", "pos", made.alias("made"), (made == F.col("m.marker")).alias("same"))


@query
def grounded_text(spark: SparkSession, folder: str) -> DataFrame:
    claims = catalog.latest(read(spark, folder, "claims"), ["text_id", "claim_id"], "created_at").where("claim_text IS NOT NULL")
    rels = catalog.latest(read(spark, folder, "relationships"), ["text_id", "rel_id"], "created_at")
    first = rels.groupBy("text_id").agg(F.min(F.struct("rel_id", "rel_type", "claim_ids", "synthesis_text")).alias("r"))
    rows = claims.join(first, "text_id", "left")
    made = markers.grounded_text(
        F.col("claim_text"), F.col("shi_prefix"), F.col("css_selector"), F.col("r.rel_type"), F.col("r.claim_ids"), F.col("r.synthesis_text")
    )
    return rows.select("text_id", "claim_id", made.alias("grounded"))


def _verified(spark: SparkSession, folder: str) -> DataFrame:
    return verify.verify_claims(_texts(spark, folder), read(spark, folder, "sources"), read(spark, folder, "chunks"))


@query
def verify_claims(spark: SparkSession, folder: str) -> DataFrame:
    return _verified(spark, folder)


@query
def verify_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Claims about documents, some changed or unknown by now, against the documents as pages.

    Each document is claimed by its opening, by the same words turned round, or by
    other words; some markers carry the fingerprint of another text.
    """
    docs = read(spark, folder, "documents").where("doc_id IS NOT NULL AND url IS NOT NULL AND text <> ''").dropDuplicates(["doc_id"])
    i, own = F.col("doc_id"), text.fingerprint(F.col("text"))
    head = text.strip(F.substring(F.translate("text", "[]", "  "), 1, 160))
    turned = F.array_join(F.reverse(F.split(head, f"{WS}+")), " ")
    said = F.when(i % 3 == 0, turned).when(i % 3 == 1, "quite something else").otherwise(head)
    made = docs.select("doc_id", "url", F.when(i % 7 == 0, text.fingerprint(own)).otherwise(own).alias("shi_prefix"), said.alias("said"))
    marker = markers.claim_marker(F.lit(1), F.col("shi_prefix"), F.lit("#top"))
    texts = made.select(F.concat(F.lit("d"), i.cast("string")).alias("text_id"), F.concat("said", F.lit(" "), marker).alias("text"))
    first = docs.groupBy("url").agg(F.min_by("text", "doc_id").alias("text"))
    return verify.verify_pages(texts, made.where("doc_id % 7 <> 1"), first)


@query
def verify_summary(spark: SparkSession, folder: str) -> DataFrame:
    return verify.verdicts(_verified(spark, folder))


@query
def token_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """How stored claims match the passages their selectors name."""
    claims = catalog.latest(read(spark, folder, "claims"), ["text_id", "claim_id"], "created_at")
    passages = catalog.once(read(spark, folder, "chunks"), ["chunk_id"]).groupBy("css_selector").agg(F.max("text").alias("passage"))
    rows = claims.where("claim_text IS NOT NULL").join(passages, "css_selector")
    own, theirs = match.tokens(F.col("claim_text")), match.tokens(F.col("passage"))
    return rows.select(
        "text_id", "claim_id", F.size(own).alias("n_tokens"), F.size(F.array_intersect(own, theirs)).alias("n_common"),
        match.match_method(F.col("claim_text"), F.col("passage")).alias("method"),
    )


@query
def audit_registry(spark: SparkSession, folder: str) -> DataFrame:
    rows = verify.registry(_texts(spark, folder))
    return rows.select("text_id", "protocol", F.size("ssr_entries").alias("n_claims"), F.size("rar_entries").alias("n_relations"),
                       F.array_join(F.transform("ssr_entries", lambda e: e["claim_id"]), ",").alias("claim_ids"))


@query
def registry_recent(spark: SparkSession, folder: str) -> DataFrame:
    rows = verify.recent(read(spark, folder, "registry"))
    return rows.select("protocol", "generated_at", F.size("ssr_entries").alias("n_ssr"), F.coalesce(F.when(F.col("rar_entries").isNotNull(), F.size("rar_entries")), F.lit(0)).alias("n_rar"))


@query
def registry_claims(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "registry").select(F.explode("ssr_entries").alias("e"))
    return rows.groupBy(F.col("e.source_url").alias("source_url")).agg(F.count("*").alias("n_claims"), F.count_if("e.verified").alias("n_verified"))


@query
def registry_json(spark: SparkSession, folder: str) -> DataFrame:
    return verify.registry_json(read(spark, folder, "registry")).select("generated_at", "json", "same")


@query
def latest_sources(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.latest(read(spark, folder, "sources"), ["url_hash"], "indexed_at")


@query
def list_sources(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.list_sources(read(spark, folder, "sources"))


@query
def count_sources(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.count_sources(read(spark, folder, "sources"))


@query
def source_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.conflicts(read(spark, folder, "sources"))


@query
def latest_claims(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.latest(read(spark, folder, "claims"), ["text_id", "claim_id"], "created_at")


@query
def global_claims(spark: SparkSession, folder: str) -> DataFrame:
    """Claims under ids that texts share: the last one written wins."""
    rows = catalog.latest(read(spark, folder, "claims"), ["claim_id"], "created_at")
    return rows.select("claim_id", "text_id", "verified", "created_at")


@query
def latest_relationships(spark: SparkSession, folder: str) -> DataFrame:
    rows = catalog.latest(read(spark, folder, "relationships"), ["text_id", "rel_id"], "created_at")
    return rows.withColumn("claim_ids", F.array_join("claim_ids", ","))


@query
def relationship_claims(spark: SparkSession, folder: str) -> DataFrame:
    rels = catalog.latest(read(spark, folder, "relationships"), ["text_id", "rel_id"], "created_at")
    claims = catalog.latest(read(spark, folder, "claims"), ["text_id", "claim_id"], "created_at")
    named = rels.select("text_id", "rel_id", F.explode(F.array_distinct("claim_ids")).alias("claim_id"))
    return named.join(claims.select("text_id", "claim_id", "verified", F.lit(True).alias("found")), ["text_id", "claim_id"], "left").select(
        "text_id", "rel_id", "claim_id", F.coalesce("found", F.lit(False)).alias("found"), "verified"
    )


@query
def delete_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks left when the sources not indexed since March 2030 are deleted."""
    sources = read(spark, folder, "sources")
    old = catalog.latest(sources, ["url_hash"], "indexed_at").where("indexed_at < TIMESTAMP '2030-03-01 00:00:00'")
    left = catalog.delete_sources(sources, catalog.once(read(spark, folder, "chunks"), ["chunk_id"]), old)[1]
    return left.groupBy("source_id").agg(F.count("*").alias("n_chunks"))


@query
def orphan_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Sources of chunks, and whether a source row is stored for them."""
    chunks = read(spark, folder, "chunks").groupBy("source_id").agg(F.countDistinct("chunk_id").alias("n_chunks"))
    known = read(spark, folder, "sources").select(F.col("url_hash").alias("source_id"), F.lit(True).alias("known")).distinct()
    return chunks.join(known, "source_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))


@query
def collection_counts(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.counts({n: read(spark, folder, n) for n in ("sources", "chunks", "claims", "relationships", "registry")})
