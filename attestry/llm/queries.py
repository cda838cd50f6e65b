"""The registered queries of the corpus problems, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm import boilerplate, bpe, lines, mixing, near_duplicates, residue, sentences, spans
from attestry.sources.tables import read


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "chunks").select(F.col("chunk_id").alias("id"), "text")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = near_duplicates.similar_pairs(_texts(spark, folder))
    return pairs.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p1_classes(spark: SparkSession, folder: str) -> DataFrame:
    classes = near_duplicates.similar_classes(_texts(spark, folder))
    return classes.select(F.col("id").alias("chunk_id"), "class_id", "n_links")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.sentence_units(read(spark, folder, "chunks"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue_records(read(spark, folder, "chunks"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return boilerplate.page_elements(read(spark, folder, "chunks"))


def p4_content(spark: SparkSession, folder: str) -> DataFrame:
    return boilerplate.main_content(read(spark, folder, "chunks"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return lines.repeated_line_elements(read(spark, folder, "chunks"))


def p5_clean(spark: SparkSession, folder: str) -> DataFrame:
    return lines.remove_repeated_lines(read(spark, folder, "chunks"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.token_ids(read(spark, folder, "documents"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_documents(read(spark, folder, "documents"), read(spark, folder, "mix_targets"))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture_shares(read(spark, folder, "documents"), read(spark, folder, "mix_targets"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shared_spans(read(spark, folder, "documents"))


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shared_report(read(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_classes, p2_found, p3_found, p4_found, p4_content, p5_found, p5_clean, p6_ids, p7_mix, p7_shares, p8_found, p8_report,
    )
}

_P5_SQL = """
WITH once AS (
    SELECT chunk_id, any_value(source_id) AS source_id, any_value(sentences) AS sentences
    FROM chunks WHERE chunk_id IS NOT NULL AND source_id IS NOT NULL GROUP BY chunk_id
), lines AS (
    SELECT chunk_id, source_id, unnest(sentences) AS line,
           unnest(range(len(sentences))) AS sentence_no
    FROM once
), keyed AS (
    SELECT chunk_id, source_id, sentence_no,
           trim(regexp_replace(regexp_replace(lower(line), '[ \\t\\x{00A0}]+', ' ', 'g'), '[0-9]+', '0', 'g'), ' ') AS k
    FROM lines WHERE line IS NOT NULL
), sizes AS (SELECT source_id, count(*) AS n FROM once GROUP BY source_id
), hits AS (
    SELECT source_id, k FROM keyed JOIN sizes USING (source_id)
    GROUP BY source_id, k, n
    HAVING count(DISTINCT chunk_id) >= 8 AND count(DISTINCT chunk_id) * 100 >= 5 * n
)
"""

# pairs by a prefix filter: texts at the threshold share one of their rarest substrings
_P1_SQL = """
WITH texts AS (
    SELECT DISTINCT ON (chunk_id) chunk_id AS id, text FROM chunks WHERE chunk_id IS NOT NULL AND length(text) >= 250
), reps AS (SELECT min(id) AS id, text FROM texts GROUP BY text
), grams AS (SELECT id, list_distinct(list_transform(range(1, length(text) - 3), lambda i: substr(text, i, 5))) AS gs FROM reps
), flat AS (SELECT id, unnest(gs) AS g, len(gs) AS n FROM grams
), often AS (SELECT g, row_number() OVER (ORDER BY count(*), g) AS rare FROM flat GROUP BY g
), coded AS (SELECT id, n, rare, row_number() OVER (PARTITION BY id ORDER BY rare) AS place FROM flat JOIN often USING (g)
), prefix AS (SELECT id, rare, n FROM coded WHERE place <= n - CAST(ceil(0.7 * n) AS BIGINT) + 1
), near AS (SELECT DISTINCT a.id AS a, b.id AS b FROM prefix a JOIN prefix b ON a.rare = b.rare AND a.id < b.id AND a.n >= 0.7 * b.n AND b.n >= 0.7 * a.n
), common AS (SELECT a, b, count(*) AS c FROM near JOIN coded x ON x.id = a JOIN coded y ON y.id = b AND y.rare = x.rare GROUP BY a, b
), pairs AS (
    SELECT a, b FROM common JOIN grams x ON x.id = a JOIN grams y ON y.id = b WHERE c * 10 >= 7 * (len(x.gs) + len(y.gs) - c)
), members AS (SELECT r.id AS rep, t.id FROM reps r JOIN texts t USING (text))
"""

_P8_SQL = """
WITH docs AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 200
), places AS (SELECT doc_id, text, unnest(range(0, length(text) - 199)) AS p FROM docs
), stretches AS (SELECT doc_id, p, md5_number(substr(text, p + 1, 200)) AS h FROM places
), common AS (SELECT h FROM stretches GROUP BY h HAVING min(doc_id) <> max(doc_id)
), hits AS (SELECT DISTINCT doc_id, p FROM stretches WHERE h IN (SELECT h FROM common)
), runs AS (SELECT doc_id, p, sum(CASE WHEN p <= before + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run
            FROM (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM hits)
), spans AS (SELECT doc_id, CAST(min(p) AS INTEGER) AS start_pos, CAST(max(p) + 200 AS INTEGER) AS end_pos FROM runs GROUP BY doc_id, run)
"""

ORACLE_SQL: dict[str, str] = {
    "p1_found": _P1_SQL
    + """SELECT least(x.id, y.id) AS chunk_id_a, greatest(x.id, y.id) AS chunk_id_b FROM pairs JOIN members x ON x.rep = a JOIN members y ON y.rep = b
         UNION ALL SELECT x.id, y.id FROM members x JOIN members y ON x.rep = y.rep AND x.id < y.id""",
    "p1_classes": _P1_SQL
    + """, links AS (SELECT rep, count(*) AS n FROM (SELECT a AS rep FROM pairs UNION ALL SELECT b FROM pairs) GROUP BY rep)
         SELECT c.id AS chunk_id, coalesce(m.rep, c.id) AS class_id, coalesce(n, 0) AS n_links
         FROM (SELECT DISTINCT chunk_id AS id FROM chunks WHERE chunk_id IS NOT NULL) c LEFT JOIN members m USING (id)
              LEFT JOIN links l ON l.rep = coalesce(m.rep, c.id)""",
    "p5_clean": _P5_SQL
    + """, gone AS (SELECT chunk_id, list(sentence_no) AS nos FROM keyed JOIN hits USING (source_id, k) GROUP BY chunk_id
         ), left_over AS (
            SELECT c.chunk_id, c.sentences AS had, c.text, g.nos,
                   list_transform(list_filter(range(len(c.sentences)), lambda i: NOT list_contains(g.nos, i)), lambda i: c.sentences[i + 1]) AS kept
            FROM (SELECT DISTINCT ON (chunk_id) * FROM chunks) c LEFT JOIN gone g USING (chunk_id))
         SELECT chunk_id, CASE WHEN nos IS NULL THEN had ELSE kept END AS sentences,
                CASE WHEN nos IS NULL THEN text ELSE coalesce(array_to_string(kept, ' '), '') END AS text FROM left_over""",
    "p8_found": _P8_SQL + "SELECT doc_id, start_pos, end_pos FROM spans",
    "p8_report": _P8_SQL
    + """, sizes AS (SELECT doc_id, coalesce(max(length(text)), 0) AS n_chars FROM documents GROUP BY doc_id),
         sums AS (SELECT doc_id, sum(end_pos - start_pos) AS n FROM spans GROUP BY doc_id)
         SELECT s.doc_id, CAST(n_chars AS INTEGER) AS n_chars, CAST(coalesce(n, 0) AS BIGINT) AS shared_chars,
                CASE WHEN n_chars > 0 THEN CAST(coalesce(n, 0) AS DOUBLE) / n_chars ELSE 0.0 END AS shared_part
         FROM sizes s LEFT JOIN sums USING (doc_id)""",
    "p5_found": _P5_SQL
    + "SELECT chunk_id, CAST(sentence_no AS INTEGER) AS sentence_no FROM keyed JOIN hits USING (source_id, k)",
}
