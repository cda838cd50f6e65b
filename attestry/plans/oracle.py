"""DuckDB SQL twins of the core queries."""

from __future__ import annotations

from attestry.functions import fixed
from attestry.functions.fixed import WS

_CUT = "chr(57344)"  # a private character that parts a split text


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def _split_after_mark(x: str, following: str) -> str:
    """Pieces of a text cut at the white space behind a terminal mark."""
    return f"string_split(regexp_replace({x}, '([.!?]){WS}+{following}', '\\1' || {_CUT}{(' || ' + chr(39) + chr(92) + '2' + chr(39)) if following else ''}, 'g'), {_CUT})"


def _guarded(x: str) -> str:
    for a in fixed.ABBREVIATIONS:
        x = f"replace({x}, '{a}', '{a.replace('.', fixed.DOT)}')"
    return x


def _tokens(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), '[a-z0-9$]+'))"


def _sentences(table: str = "documents") -> str:
    """CTEs that end in ``sent(doc_id, pos, sentence)``."""
    restored = _strip(f"replace(x, '{fixed.DOT}', '.')")
    pieces = _split_after_mark(_guarded("p"), "([A-Z\"''(])")
    return f"""
    paras AS (
        SELECT doc_id, pno, {_strip('raw')} AS p FROM (
            SELECT doc_id, unnest(string_split_regex(text, '\\n\\n+')) AS raw,
                   unnest(range(len(string_split_regex(text, '\\n\\n+')))) AS pno
            FROM {table} WHERE text IS NOT NULL)
    ), parts AS (
        SELECT doc_id, pno,
               CASE WHEN length(p) - length(replace(p, '|', '')) >= 2 OR regexp_matches(p, '^[-*•·]{WS}')
                         OR regexp_matches(p, '^\\p{{Nd}}+[.)]{WS}') THEN [p]
                    ELSE list_transform({pieces}, lambda x: {restored}) END AS ss
        FROM paras WHERE p <> ''
    ), flat AS (
        SELECT doc_id, pno, unnest(ss) AS sentence, unnest(range(len(ss))) AS sno FROM parts
    ), sent AS (
        SELECT doc_id, sentence, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pno, sno) - 1 AS INTEGER) AS pos
        FROM flat WHERE sentence <> ''
    )"""


def _latest(table: str, keys: list[str], fields: list[str], version: str, lists: tuple[str, ...] = ()) -> str:
    """Field-wise merge of a change log; rows of one version go by the MD5 of their values."""
    row = " || chr(31) || ".join(
        f"coalesce({f'array_to_string({f}, chr(44))' if f in lists else f'CAST({f} AS VARCHAR)'}, '')" for f in fields if f != version
    )
    values = ", ".join(f"last({f} ORDER BY place, row_text) FILTER (WHERE {f} IS NOT NULL) AS {f}" for f in fields)
    some = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    return f"""SELECT {', '.join(keys)}, {values} FROM (
        SELECT *, coalesce({version}, TIMESTAMPTZ '0001-01-01 00:00:00+00') AS place, md5({row}) AS row_text FROM {table}) WHERE {some}
        GROUP BY {', '.join(keys)}"""


_SOURCES = _latest("sources", ["url_hash"], ["url", "shi_prefix", "total_chunks", "full_text_length", "indexed_at"], "indexed_at")
_CLAIM_FIELDS = ["shi_prefix", "source_url", "css_selector", "claim_text", "verified", "match_method", "reason", "created_at"]
_CLAIMS = _latest("claims", ["text_id", "claim_id"], _CLAIM_FIELDS, "created_at")
_RELS = _latest("relationships", ["text_id", "rel_id"], ["rel_type", "claim_ids", "synthesis_text", "created_at"], "created_at", ("claim_ids",))
_CHUNKS = "SELECT DISTINCT ON (chunk_id) * FROM chunks WHERE chunk_id IS NOT NULL"
_KEYWORD = "harbour"
_SCORE = f"coalesce(len(list_filter(sentences, lambda s: contains(lower(s), '{_KEYWORD}'))), 0)"
_SEARCH = f"""
    SELECT source_id, chunk_index, coalesce(url, '') AS url, text, CAST({_SCORE} AS INTEGER) AS score
    FROM (SELECT DISTINCT ON (source_id, chunk_index) * FROM chunks)
    WHERE coalesce(contains(lower(text), '{_KEYWORD}'), false) OR {_SCORE} > 0
    ORDER BY score DESC, source_id, chunk_index"""

_C = fixed.CLAIM_MARKER
_R = fixed.RELATION_MARKER
_MARKS = f"""
    marks AS (
        SELECT 't' || doc_id AS text_id, text, unnest(regexp_extract_all(text, '{_C}', 0)) AS marker,
               unnest(regexp_extract_all(text, '{_C}', 1)) AS n, unnest(regexp_extract_all(text, '{_C}', 2)) AS shi_prefix,
               unnest(regexp_extract_all(text, '{_C}', 3)) AS css_selector,
               unnest(range(len(regexp_extract_all(text, '{_C}', 0)))) AS i
        FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
    ), placed AS (
        SELECT *, TRY_CAST(n AS BIGINT) AS id, strpos(text, '[C' || TRY_CAST(n AS BIGINT) || ':') AS spot FROM marks
    ), found AS (
        SELECT text_id, CAST(i AS INTEGER) AS pos, id AS claim_id, shi_prefix, css_selector, marker,
               CASE WHEN spot > 0 THEN list_extract({_split_after_mark(_strip("substr(text, greatest(spot - 500, 1), spot - greatest(spot - 500, 1))"), "")}, -1) END AS claim_text
        FROM placed
    )"""

_OWN, _THEIRS = _tokens("c"), _tokens("s")
_LINE = _tokens("line")
_METHOD = f"""CASE
    WHEN length(c) > 0 AND coalesce(contains(lower(s), lower(c)), false) THEN 'exact'
    WHEN length(c) > 0 AND s IS NOT NULL AND len({_OWN}) > 0 AND (
        len(list_filter({_OWN}, lambda t: NOT list_contains({_THEIRS}, t))) = 0
        OR len(list_filter(string_split_regex(lower(s), '\\n+'), lambda line:
            CAST(len(list_intersect({_OWN}, {_LINE})) AS DOUBLE) / len(list_distinct(list_concat({_OWN}, {_LINE}))) >= 0.6)) > 0
        OR len(list_filter(regexp_extract_all(c, '\\$?[0-9]+\\.?[0-9]*'), lambda v: contains(s, v))) > 0) THEN 'fuzzy'
    ELSE 'none' END"""

_VERIFY = f"""{_MARKS}, known AS (
        SELECT shi_prefix, min(url) AS source_url, substr(md5(min(url)), 1, 8) AS key FROM sources WHERE shi_prefix IS NOT NULL GROUP BY shi_prefix
    ), asked AS (SELECT DISTINCT key, claim_text AS c FROM found JOIN known USING (shi_prefix) WHERE length(claim_text) > 0
    ), parts AS (
        SELECT DISTINCT source_id AS key, chunk_index AS no, text FROM chunks
        WHERE source_id IN (SELECT key FROM asked) AND text <> ''
    ), whole AS (
        SELECT key, string_agg(low, ' ' ORDER BY no, low) AS low FROM (SELECT DISTINCT key, no, lower(text) AS low FROM parts) GROUP BY key
    ), vocabulary AS (SELECT key, list_distinct(flatten(list(ts))) AS ts FROM (SELECT key, {_tokens("text")} AS ts FROM parts) GROUP BY key
    ), lines AS (
        SELECT DISTINCT key, {_tokens("line")} AS ts FROM (SELECT key, unnest(string_split_regex(lower(text), '\\n+')) AS line FROM parts)
    ), by_line AS (
        SELECT DISTINCT key, c FROM asked JOIN lines USING (key) WHERE len({_tokens("c")}) > 0 AND
            CAST(len(list_intersect({_tokens("c")}, ts)) AS DOUBLE) / len(list_distinct(list_concat({_tokens("c")}, ts))) >= 0.6
    ), by_figure AS (
        SELECT DISTINCT key, c FROM (SELECT key, c, unnest(regexp_extract_all(c, '\\$?[0-9]+\\.?[0-9]*')) AS v FROM asked)
        JOIN parts USING (key) WHERE contains(text, v)
    ), how AS (
        SELECT a.key, a.c, CASE WHEN contains(w.low, lower(a.c)) THEN 'exact'
            WHEN len({_tokens("a.c")}) > 0 AND len(list_filter({_tokens("a.c")}, lambda t: NOT list_contains(v.ts, t))) = 0 THEN 'fuzzy'
            WHEN l.c IS NOT NULL OR f.c IS NOT NULL THEN 'fuzzy' ELSE 'none' END AS method
        FROM asked a LEFT JOIN whole w USING (key) LEFT JOIN vocabulary v USING (key)
             LEFT JOIN by_line l ON l.key = a.key AND l.c = a.c LEFT JOIN by_figure f ON f.key = a.key AND f.c = a.c
    ), snapshots AS (SELECT source_id AS key, list(DISTINCT shi_prefix) FILTER (WHERE shi_prefix IS NOT NULL) AS has FROM chunks GROUP BY source_id
    ), named AS (SELECT DISTINCT css_selector FROM chunks WHERE css_selector IS NOT NULL AND text IS NOT NULL
    ), judged AS (
        SELECT text_id, pos, 'C' || claim_id AS claim_id, source_url, claim_text, coalesce(s.has = [f.shi_prefix], false) AS shi_valid,
               CASE WHEN source_url IS NOT NULL THEN coalesce(h.method, 'none') END AS match_method, n.css_selector IS NOT NULL AS named
        FROM found f LEFT JOIN known k USING (shi_prefix) LEFT JOIN snapshots s ON s.key = k.key
             LEFT JOIN how h ON h.key = k.key AND h.c = f.claim_text LEFT JOIN named n ON n.css_selector = f.css_selector
    ), verified AS (
        SELECT text_id, pos, claim_id, source_url, claim_text, shi_valid, match_method,
               coalesce(shi_valid AND match_method <> 'none', false) AS verified,
               CASE WHEN source_url IS NULL THEN 'source not found'
                    WHEN NOT coalesce(shi_valid AND match_method <> 'none', false) AND NOT named THEN 'passage not found' END AS reason
        FROM judged
    )"""


def _esc(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


_HTML = f"""
    docs AS (
        SELECT DISTINCT ON (doc_id) * FROM documents WHERE url IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL
    ), pages AS (
        SELECT d.doc_id, d.url,
            '<html><head><title>' || d.doc_id || '</title></head><body><nav><a href="/">Home</a> <a href="mailto:desk">Desk</a></nav>'
            || CASE WHEN d.lang IS NULL THEN '<div id="root"></div>' ELSE '' END
            || array_to_string(list_transform(string_split(d.text, chr(10)), lambda l: CASE
                WHEN starts_with(l, '[CODE]: ') THEN '<pre>' || {_esc("substr(l, 9)")} || '</pre>'
                WHEN length(l) - length(replace(l, '|', '')) >= 2
                    THEN '<table><tr><td>' || replace({_esc('l')}, ' | ', '</td><td>') || '</td></tr></table>'
                WHEN l = '' THEN '' ELSE '<p>' || {_esc('l')} || '</p>' END), chr(10))
            || coalesce('<a href="' || n.url || '/">' || n.url || '</a>', '')
            || coalesce(h.links, '')
            || '<footer><A CLASS=x HREF=''../up/' || d.doc_id || '?a=1&amp;b=2''>up</A><a title="a > b" href = /plain-' || d.doc_id || '>plain</a><a href="/f-' || d.doc_id
            || '.pdf">file</a><a href="javascript:go()">go</a><!-- <a href="/hidden">x</a> --><a href="&#47;num-&eacute;/./a/../' || d.doc_id || '">n</a></footer>'
            || '<footer><a href="#top">Top</a></footer></body></html>' AS html
        FROM docs d LEFT JOIN docs n ON n.doc_id = d.doc_id + 1
             LEFT JOIN (SELECT doc_id // 2 AS doc_id, string_agg('<a href="' || url || '/">' || url || '</a>', '' ORDER BY doc_id) AS links
                        FROM docs WHERE doc_id > 1 GROUP BY 1) h ON h.doc_id = d.doc_id
    )"""
_SIGNS = " OR ".join(f"contains(lower(html), '{s}')" for s in fixed.SCRIPT_SIGNS)
# the links of the rendered pages by their making, not by reading them
_LINKS = """docs AS (
        SELECT DISTINCT ON (doc_id) doc_id, url FROM documents WHERE url IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL
    ), roots AS (SELECT *, regexp_extract(url, '^(https?://[^/]*)', 1) AS root, regexp_replace(url, '[^/]*/[^/]*$', '') AS above FROM docs
    ), below AS (SELECT doc_id // 2 AS doc_id, list(url ORDER BY doc_id) AS urls FROM docs WHERE doc_id > 1 GROUP BY 1
    ), raw AS (
        SELECT r.url, list_concat([r.root, NULL], CASE WHEN n.url IS NULL THEN [] ELSE [n.url] END, coalesce(b.urls, []),
            [CASE WHEN length(r.above) > length(r.root) THEN r.above ELSE r.root || '/' END || 'up/' || r.doc_id || '?a=1&b=2',
             r.root || '/plain-' || r.doc_id, NULL, NULL, r.root || '/num-é/' || r.doc_id, NULL]) AS found
        FROM roots r LEFT JOIN docs n ON n.doc_id = r.doc_id + 1 LEFT JOIN below b ON b.doc_id = r.doc_id
    ), links AS (
        SELECT url, CAST(min(pos) AS INTEGER) AS pos, regexp_replace(link, '/+$', '') AS link FROM (
            SELECT url, unnest(found) AS link, unnest(range(len(found))) AS pos FROM raw) WHERE link IS NOT NULL GROUP BY 1, 3
    )"""

_DROPPED = "html"
for _tag in fixed.DROPPED_TAGS:
    _DROPPED = f"regexp_replace({_DROPPED}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}>', '', 'g')"
_PLAIN = _strip("regexp_replace(regexp_replace(cell, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')")
_TABLES = f"""{_HTML}, cut AS (
        SELECT doc_id, list_filter(list_transform(regexp_extract_all({_DROPPED}, '(?is)<table\\b.*?</table>'), lambda t:
            array_to_string(list_filter(list_transform(regexp_extract_all(t, '(?is)<tr\\b[^>]*>(.*?)</tr>', 1), lambda r:
                array_to_string(list_transform(regexp_extract_all(r, '(?is)<t[hd]\\b[^>]*>(.*?)</t[hd]>', 1), lambda cell: {_PLAIN}), ' | ')),
                lambda x: x <> ''), chr(10))), lambda t: {_strip('t')} <> '') AS ts
        FROM pages
    )"""

def _groups(table: str = "documents", size: int = 8) -> str:
    """CTEs that fold sentences into chunks: ``placed(doc_id, pos, no)`` and ``typed(doc_id, pos, sentence, ...)``."""
    return f"""{_sentences(table)}, typed AS (
        SELECT doc_id, pos, sentence, length(sentence) - length(replace(sentence, '|', '')) >= 2 AS is_table,
               regexp_matches(sentence, '^{WS}*[-*•·]{WS}') AS is_bullet, count(*) OVER (PARTITION BY doc_id) AS total
        FROM sent
    ), sizes AS (SELECT doc_id, max(total) AS total FROM typed GROUP BY doc_id
    ), fold AS (
        SELECT doc_id, total, 0 AS step, 0 AS n, 0 AS no, false AS has, false AS last_bullet, 0 AS waiting, false AS waiting_bullet,
               CAST(NULL AS INTEGER) AS own_no, CAST(NULL AS INTEGER) AS flush_no, 0 AS flushed
        FROM sizes
        UNION ALL
        SELECT doc_id, total, step + 1,
               CASE WHEN is_table THEN n1 WHEN after THEN n1 + 1 WHEN n1 >= {size} THEN 1 WHEN over THEN n1 ELSE n1 + 1 END,
               CASE WHEN NOT is_table AND NOT after AND NOT over AND n1 >= {size} THEN no1 + 1 ELSE no1 END,
               has1 OR NOT (is_table OR over),
               CASE WHEN is_table OR over THEN last1 ELSE is_bullet END,
               CASE WHEN is_table THEN waiting + 1 ELSE 0 END, is_table AND is_bullet,
               CASE WHEN is_table OR over THEN NULL WHEN NOT after AND n1 >= {size} THEN no1 + 1 ELSE no1 END,
               CASE WHEN NOT is_table AND waiting > 0 THEN no1 END, CASE WHEN is_table THEN 0 ELSE waiting END
        FROM (
            SELECT *, is_bullet AND has1 AND last1 AS after FROM (
                SELECT f.doc_id, f.total, f.step, f.waiting, t.doc_id IS NULL AS over,
                       coalesce(t.is_table, false) AS is_table, coalesce(t.is_bullet, false) AS is_bullet,
                       CASE WHEN coalesce(t.is_table, false) OR f.waiting = 0 THEN f.n
                            WHEN f.n + f.waiting <= {size} AND f.has THEN f.n + f.waiting ELSE f.waiting END AS n1,
                       CASE WHEN coalesce(t.is_table, false) OR f.waiting = 0 OR (f.n + f.waiting <= {size} AND f.has) OR NOT f.has
                            THEN f.no ELSE f.no + 1 END AS no1,
                       f.has OR (f.waiting > 0 AND NOT coalesce(t.is_table, false)) AS has1,
                       CASE WHEN coalesce(t.is_table, false) OR f.waiting = 0 THEN f.last_bullet ELSE f.waiting_bullet END AS last1
                FROM fold f LEFT JOIN typed t ON t.doc_id = f.doc_id AND t.pos = f.step WHERE f.step <= f.total))
    ), placed AS (
        SELECT doc_id, step - 1 AS pos, own_no AS no FROM fold WHERE own_no IS NOT NULL
        UNION ALL
        SELECT doc_id, step - 1 - unnest(range(1, flushed + 1)), flush_no FROM fold WHERE flushed > 0
    )"""


def _page_text(html: str) -> str:
    """Text of a rendered page: tables, code segments, then the rest as marked text."""
    rest = f"regexp_replace({_DROPPED.replace('html', html)}, '(?is)<table\\b.*?</table>', '', 'g')"
    code = "(?is)<(?:pre|code)\\b[^>]*>(.*?)</(?:pre|code)>"
    segments = f"list_transform(list_filter(list_transform(regexp_extract_all({rest}, '{code}', 1), lambda c: {_strip("regexp_replace(c, '<[^>]*>', '', 'g')")}), lambda c: c <> ''), lambda c: '[CODE]: ' || c)"
    marked = f"regexp_replace({rest}, '{code}', '', 'g')"
    steps = [(f"(?is)<h{n}\\b[^>]*>(.*?)</h{n}>", f"chr(10) || chr(10) || '{'#' * n} \\1' || chr(10) || chr(10)") for n in range(1, 7)]
    steps += [
        ("(?is)<(?:b|strong)\\b[^>]*>(.*?)</(?:b|strong)>", "'**\\1**'"), ("(?is)<(?:i|em)\\b[^>]*>(.*?)</(?:i|em)>", "'_\\1_'"),
        ('(?is)<a\\b[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', "'[\\2](' || chr(57345) || '\\1' || chr(57346) || ')'"),
        ("(?is)<li\\b[^>]*>", "chr(10) || '  * '"),
        ("(?is)<(?:p|div|article|section|ul|ol|body|blockquote)\\b[^>]*>|</(?:p|div|article|section|ul|ol|body|blockquote)>", "chr(10) || chr(10)"),
        ("(?is)<br\\b[^>]*>", "chr(10)"), ("(?is)<head\\b.*?</head>|<!--.*?-->|<[a-z/!][^>]*>", "''"),
    ]
    for pattern, to in steps:
        marked = f"regexp_replace({marked}, '{pattern}', {to}, 'g')"
    marked = f"translate({marked}, chr(57345) || chr(57346), '<>')"
    text = f"array_to_string(list_concat(ts, {segments}, [{marked}]), chr(10) || chr(10))"
    for entity, char in fixed.ENTITIES:
        text = f"replace({text}, '{entity.replace(chr(39), chr(39) * 2)}', '{char.replace(chr(39), chr(39) * 2)}')"
    return _strip(f"regexp_replace(regexp_replace({text}, '[ \\t]+', ' ', 'g'), '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g')")


_INDEX = f"""{_TABLES}, texts AS (
        SELECT doc_id, url, text FROM (SELECT p.doc_id, p.url, {_page_text("p.html")} AS text FROM pages p JOIN cut USING (doc_id)) WHERE text <> ''
    ), {_groups("texts")}"""

_EMBEDDED = "the crew of the harbour lifted the old crane"


def _near() -> str:
    """Chunks near the query by the built-in vector, from the counts of hashed tokens."""
    place = lambda t: f"CAST(('0x' || substr(md5({t}), 1, 6)) AS INTEGER) % 64"
    unit = "CAST(n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS FLOAT)::DOUBLE"
    return f"""ask AS (
            SELECT place, {unit} AS y FROM (SELECT 1 AS id, {place('t')} AS place, count(*) AS n FROM (SELECT unnest({_tokens(f"'{_EMBEDDED}'")}) AS t) GROUP BY ALL)
        ), rows AS (SELECT DISTINCT source_id, chunk_index, coalesce(url, '') AS url, text FROM chunks WHERE text IS NOT NULL
        ), numbered AS (SELECT *, row_number() OVER () AS id FROM rows
        ), counted AS (SELECT id, {place('t')} AS place, count(*) AS n FROM (SELECT id, unnest({_tokens('text')}) AS t FROM numbered) GROUP BY ALL
        ), units AS (SELECT id, place, {unit} AS x FROM counted
        ), scored AS (
            SELECT id, sum(x * coalesce(y, 0)) / sqrt(sum(x * x)) / sqrt((SELECT sum(y * y) FROM ask)) AS exact FROM units LEFT JOIN ask USING (place) GROUP BY id
        ), near AS (SELECT source_id, chunk_index, url, text, round(exact, 4) AS score FROM scored JOIN numbered USING (id) WHERE exact >= 0.3)"""


ORACLE_SQL: dict[str, str] = {
    "fingerprint": """
        SELECT doc_id, CASE WHEN length(text) > 0 THEN substr(sha256(text), 1, 12) END AS fingerprint,
               CASE WHEN length(text) > 0 THEN sha256(text) END AS full_fingerprint,
               CASE WHEN length(text) > 0 THEN substr(sha256(text), 1, 12) END = shi_prefix AS matches
        FROM documents""",
    "duplicate_content": """
        SELECT substr(sha256(text), 1, 12) AS fingerprint, count(*) AS n_docs, min(doc_id) AS first_doc
        FROM documents WHERE length(text) > 0 GROUP BY 1 HAVING count(*) > 1""",
    "url_identity": """
        SELECT DISTINCT url, substr(md5(url), 1, 8) AS url_hash, substr(md5(url), 1, 8) = source_id AS is_source
        FROM chunks WHERE url IS NOT NULL""",
    "chunk_selectors": f"""
        SELECT chunk_id, '{fixed.SELECTOR_PREFIX}' || substr(md5(url), 1, 8) || '-' || chunk_index AS selector,
               '{fixed.SELECTOR_PREFIX}' || substr(md5(url), 1, 8) || '-' || chunk_index = css_selector AS same
        FROM ({_CHUNKS}) WHERE url IS NOT NULL""",
    "sentence_split": f"WITH {_sentences()} SELECT doc_id, pos, sentence FROM sent",
    "chunk_documents": f"""WITH RECURSIVE {_groups()}
        SELECT doc_id, CAST(no AS INTEGER) AS chunk_index, CAST(count(*) AS INTEGER) AS n_sentences,
               string_agg(sentence, ' ' ORDER BY pos) AS text
        FROM placed JOIN typed USING (doc_id, pos) GROUP BY doc_id, no""",
    "index_pages": f"""WITH RECURSIVE {_INDEX}
        SELECT url, substr(md5(url), 1, 8) AS url_hash, substr(sha256(text), 1, 12) AS shi_prefix,
               CAST(1 + max(no) AS INTEGER) AS total_chunks, CAST(any_value(length(text)) AS INTEGER) AS full_text_length
        FROM texts JOIN placed USING (doc_id) GROUP BY doc_id, url, text""",
    "index_chunks": f"""WITH RECURSIVE {_INDEX}
        SELECT substr(md5(url), 1, 8) AS source_id, CAST(no AS INTEGER) AS index, CAST(count(*) AS INTEGER) AS sentence_count,
               '{fixed.SELECTOR_PREFIX}' || substr(md5(url), 1, 8) || '-' || no AS css_selector,
               substr(string_agg(sentence, ' ' ORDER BY pos), 1, 200) AS text_preview
        FROM texts JOIN placed USING (doc_id) JOIN typed USING (doc_id, pos) GROUP BY doc_id, url, no""",
    "index_quarantine": f"""
        SELECT url, CASE WHEN url IS NULL THEN 'no address' ELSE 'no text' END AS reason
        FROM documents WHERE url IS NULL OR text IS NULL OR {_strip('text')} = ''""",
    "registry_json": """
        SELECT generated_at, CAST(to_json({'protocol': protocol, 'ssr_entries': ssr_entries, 'rar_entries': rar_entries}) AS VARCHAR) AS json, true AS same
        FROM registry""",
    "script_pages": f"""WITH {_HTML}
        SELECT doc_id, ({_SIGNS}) OR (regexp_matches(html, '(?is)<body[^>]*>.*?</body>') AND length(html) > 5000 AND
            length({_strip("regexp_replace(regexp_extract(html, '(?is)<body[^>]*>(.*?)</body>', 1), '<[^>]+>', '', 'g')")}) < 200) AS needs_scripts
        FROM pages""",
    "page_tables": f"""WITH {_TABLES}
        SELECT doc_id, CAST(unnest(range(len(ts))) AS INTEGER) AS pos, unnest(ts) AS table_text FROM cut""",
    "page_links": f"WITH {_LINKS} SELECT url, pos, link FROM links",
    "crawl_pages": f"""WITH RECURSIVE {_LINKS}, ordered AS (
            SELECT 0 AS depth, min_by(url, doc_id) AS url, CAST([0] AS BIGINT[]) AS place FROM docs
            UNION ALL
            SELECT depth + 1, link, list_append(place, pos) FROM ordered JOIN links USING (url) WHERE depth < 4
        ), firsts AS (
            SELECT url, min(depth) AS depth, min({{'d': depth, 'p': place}}) AS spot FROM ordered GROUP BY url
        )
        SELECT row_number() OVER (ORDER BY spot) AS rank, url, depth FROM firsts QUALIFY row_number() OVER (ORDER BY spot) <= 50""",
    "page_links_filtered": f"""WITH {_LINKS}
        SELECT url, pos, link FROM links WHERE regexp_matches(link, '/(?:up|plain)') AND NOT regexp_matches(link, '[05]$')
            AND regexp_extract(link, '://(?:www\\.)?([^/]*)', 1) = regexp_extract(url, '://(?:www\\.)?([^/]*)', 1)""",
    "crawl_totals": f"""WITH RECURSIVE {_LINKS}, reached AS (
            SELECT 0 AS depth, min(url) AS url, CAST([0] AS BIGINT[]) AS place FROM docs
            UNION ALL SELECT depth + 1, link, list_append(place, pos) FROM reached JOIN links USING (url) WHERE depth < 2
        ), firsts AS (SELECT url FROM reached GROUP BY url ORDER BY min({{'d': depth, 'p': place}}) LIMIT 30)
        SELECT count(*) AS total_discovered, count(*) FILTER (WHERE url IN (SELECT url FROM docs)) AS total_indexed,
               count(*) FILTER (WHERE url NOT IN (SELECT url FROM docs)) AS total_failed FROM firsts""",
    "text_vectors": f"""
        WITH t AS (SELECT doc_id, unnest({_tokens("text")}) AS token FROM documents WHERE text IS NOT NULL),
        n AS (SELECT doc_id, CAST(('0x' || substr(md5(token), 1, 6)) AS INTEGER) % 64 AS place, count(*) AS n FROM t GROUP BY ALL)
        SELECT doc_id, CAST(place AS INTEGER) AS place, round(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS FLOAT)::DOUBLE, 4) AS x FROM n""",
    "search_sources": f"""WITH {_near()} SELECT source_id, chunk_index, url, text, score FROM near ORDER BY score DESC, source_id, chunk_index LIMIT 20""",
    "search_fallback": f"SELECT source_id, chunk_index, url, text, CAST(score AS DOUBLE) AS score FROM ({_SEARCH} LIMIT 5)",
    "check_embedded": f"""WITH {_near()}, hits AS (SELECT * FROM near ORDER BY score DESC, source_id, chunk_index LIMIT 5), agg AS (
            SELECT count(*) AS n_results, coalesce(max(score), 0) AS best_score, count(DISTINCT nullif(url, '')) AS sources_matched,
                   least(count(*) / greatest((SELECT count(DISTINCT url_hash) FROM sources), 1), 1.0) AS coverage FROM hits
        ), blended AS (SELECT *, CASE WHEN n_results = 0 THEN 0.0 ELSE least(0.7 * best_score + 0.3 * coverage, 1.0) END AS blend FROM agg)
        SELECT '{_EMBEDDED}' AS query, n_results, best_score, round(coverage, 4) AS coverage, CAST(round(blend, 4) AS DOUBLE) AS confidence,
               CASE WHEN blend >= 0.7 THEN 'HIGH' WHEN blend >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS tier, blend >= 0.7 AS answerable, sources_matched
        FROM blended""",
    "source_chunks": """
        SELECT DISTINCT source_id, chunk_index, css_selector, text FROM chunks WHERE source_id = (SELECT min(source_id) FROM chunks WHERE chunk_index IS NOT NULL) AND chunk_index IS NOT NULL""",
    "text_claims": f"""
        WITH c AS ({_CLAIMS}) SELECT text_id, claim_id, claim_text, verified FROM c WHERE text_id = (SELECT min(text_id) FROM c)""",
    "text_relationships": f"""
        WITH r AS ({_RELS}) SELECT text_id, rel_id, rel_type, array_to_string(claim_ids, ',') AS claim_ids FROM r WHERE text_id = (SELECT min(text_id) FROM r)""",
    "source_lookup": f"WITH s AS ({_SOURCES}) SELECT * FROM s WHERE url_hash = (SELECT max(url_hash) FROM s)",
    "relation_records": f"""
        SELECT text_id, CAST(pos AS INTEGER) AS pos, 'R' || n AS relationship_id, type, claim_ids, '' AS synthesis_text,
               '(R' || n || ':' || type || ':' || claim_ids || ')' AS marker FROM (
            SELECT 't' || doc_id AS text_id, unnest(range(len(regexp_extract_all(text, '{_R}', 1)))) AS pos,
                   CAST(unnest(regexp_extract_all(text, '{_R}', 1)) AS BIGINT) AS n,
                   unnest(regexp_extract_all(text, '{_R}', 2)) AS type, unnest(regexp_extract_all(text, '{_R}', 3)) AS claim_ids
            FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)""",
    "chunk_sizes": f"""WITH RECURSIVE texts AS (SELECT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL), {_groups("texts", 5)}
        SELECT doc_id, count(DISTINCT no) AS n_chunks, count(*) AS n_sentences FROM placed GROUP BY doc_id""",
    "same_domain": """
        SELECT doc_id, host, host = lower(source) || '.example' AS same FROM (
            SELECT doc_id, source, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\\.', '') AS host
            FROM documents WHERE url IS NOT NULL AND source IS NOT NULL)""",
    "keyword_search": _SEARCH + " LIMIT 20",
    "keyword_counts": f"""
        SELECT source_id, count(*) FILTER (WHERE {_SCORE} > 0) AS n_chunks, CAST(sum({_SCORE}) AS BIGINT) AS n_sentences
        FROM ({_CHUNKS}) GROUP BY source_id""",
    "check_indexed": f"""
        WITH hits AS ({_SEARCH} LIMIT 5), agg AS (
            SELECT count(*) AS n_results, coalesce(max(score), 0) AS best_score, count(DISTINCT nullif(url, '')) AS sources_matched,
                   least(count(*) / greatest((SELECT count(DISTINCT url_hash) FROM sources), 1), 1.0) AS coverage FROM hits
        ), blended AS (
            SELECT *, CASE WHEN n_results = 0 THEN 0.0 ELSE least(0.7 * best_score + 0.3 * coverage, 1.0) END AS blend FROM agg
        )
        SELECT '{_KEYWORD}' AS query, n_results, best_score, round(coverage, 4) AS coverage, CAST(round(blend, 4) AS DOUBLE) AS confidence,
               CASE WHEN blend >= 0.7 THEN 'HIGH' WHEN blend >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS tier,
               blend >= 0.7 AS answerable, sources_matched
        FROM blended""",
    "check_hits": f"""
        WITH hits AS ({_SEARCH} LIMIT 5), rows AS (SELECT DISTINCT ON (source_id, chunk_index) source_id, chunk_index, text FROM chunks)
        SELECT h.source_id, h.chunk_index, h.score, h.url,
               substr(string_agg(r.text, chr(10) || chr(10) ORDER BY r.chunk_index), 1, 1200) AS text_preview,
               length(string_agg(r.text, chr(10) || chr(10) ORDER BY r.chunk_index)) > length(h.text) AS expanded
        FROM hits h JOIN rows r ON r.source_id = h.source_id AND r.chunk_index BETWEEN h.chunk_index - 2 AND h.chunk_index + 2
        GROUP BY h.source_id, h.chunk_index, h.score, h.url, h.text""",
    "neighbour_expand": """
        SELECT source_id, chunk_index, coalesce(string_agg(text, chr(10) || chr(10)) OVER w, '') AS context, count(*) OVER w AS n_chunks
        FROM (SELECT DISTINCT ON (source_id, chunk_index) source_id, chunk_index, text FROM chunks
              WHERE source_id IS NOT NULL AND chunk_index IS NOT NULL)
        WINDOW w AS (PARTITION BY source_id ORDER BY chunk_index RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)""",
    "vector_search": """
        SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
                SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 4) AS score
                FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id))
        WHERE rank <= 10""",
    "chunk_vectors": f"""
        WITH rows AS (SELECT chunk_id, embedding::DOUBLE[] AS e FROM ({_CHUNKS}) WHERE len(embedding) > 0)
        SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
                SELECT query_id, id, round(exact, 4) AS score FROM (
                    SELECT q.chunk_id AS query_id, v.chunk_id AS id, list_cosine_similarity(q.e, v.e) AS exact
                    FROM rows q JOIN rows v ON q.chunk_id % 50 = 0 AND q.chunk_id <> v.chunk_id) WHERE exact >= 0.7))
        WHERE rank <= 5""",
    "cosine_pairs": """
        SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine
        FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "claim_markers": f"WITH {_MARKS} SELECT text_id, pos, claim_id, shi_prefix, css_selector, claim_text FROM found",
    "relation_markers": f"""
        SELECT 't' || doc_id AS text_id, CAST(unnest(range(len(regexp_extract_all(text, '{_R}', 1)))) AS INTEGER) AS pos,
               CAST(unnest(regexp_extract_all(text, '{_R}', 1)) AS BIGINT) AS rel_id,
               unnest(regexp_extract_all(text, '{_R}', 2)) AS rel_type, unnest(regexp_extract_all(text, '{_R}', 3)) AS claim_ids
        FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL""",
    "marker_round_trip": f"""WITH {_MARKS}
        SELECT text_id, pos, '[C' || claim_id || ':' || shi_prefix || ':css=' || css_selector || ']' AS made,
               '[C' || claim_id || ':' || shi_prefix || ':css=' || css_selector || ']' = marker AS same FROM found""",
    "grounded_text": f"""
        WITH c AS ({_CLAIMS}), rel AS ({_RELS}), first AS (
            SELECT text_id, min({{'rel_id': rel_id, 'rel_type': rel_type, 'claim_ids': claim_ids, 's': synthesis_text}}) AS r FROM rel GROUP BY text_id
        )
        SELECT text_id, claim_id, claim_text || ' [C1:' || CASE WHEN length(shi_prefix) > 0 THEN shi_prefix ELSE substr(sha256(claim_text), 1, 12) END
               || ':css=' || CASE WHEN length(css_selector) > 0 THEN css_selector ELSE '{fixed.AUTO_SELECTOR}' END || ']'
               || CASE WHEN r.rel_type IN ('SUMMARY', 'CONTRADICTION', 'EXTENSION', 'CAUSAL', 'ANALOGY') THEN
                    chr(10) || CASE WHEN length(r.s) > 0 THEN r.s ELSE 'Relationship: ' || r.rel_type END || ' (R1:' || r.rel_type || ':'
                    || CASE WHEN len(r.claim_ids) > 0 THEN array_to_string(r.claim_ids, ',') ELSE 'C1' END || ')' ELSE '' END AS grounded
        FROM c LEFT JOIN first USING (text_id) WHERE claim_text IS NOT NULL""",
    "verify_claims": f"WITH {_VERIFY} SELECT * FROM verified",
    "verify_summary": f"""WITH {_VERIFY}
        SELECT text_id, count(*) AS total, count(*) FILTER (WHERE verified) AS passed, count(*) FILTER (WHERE NOT verified) AS failed,
               bool_and(verified) AS verified FROM verified GROUP BY text_id""",
    "verify_pages": f"""
        WITH docs AS (
            SELECT DISTINCT ON (doc_id) doc_id, url, text FROM documents WHERE doc_id IS NOT NULL AND url IS NOT NULL AND length(text) > 0
        ), page AS (SELECT url, min_by(text, doc_id) AS page_text FROM docs GROUP BY url
        ), cut AS (
            SELECT doc_id, url, substr(sha256(text), 1, 12) AS own, {_strip("substr(replace(replace(text, '[', ' '), ']', ' '), 1, 160)")} AS head FROM docs
        ), made AS (
            SELECT doc_id, url, CASE WHEN doc_id % 7 = 0 THEN substr(sha256(own), 1, 12) ELSE own END AS shi_prefix, doc_id % 7 <> 1 AS known,
                   CASE doc_id % 3 WHEN 0 THEN array_to_string(list_reverse(string_split_regex(head, '{WS}+')), ' ') WHEN 1 THEN 'quite something else' ELSE head END AS said
            FROM cut
        ), claimed AS (
            SELECT doc_id, shi_prefix, list_extract(string_split_regex(regexp_replace({_strip("said")}, '([.!?]){WS}+', '\\1' || {_CUT}, 'g'), {_CUT}), -1) AS c FROM made
        ), known AS (SELECT shi_prefix, min(url) AS source_url FROM made WHERE known GROUP BY shi_prefix
        ), j AS (
            SELECT 'd' || doc_id AS text_id, shi_prefix, source_url, CASE WHEN length(c) > 0 THEN c ELSE '' END AS c, page_text AS s
            FROM claimed LEFT JOIN known USING (shi_prefix) LEFT JOIN page ON page.url = source_url
        )
        SELECT text_id, 0 AS pos, 'C1' AS claim_id, source_url, c AS claim_text,
               coalesce(substr(sha256(s), 1, 12) = shi_prefix, false) AS shi_valid,
               CASE WHEN s IS NOT NULL THEN {_METHOD} END AS match_method,
               coalesce(substr(sha256(s), 1, 12) = shi_prefix AND {_METHOD} <> 'none', false) AS verified,
               CASE WHEN source_url IS NULL THEN 'source not found' WHEN s IS NULL THEN 'page not fetched' END AS reason
        FROM j""",
    "token_overlap": f"""
        WITH l AS ({_CLAIMS}), p AS (SELECT css_selector, max(text) AS passage FROM chunks WHERE chunk_id IS NOT NULL GROUP BY css_selector),
        j AS (SELECT text_id, claim_id, claim_text AS c, passage AS s FROM l JOIN p USING (css_selector) WHERE claim_text IS NOT NULL)
        SELECT text_id, claim_id, CAST(len({_OWN}) AS INTEGER) AS n_tokens,
               CASE WHEN s IS NOT NULL THEN CAST(len(list_intersect({_OWN}, {_THEIRS})) AS INTEGER) END AS n_common, {_METHOD} AS method FROM j""",
    "audit_registry": f"""
        SELECT text_id, '{fixed.PROTOCOL}' AS protocol, CAST(len(c) AS INTEGER) AS n_claims, CAST(len(r) AS INTEGER) AS n_relations,
               array_to_string(list_transform(c, lambda x: 'C' || CAST(x AS BIGINT)), ',') AS claim_ids
        FROM (SELECT 't' || doc_id AS text_id, regexp_extract_all(text, '{_C}', 1) AS c, regexp_extract_all(text, '{_R}', 1) AS r
              FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL) WHERE len(c) > 0 OR len(r) > 0""",
    "registry_recent": """
        SELECT protocol, generated_at, CAST(len(ssr_entries) AS INTEGER) AS n_ssr, CAST(coalesce(len(rar_entries), 0) AS INTEGER) AS n_rar
        FROM registry ORDER BY generated_at DESC LIMIT 10""",
    "registry_claims": """
        SELECT e.source_url AS source_url, count(*) AS n_claims, count(*) FILTER (WHERE e.verified) AS n_verified
        FROM (SELECT unnest(ssr_entries) AS e FROM registry) GROUP BY 1""",
    "latest_sources": _SOURCES,
    "list_sources": f"SELECT url, shi_prefix, total_chunks, url_hash, indexed_at FROM ({_SOURCES})",
    "count_sources": "SELECT count(DISTINCT url_hash) AS n_sources FROM sources",
    "source_conflicts": f"""
        SELECT shi_prefix, count(*) AS n_urls, min(url) AS first_url FROM ({_SOURCES}) WHERE shi_prefix IS NOT NULL
        GROUP BY shi_prefix HAVING count(*) > 1""",
    "latest_claims": _CLAIMS,
    "global_claims": "SELECT claim_id, text_id, verified, created_at FROM ("
    + _latest("claims", ["claim_id"], ["text_id", *_CLAIM_FIELDS], "created_at") + ")",
    "latest_relationships": f"""
        SELECT text_id, rel_id, rel_type, array_to_string(claim_ids, ',') AS claim_ids, synthesis_text, created_at FROM ({_RELS})""",
    "relationship_claims": f"""
        WITH r AS ({_RELS}), c AS ({_CLAIMS}), n AS (SELECT text_id, rel_id, unnest(list_distinct(claim_ids)) AS claim_id FROM r)
        SELECT n.text_id, n.rel_id, n.claim_id, c.claim_id IS NOT NULL AS found, c.verified
        FROM n LEFT JOIN c ON c.text_id = n.text_id AND c.claim_id = n.claim_id""",
    "delete_cascade": f"""
        WITH old AS (SELECT url_hash FROM ({_SOURCES}) WHERE indexed_at < TIMESTAMPTZ '2030-03-01 00:00:00+00')
        SELECT source_id, count(*) AS n_chunks FROM ({_CHUNKS}) c
        WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.url_hash = c.source_id) GROUP BY source_id""",
    "orphan_chunks": """
        SELECT source_id, count(DISTINCT chunk_id) AS n_chunks, coalesce(source_id IN (SELECT url_hash FROM sources WHERE url_hash IS NOT NULL), false) AS known
        FROM chunks GROUP BY source_id""",
    "collection_counts": " UNION ALL ".join(
        f"SELECT '{n}' AS collection, count(*) AS n_rows FROM {n}" for n in ("sources", "chunks", "claims", "relationships", "registry")
    ),
}
