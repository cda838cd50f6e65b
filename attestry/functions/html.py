"""Text, tables, code and links of HTML pages as Column expressions.

The rendering is this engine's own canonical one: block elements end lines, list
items and headings get their marks, links keep their text and address. Python sees
only the pages that expressions can't read: with dropped elements inside each
other, or with entities beyond the common ones.
"""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from attestry.functions import fixed
from attestry.functions.text import strip

_TABLE = "(?is)<table\\b.*?</table>"
_CODE = "(?is)<(?:pre|code)\\b[^>]*>(.*?)</(?:pre|code)>"
_LEFT, _RIGHT = "\ue001", "\ue002"  # stand in for the angle brackets of links until the tags are gone
SHELL_TEXT, SHELL_HTML = 200, 5000
_DROPPED = "|".join(fixed.DROPPED_TAGS)
_RAW_TAGS = ("script", "style")
_OTHER_ENTITY = "&(?!(?:" + "|".join(e[1:-1] for e, _ in fixed.ENTITIES) + ");)(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"
_HREF = r"""(?i)(<a\b(?:\s+(?!href\s*=)|[^>"'\s]++|"[^"]*+"|'[^']*+')*+\s+href\s*=\s*)"""


def without_nested(html: str) -> str:
    """A page without its dropped elements, whatever stands in them, also further elements of that name.

    The text of scripts and styles ends at their first end tag. An element that
    is never closed loses its tag only, so does a closing tag without a beginning.
    """
    spans: list[tuple[int, int]] = []
    tags = re.compile(f"(?is)<(/?)({_DROPPED})\\b[^>]*>")
    open_at: list[tuple[str, int]] = []
    raw = None
    for m in tags.finditer(html):
        name, closes = m.group(2).lower(), bool(m.group(1))
        if raw and not (closes and name == raw):
            continue
        if not closes:
            if m.group().endswith("/>"):
                spans.append(m.span())
                continue
            open_at.append((name, m.start()))
            raw = name if name in _RAW_TAGS else None
            continue
        raw = None
        at = next((k for k in range(len(open_at) - 1, -1, -1) if open_at[k][0] == name), None)
        spans.append((open_at[at][1] if at is not None else m.start(), m.end()))
        if at is not None:
            del open_at[at:]
    out, done = [], 0
    for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= done:
            out.append(html[done:a])
        done = max(done, b)
    return re.sub(f"(?is)<({_DROPPED})\\b[^>]*>", "", "".join(out) + html[done:])


@F.pandas_udf(StringType())
def _without_nested(html: pd.Series) -> pd.Series:
    return html.map(without_nested, na_action="ignore")


@F.pandas_udf(StringType())
def _unescaped(text: pd.Series) -> pd.Series:
    return text.map(lambda t: re.sub(_OTHER_ENTITY, lambda m: unescape(m.group()), t), na_action="ignore")


def needs_scripts(html: Column) -> Column:
    """Whether a page is drawn by scripts: a known sign, or a large page with hardly any body text."""
    low = F.lower(html)
    sign = F.lit(False)
    for s in fixed.SCRIPT_SIGNS:
        sign = sign | F.contains(low, F.lit(s))
    body = F.regexp_extract(html, "(?is)<body[^>]*>(.*?)</body>", 1)
    has_body = html.rlike("(?is)<body[^>]*>.*?</body>")
    empty = F.length(strip(F.regexp_replace(body, "<[^>]+>", ""))) < SHELL_TEXT
    return sign | (has_body & empty & (F.length(html) > SHELL_HTML))


def drop_subtrees(html: Column) -> Column:
    """Without scripts, styles, navigation, footers and other subtrees that hold no text of the page."""
    flat = F.regexp_replace(html, f"(?is)<({_DROPPED})\\b[^>]*>.*?</\\1\\s*>", "")
    nested = _without_nested(F.when(flat.rlike(f"(?i)</?(?:{_DROPPED})\\b"), html))
    return F.coalesce(nested, flat)


def _plain(html: Column) -> Column:
    """Text of a fragment, white space joined."""
    return strip(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), "\\s+", " "))


def table_text(table: Column) -> Column:
    """Rows of a table as lines, cells joined by `` | ``; spans of rows and columns are ignored."""
    rows = F.regexp_extract_all(table, F.lit("(?is)<tr\\b[^>]*>(.*?)</tr>"), F.lit(1))
    lines = F.transform(
        rows,
        lambda r: F.array_join(
            F.transform(F.regexp_extract_all(r, F.lit("(?is)<t[hd]\\b[^>]*>(.*?)</t[hd]>"), F.lit(1)), _plain), " | "
        ),
    )
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def tables(html: Column) -> Column:
    """The tables of a page as text, in order."""
    return _tables(drop_subtrees(html))


def _tables(body: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(body, F.lit(_TABLE), F.lit(0)), table_text), lambda t: strip(t) != "")


def _markdown(html: Column) -> Column:
    """Headings, emphasis, links and list items of what is neither table nor code."""
    for level in range(1, 7):
        html = F.regexp_replace(html, f"(?is)<h{level}\\b[^>]*>(.*?)</h{level}>", "\n\n" + "#" * level + " $1\n\n")
    html = F.regexp_replace(html, "(?is)<(?:b|strong)\\b[^>]*>(.*?)</(?:b|strong)>", "**$1**")
    html = F.regexp_replace(html, "(?is)<(?:i|em)\\b[^>]*>(.*?)</(?:i|em)>", "_$1_")
    html = F.regexp_replace(html, "(?s)" + _HREF + '"([^"]*)"[^>]*>(.*?)</a>', f"[$3]({_LEFT}$2{_RIGHT})")
    html = F.regexp_replace(html, "(?is)<li\\b[^>]*>", "\n  * ")
    html = F.regexp_replace(html, "(?is)<(?:p|div|article|section|ul|ol|body|blockquote)\\b[^>]*>|</(?:p|div|article|section|ul|ol|body|blockquote)>", "\n\n")
    html = F.regexp_replace(html, "(?is)<br\\b[^>]*>", "\n")
    html = F.regexp_replace(html, "(?is)<head\\b.*?</head>|<!--.*?-->|<[a-z/!][^>]*>", "")
    return F.translate(html, _LEFT + _RIGHT, "<>")


def other_entities(text: Column) -> Column:
    """All entities but the common ones decoded, named and numeric."""
    return F.coalesce(_unescaped(F.when(text.rlike(_OTHER_ENTITY), text)), text)


def decode_entities(text: Column) -> Column:
    """The common entities, in their fixed order, so that a doubly coded one is decoded twice."""
    for entity, char in fixed.ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def quoted_hrefs(html: Column) -> Column:
    """The targets of all links in double quotes."""
    single = F.regexp_replace(html, _HREF + "'([^'\"]*)'", '$1"$2"')
    bare = F.regexp_replace(single, _HREF + "([^\\s\"'>]+)", '$1"$2"')
    return F.when(html.rlike("(?i)\\shref\\s*=\\s*[^\\s\"]"), bare).otherwise(html)


def page_body(html: Column) -> Column:
    """What the text of a page is taken from: no dropped subtrees, link targets in double quotes."""
    return quoted_hrefs(drop_subtrees(html))


def body_text(body: Column) -> Column:
    """Tables first, then code segments, then the rest of a body; ``""`` if nothing is left."""
    rest = F.regexp_replace(body, _TABLE, "")
    code = F.filter(
        F.transform(
            F.regexp_extract_all(rest, F.lit(_CODE), F.lit(1)), lambda c: strip(F.regexp_replace(c, "<[^>]*>", ""))
        ),
        lambda c: c != "",
    )
    code = F.transform(code, lambda c: F.concat(F.lit("[CODE]: "), c))
    parts = F.concat(_tables(body), code, F.array(_markdown(F.regexp_replace(rest, _CODE, ""))))
    text = decode_entities(other_entities(F.array_join(parts, "\n\n")))
    return strip(F.regexp_replace(F.regexp_replace(text, "[ \\t]+", " "), "\\n{4,}", "\n\n\n"))


def page_text(html: Column) -> Column:
    """The text of a page; null for null pages."""
    return body_text(page_body(html))


def link_source(html: Column) -> Column:
    """A page without comments, scripts and styles, link targets in double quotes."""
    return quoted_hrefs(F.regexp_replace(html, "(?is)<!--.*?-->|<(script|style)\\b[^>]*>.*?</\\1\\s*>", ""))


def hrefs(source: Column) -> Column:
    """Link targets of a ``link_source`` in order, as written."""
    return F.regexp_extract_all(source, F.lit(_HREF + '"([^"]*)"'), F.lit(2))


def decoded_href(href: Column) -> Column:
    """A link target without line ends and tabs, its entities decoded."""
    return decode_entities(other_entities(F.translate(href, "\n\r\t", "")))
