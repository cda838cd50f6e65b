"""Identity, stripping, sentence splitting and chunk grouping as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestry.functions import fixed
from attestry.functions.fixed import WS


def strip(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.btrim(text, F.lit(fixed.WS_CHARS))


def fingerprint(text: Column) -> Column:
    """First 12 hex digits of the SHA-256 of a text; null for null and empty texts."""
    return F.when(F.length(text) > 0, F.substring(F.sha2(text, 256), 1, fixed.FINGERPRINT_CHARS))


def full_fingerprint(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.sha2(text, 256))


def fingerprint_matches(text: Column, prefix: Column) -> Column:
    """Whether a text still has a fingerprint; null where either is missing."""
    return fingerprint(text) == prefix


def url_hash(url: Column) -> Column:
    """Source id: first 8 hex digits of the MD5 of an address."""
    return F.substring(F.md5(url), 1, fixed.URL_HASH_CHARS)


def chunk_selector(url: Column, index: Column) -> Column:
    return F.concat(F.lit(fixed.SELECTOR_PREFIX), url_hash(url), F.lit("-"), index.cast("string"))


def pipes(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit("|"), F.lit("")))


def is_table_row(s: Column) -> Column:
    return pipes(s) >= 2


def is_bullet(s: Column) -> Column:
    return s.rlike(f"^{WS}*[-*•·]{WS}")


def split_sentences(text: Column) -> Column:
    """Sentences and segments of a text; an empty array for empty, null for null texts.

    Paragraphs that are table rows or list items stay whole; others are split
    behind ``.``, ``!`` or ``?`` before a capital, quotation mark or parenthesis,
    but not behind the protected abbreviations.
    """

    def of_paragraph(p: Column) -> Column:
        guarded = p
        for a in fixed.ABBREVIATIONS:
            guarded = F.replace(guarded, F.lit(a), F.lit(a.replace(".", fixed.DOT)))
        parts = F.transform(
            F.split(guarded, f"(?<=[.!?]){WS}+(?=[A-Z\"'(])"),
            lambda x: strip(F.replace(x, F.lit(fixed.DOT), F.lit("."))),
        )
        whole = is_table_row(p) | p.rlike(f"^[-*•·]{WS}") | p.rlike(rf"^\p{{Nd}}+[.)]{WS}")
        return F.when(whole, F.array(p)).otherwise(parts)

    paragraphs = F.filter(F.transform(F.split(text, "\n\n+"), strip), lambda p: p != "")
    return F.filter(F.flatten(F.transform(paragraphs, of_paragraph)), lambda s: s != "")


def group_chunks(sentences: Column, size: int = 8) -> Column:
    """Fold sentences into chunks of about ``size``; table rows and bullets stay together.

    Rows of a table join the chunk before them if they fit, otherwise they open
    the next one; a bullet behind a bullet joins it whatever the size.
    """
    texts, groups = "array<string>", "array<array<string>>"

    def state(done: Column, cur: Column, n: Column, table: Column) -> Column:
        return F.struct(done.alias("done"), cur.alias("cur"), n.alias("n"), table.alias("table"))

    def closed(done: Column, cur: Column) -> Column:
        return F.when(F.size(cur) > 0, F.array_append(done, cur)).otherwise(done)

    def flush(acc: Column) -> Column:
        """The state without waiting table rows."""
        rows = F.size(acc["table"])
        fits = (acc["n"] + rows <= size) & (F.size(acc["cur"]) > 0)
        empty = F.array().cast(texts)
        return (
            F.when(rows == 0, acc)
            .when(fits, state(acc["done"], F.concat(acc["cur"], acc["table"]), acc["n"] + rows, empty))
            .otherwise(state(closed(acc["done"], acc["cur"]), acc["table"], rows, empty))
        )

    def step(acc: Column, s: Column) -> Column:
        def prose(a: Column) -> Column:
            after_bullet = is_bullet(s) & F.coalesce(is_bullet(F.try_element_at(a["cur"], F.lit(-1))), F.lit(False))
            return F.when(
                ~after_bullet & (a["n"] >= size),
                state(F.array_append(a["done"], a["cur"]), F.array(s), F.lit(1), a["table"]),
            ).otherwise(state(a["done"], F.array_append(a["cur"], s), a["n"] + 1, a["table"]))

        waits = state(acc["done"], acc["cur"], acc["n"], F.array_append(acc["table"], s))
        # the one-element transform names the flushed state, so that it is computed once
        return F.when(is_table_row(s), waits).otherwise(F.transform(F.array(flush(acc)), prose)[0])

    empty = state(F.array().cast(groups), F.array().cast(texts), F.lit(0), F.array().cast(texts))
    return F.aggregate(
        sentences, empty, step,
        lambda acc: F.transform(F.array(flush(acc)), lambda a: closed(a["done"], a["cur"]))[0],
    )
