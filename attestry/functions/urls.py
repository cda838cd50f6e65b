"""Resolving, filtering and comparing addresses as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestry.functions import fixed
from attestry.functions.text import strip


def host(url: Column) -> Column:
    """Host in lower case without user, port and one leading ``www.``; ``""`` if there is none."""
    name = F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(name, "^www\\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, "^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def same_domain(a: Column, b: Column) -> Column:
    return host(a) == host(b)


def is_skipped_link(href: Column) -> Column:
    """Empty links, fragments and schemes that are no pages."""
    h = strip(F.coalesce(href, F.lit("")))
    scheme = F.lower(F.regexp_extract(h, "^([^:]*):", 1))
    return (h == "") | h.startswith("#") | scheme.isin(*fixed.SKIPPED_SCHEMES)


def is_skipped_file(url: Column) -> Column:
    """Binary files: an extension at the end, or anywhere in a path whose last part has a dot."""
    p = F.lower(path(url))
    escaped = "|".join(e.replace(".", "\\.") for e in fixed.SKIPPED_EXTENSIONS)
    return p.rlike(f"(?:{escaped})$") | (p.rlike(f"(?:{escaped})") & p.rlike("\\.[^/]*$"))


def _merged(base_path: Column, href: Column) -> Column:
    """A relative path put behind the directory of the base path, dot segments removed."""
    whole = F.concat(F.regexp_replace(base_path, "[^/]*$", ""), href)
    return _without_dots(whole)


def _without_dots(whole: Column) -> Column:
    parts = F.split(F.regexp_replace(whole, "^/", ""), "/")
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(x == ".", acc)
        .otherwise(F.array_append(acc, x)),
    )
    slash = F.when(whole.rlike("(?:^|/)\\.{1,2}$") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.lit("/"), F.array_join(kept, "/"), slash)


def resolve(base: Column, href: Column) -> Column:
    """A link target made absolute against the address of its page."""
    h = strip(href)
    scheme = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    root = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    tail = F.regexp_extract(h, "([?#].*)?$", 0)
    stem = F.regexp_extract(h, "^([^?#]*)", 1)
    bare = F.regexp_extract(base, "^([^?#]*)", 1)
    return (
        F.when(h.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), h)
        .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
        .when(h == "", base)
        .when(h.startswith("?"), F.concat(bare, h))
        .when(h.startswith("#"), F.concat(F.regexp_extract(base, "^([^#]*)", 1), h))
        .when(h.startswith("/"), F.concat(root, _without_dots(stem), tail))
        .otherwise(F.concat(root, _merged(path(base), stem), tail))
    )


def is_page(base: Column, url: Column, include: str | None = None, exclude: str | None = None, external: bool = False) -> Column:
    """Whether an absolute address found on the page ``base`` may be followed."""
    good = ~is_skipped_file(url) & url.rlike("(?i)^https?:")
    if not external:
        good = good & same_domain(url, base)
    if include:
        good = good & url.rlike(include)
    if exclude:
        good = good & ~url.rlike(exclude)
    return good


def accepted_link(
    base: Column, href: Column, include: str | None = None, exclude: str | None = None, external: bool = False
) -> Column:
    """The absolute address of a link that may be followed, without trailing slashes; null for others."""
    url = resolve(base, href)
    good = ~is_skipped_link(href) & is_page(base, url, include, exclude, external)
    return F.when(good, F.regexp_replace(url, "/+$", ""))
