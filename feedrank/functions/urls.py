"""URL expressions.

``parse_url`` throws on URLs with a space and normalises too little, so the
generic RFC 3986 split is done with one regular expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import casefold
from .text import alnum_only, blank_to_null, html_escape, let, strip

_SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?//([^/?#]*)([^?#]*)"
_IP_LITERAL = r"\[(?:[vV][0-9a-fA-F]+\.[^\[\]]+|[0-9A-Fa-f:.]*:[0-9A-Fa-f:.%]*)\]"


def _clean(url: Column) -> Column:
    # Tab and line breaks inside a URL are dropped, as URL parsers do.
    return F.translate(strip(url), "\t\r\n", "")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(_clean(url), _SPLIT, 1))


def authority(url: Column) -> Column:
    return F.lower(F.regexp_extract(_clean(url), _SPLIT, 2))


def path(url: Column) -> Column:
    return F.regexp_extract(_clean(url), _SPLIT, 3)


def _bad_brackets(host: Column) -> Column:
    has = F.contains(host, F.lit("[")) | F.contains(host, F.lit("]"))
    return has & ~host.rlike(_IP_LITERAL)


def canonical_url(url: Column) -> Column:
    """Scheme and authority lower-cased; query, fragment and end slashes cut.

    Null when there is no authority or no path, or the host is malformed.
    """
    def split(clean):
        part = lambda i: F.regexp_extract(clean, _SPLIT, i)
        return F.struct(F.lower(part(1)).alias("s"), F.lower(part(2)).alias("a"), part(3).alias("p"))

    def joined(parts):
        s, a, p = parts["s"], parts["a"], parts["p"]
        prefix = F.when(s == "", F.lit("//")).otherwise(F.concat(s, F.lit("://")))
        ok = (a != "") & (p != "") & ~_bad_brackets(a)
        return F.when(ok, F.concat(prefix, a, F.regexp_replace(p, "/+$", "")))

    return let(let(_clean(url), split), joined)


def dedup_key(url: Column, source: Column, job_id: Column, company: Column, title: Column) -> Column:
    """Identity of a posting: its canonical URL, else its descriptive fields."""
    parts = [alnum_only(casefold(F.coalesce(c, F.lit("")))) for c in (source, job_id, company, title)]
    return F.coalesce(
        F.concat(F.lit("url:"), canonical_url(url)),
        F.concat(F.lit("job:"), F.concat_ws(":", *parts)),
    )


def strip_query(url: Column) -> Column:
    return F.substring_index(url, "?", 1)


def last_segment(url: Column) -> Column:
    return F.substring_index(url, "/", -1)


def id_after_dash(url: Column) -> Column:
    """Text after the last dash; the whole URL when there is none."""
    return F.substring_index(url, "-", -1)


def absolute_url(href: Column, base: str, relative_prefix: str | None = None) -> Column:
    """Prefix relative links.

    With ``relative_prefix`` only links that start with it are prefixed,
    otherwise all links that do not start with "http".
    """
    if relative_prefix is None:
        keep = F.startswith(href, F.lit("http"))
    else:
        keep = ~F.startswith(href, F.lit(relative_prefix))
    return F.when(keep, href).otherwise(F.concat(F.lit(base), href))


def profile_slug(url: Column, host: str) -> Column:
    """Company slug of a directory profile URL on ``host``, else null."""
    found = F.regexp_extract(path(url), "^/companies/([^/?#]+)/?$", 1)
    return F.when(authority(url) == host, blank_to_null(found))


def is_profile_url(url: Column, host: str) -> Column:
    return F.coalesce((scheme(url) == "https") & profile_slug(url, host).isNotNull(), F.lit(False))


def canonical_profile_url(url: Column, fallback: Column, host: str) -> Column:
    """Canonical profile URL of ``url`` (of ``fallback`` when it is empty)."""
    slug = profile_slug(F.coalesce(blank_to_null(url), fallback), host)
    return F.concat(F.lit(f"https://{host}/companies/"), slug)


def safe_url(url: Column) -> Column:
    """Escaped URL if it is http(s) with a host, else ''."""
    ok = scheme(url).isin("http", "https") & (authority(url) != "") & ~_bad_brackets(authority(url))
    return F.when(ok, html_escape(url)).otherwise(F.lit(""))
