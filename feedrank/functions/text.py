"""Text expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_pattern(patterns: Iterable[str]) -> str:
    """One alternation for a whole rule set: one regex scan per column.

    ``U`` makes case folding, \\w, \\d, \\s and \\b follow Unicode. A word boundary
    that all patterns share is tested once per position, not once per pattern.
    """
    patterns = list(patterns)
    head = tail = ""
    if all(p.startswith(r"\b") for p in patterns):
        head, patterns = r"\b", [p[2:] for p in patterns]
    if all(p.endswith(r"\b") and not p.endswith(r"\\b") for p in patterns):
        tail, patterns = r"\b", [p[:-2] for p in patterns]
    return f"(?iU){head}(?:" + "|".join(patterns) + f"){tail}"


def matches_any(text: Column, patterns: Iterable[str]) -> Column:
    """True if any pattern is found, ignoring case; null text is ''."""
    patterns = tuple(patterns)
    if not patterns:
        return F.lit(False)
    return F.coalesce(text, F.lit("")).rlike(any_pattern(patterns))


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """True if any word is a substring (case as given)."""
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found


def quote_java(text: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", text)


def let(value: Column, body) -> Column:
    """``body(value)`` with value computed once.

    A column that a lambda refers to is no substitute: the optimizer may put its
    expression into the lambda, which then computes it for every element.
    """
    return F.get(F.transform(F.array(value), body), 0)


def strip(col: Column) -> Column:
    """Unicode-aware trim of both ends."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def collapse_ws(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"(?U)\s+", " "))


def alnum_only(col: Column) -> Column:
    """Keep letters and numbers of any script."""
    return F.regexp_replace(col, r"[^\p{L}\p{N}]", "")


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def as_list(value: Column) -> Column:
    """VARIANT to array<string>: list kept, scalar wrapped, null and '' empty."""
    scalar = blank_to_null(F.try_variant_get(value, "$", "string"))
    return F.coalesce(
        F.try_variant_get(value, "$", "array<string>"),
        F.when(scalar.isNotNull(), F.array(scalar)),
        F.array().cast("array<string>"),
    )


def join_list(value: Column) -> Column:
    """VARIANT list or scalar to text, lists joined with ', '."""
    return F.coalesce(
        F.array_join(F.try_variant_get(value, "$", "array<string>"), ", "),
        F.try_variant_get(value, "$", "string"),
    )


def truthy(value: Column, words: Iterable[str] = ("1", "true", "yes", "remote")) -> Column:
    """Loose boolean of a text column."""
    return F.coalesce(F.lower(strip(value)).isin(*words), F.lit(False))


FLAG_WORDS = ("true", "1", "yes", "on")


def pct_encode(col: Column) -> Column:
    """Percent-encoding with no safe characters except letters, digits and _.-~"""
    out = F.url_encode(col)
    for found, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(found), F.lit(wanted))
    return out


def html_escape(col: Column) -> Column:
    out = col
    for found, wanted in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(found), F.lit(wanted))
    return out


def title_case(col: Column) -> Column:
    """First letter of each alphabetic run upper, the rest lower."""
    runs = F.regexp_extract_all(col, F.lit(r"(\p{L}+|[^\p{L}]+)"))
    return F.array_join(F.transform(runs, lambda r: F.initcap(r)), "")


def filled(template: str, **values: Column) -> Column:
    """The template with its ``{name}`` places filled; null when a value is null."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])
