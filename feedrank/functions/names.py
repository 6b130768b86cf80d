"""Company-name expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .chars import literal_map, strip_accents
from .text import collapse_ws, quote_java, strip


def fold(name: Column) -> Column:
    """Accent-free lower-case text.

    The ``*_folded`` functions start from it: an operator that needs several
    forms of a name folds it once, in a column of its own.
    """
    return F.lower(strip_accents(name))


def key_of_folded(folded: Column) -> Column:
    return F.regexp_replace(folded, "[^a-z0-9]", "")


def company_key(name: Column) -> Column:
    """Lower-case ASCII letters and digits of the name."""
    return key_of_folded(fold(name))


def normalize_name(name: Column, suffixes: Sequence[str] = rules.SUFFIX_TOKENS) -> Column:
    """Comparable form: plain tokens without trailing legal or generic words."""
    return normalize_folded(fold(name), suffixes)


def normalize_folded(folded: Column, suffixes: Sequence[str] = rules.SUFFIX_TOKENS) -> Column:
    """``normalize_name`` on text that is already accent-free and lower-case."""
    raw = strip(folded)
    clean = F.replace(raw, F.lit("&"), F.lit(" and "))
    clean = F.regexp_replace(clean, rules.LEGAL_FORM, " ")
    tokens = F.trim(F.regexp_replace(clean, "[^a-z0-9]+", " "))
    if suffixes:
        tail = "|".join(quote_java(s) for s in suffixes)
        tokens = F.regexp_replace(tokens, rf"(?:(?:^| )(?:{tail}))+$", "")
    return F.coalesce(F.nullif(tokens, F.lit("")), raw)


def slugify(name: Column) -> Column:
    return slug_of_folded(fold(name))


def slug_of_folded(folded: Column) -> Column:
    clean = F.replace(folded, F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(clean, "[^a-z0-9]+", "-"), F.lit("-"))


def compact_name(name: Column) -> Column:
    """Key of the alias table: folded, with single spaces."""
    return collapse_ws(fold(name))


def alias_slug(name: Column, aliases: Mapping[str, str] = rules.ALIASES) -> Column:
    """Known slug of the name, else null. For an alias table use a join."""
    return F.try_element_at(literal_map(dict(aliases)), compact_name(name))


def name_tokens(normalized: Column) -> Column:
    """Distinct tokens of a normalised name."""
    return F.array_distinct(F.filter(F.split(normalized, r"(?U)\s+"), lambda t: t != ""))


def name_variants(
    name: Column,
    suffixes: Sequence[str] = rules.SUFFIX_TOKENS,
    stop: Sequence[str] = rules.VARIANT_STOP_TOKENS,
) -> Column:
    """Queries for a name, from the exact form to single words, in that order."""
    return variants_of(name, fold(name), suffixes, stop)


def variants_of(
    name: Column,
    folded: Column,
    suffixes: Sequence[str] = rules.SUFFIX_TOKENS,
    stop: Sequence[str] = rules.VARIANT_STOP_TOKENS,
) -> Column:
    original, folded = collapse_ws(name), collapse_ws(folded)
    normalized = normalize_folded(folded, suffixes)
    spell = lambda c: collapse_ws(F.replace(c, F.lit("&"), F.lit(" and ")))
    suffix_list = F.array(*[F.lit(s) for s in suffixes]) if suffixes else F.array().cast("array<string>")
    skip = F.array(*[F.lit(s) for s in (*suffixes, *stop)])

    plain = F.regexp_extract_all(folded, F.lit("([a-z0-9]+)"))
    tokens = F.filter(F.split(normalized, r"(?U)\s+"), lambda t: t != "")
    without_one = F.filter(
        F.transform(
            tokens,
            lambda t, i: F.when(
                F.array_contains(suffix_list, t),
                F.array_join(F.filter(tokens, lambda _, j: j != i), " "),
            ),
        ),
        lambda v: v.isNotNull(),
    )
    without_all = F.array_join(F.filter(tokens, lambda t: ~F.array_contains(suffix_list, t)), " ")
    single = F.filter(
        F.concat(plain, tokens),
        lambda t: (F.length(t) >= 3) & ~F.array_contains(skip, t),
    )
    candidates = F.concat(
        F.array(original, F.replace(original, F.lit("&"), F.lit("and")), normalized),
        without_one,
        F.array(without_all),
        single,
    )
    return F.array_distinct(F.filter(F.transform(candidates, spell), lambda v: v != ""))


def contains_tokens(sought: Column, candidate: Column) -> Column:
    """True if every token of ``sought`` is in ``candidate`` (token arrays)."""
    return F.size(F.array_except(sought, candidate)) == 0


def similarity_of_normalized(sought: Column, candidate: Column) -> Column:
    return (
        F.when((F.coalesce(sought, F.lit("")) == "") | (F.coalesce(candidate, F.lit("")) == ""), F.lit(0.0))
        .when(sought == candidate, F.lit(1.0))
        .when(contains_tokens(name_tokens(sought), name_tokens(candidate)), F.lit(0.85))
        .otherwise(F.lit(0.0))
    )


def similarity(sought: Column, candidate: Column) -> Column:
    """1.0 same name, 0.85 candidate holds every word sought, else 0.0."""
    return similarity_of_normalized(normalize_name(sought), normalize_name(candidate))
