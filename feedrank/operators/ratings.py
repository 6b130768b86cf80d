"""Ratings: attach to postings, primary with fallback, cached state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.names import (
    alias_slug,
    contains_tokens,
    fold,
    name_tokens,
    normalize_name,
    similarity_of_normalized,
)
from ..functions.scores import finite_or_zero, score_display
from ..functions.text import blank_to_null, pct_encode
from ..ledger import Ledger
from ..schema import RATING
from .resolve import is_ignored, with_company_key
from .skew import ROWS_PER_SALT, hot_keys, salted_left_join


def apply_rating(df: DataFrame) -> DataFrame:
    """Fill the four rating columns of a posting from its ``rating`` struct."""
    has = F.col("rating").isNotNull()
    platform = F.coalesce(F.col("rating.platform"), F.lit("Ranking"))
    score = F.coalesce(F.col("rating.score"), F.lit(R.UNRATED))
    return df.withColumns(
        {
            # The stored number as it is; readers of it guard NaN themselves.
            "rating_score": F.when(has, F.coalesce(F.col("rating.numeric"), F.lit(0.0))).otherwise(F.lit(0.0)),
            "company_score": F.when(has, score_display(score, platform)),
            "company_reviews": F.when(has, F.coalesce(F.col("rating.reviews"), F.lit(""))),
            "rating_url": F.when(has, F.col("rating.url")),
        }
    ).drop("rating")


def join_ratings(
    postings: DataFrame, ratings: DataFrame, companies: DataFrame, rows_per_salt: int = ROWS_PER_SALT
) -> DataFrame:
    """Each posting gets the rating of its company.

    ``ratings``: (company_key, rating), one row per key. ``companies`` carries
    ``n_postings``, counted when the names were collected, so employers with
    more than ``rows_per_salt`` postings are split over several tasks.
    """
    hot = hot_keys(companies, "company_key", "n_postings", rows_per_salt)
    joined = salted_left_join(with_company_key(postings), ratings.select("company_key", "rating"), "company_key", hot, "dedup_key")
    return apply_rating(joined)


def unrated_fallback(company: Column) -> Column:
    """Fallback record for a company without evidence: a search link, no score."""
    return F.struct(
        F.lit(R.FALLBACK_PLATFORM).alias("platform"),
        F.lit(R.UNRATED).alias("score"),
        F.lit(0.0).alias("numeric"),
        F.lit(R.FALLBACK_UNRATED_REVIEWS).alias("reviews"),
        F.concat(F.lit(R.FALLBACK_SEARCH_PREFIX), pct_encode(company)).alias("url"),
        F.lit(None).cast("string").alias("matched_name"),
        F.lit(None).cast("boolean").alias("alias_match"),
        F.lit(None).cast("bigint").alias("checked_at"),
    ).cast(RATING)


def fallback_ratings(companies: DataFrame, evidence: DataFrame) -> DataFrame:
    """(company_key, rating): found evidence, else the unrated record.

    ``evidence``: (company_key, rating) as given by ``search_ratings``.
    """
    return companies.join(
        evidence.select("company_key", F.col("rating").cast(RATING).alias("_found")), "company_key", "left"
    ).select("company_key", F.coalesce("_found", unrated_fallback(F.col("company"))).alias("rating"))


def primary_else_fallback(companies: DataFrame, lookup: DataFrame, evidence: DataFrame) -> DataFrame:
    """Primary rating; the fallback only after a definite miss.

    An unavailable primary gives no rating here (and no fallback).
    """
    looked = companies.join(lookup, "company_key")
    hit = looked.filter(F.col("lookup_status") != "MISS").select("company_key", "lookup_status", "rating")
    missed = looked.filter(F.col("lookup_status") == "MISS").select("company_key", "company")
    second = fallback_ratings(missed, evidence).withColumn("lookup_status", F.lit("MISS"))
    return hit.unionByName(second)


# --- cached state -------------------------------------------------------------


def is_fresh(checked_at: Column, run_epoch: int, ttl: int = R.RECHECK_SECONDS) -> Column:
    at = F.coalesce(checked_at.try_cast("double"), F.lit(0.0))
    return (at > 0) & (F.lit(run_epoch) - at < ttl)


def is_trusted(norm: Column, entry: Column) -> Column:
    """Not a 5.0 with zero reviews, and still the same name (or an alias).

    ``norm`` is the normalised company name."""
    zero_reviews = F.coalesce(entry["reviews"], F.lit("")).rlike(r"(?iU)\b0\s+reviews?\b")
    suspicious = (finite_or_zero(entry["numeric"]) >= 5.0) & zero_reviews
    matched = blank_to_null(F.trim(entry["matched_name"]))
    by_name = matched.isNotNull() & ~F.coalesce(entry["alias_match"], F.lit(False))
    same = F.coalesce(
        similarity_of_normalized(norm, normalize_name(matched)) >= R.TRUST_SIMILARITY, F.lit(False))
    return ~suspicious & (~by_name | same)


def is_plausible_legacy(company: Column, key: Column, norm: Column, entry: Column) -> Column:
    """Old entry without a matched name: does its profile slug fit the company?"""
    slug = F.lower(F.regexp_extract(F.coalesce(entry["url"], F.lit("")), "/companies/([^/?#]+)", 1))
    folded = fold(slug)
    slug_words = F.regexp_extract_all(folded, F.lit("([a-z0-9]+)"))
    words_fit = contains_tokens(name_tokens(norm), slug_words)
    compact = F.regexp_replace(folded, "[^a-z0-9]", "")
    compact_fit = (key != "") & (F.contains(compact, key) | F.contains(key, compact))
    alias_fit = F.coalesce(alias_slug(company) == slug, F.lit(False))
    return is_trusted(norm, entry) & (slug != "") & (words_fit | compact_fit | alias_fit)


def _with_entries(companies: DataFrame, state: DataFrame | Ledger) -> DataFrame:
    """Companies with their cached entry; a ledger is read where its buckets lie."""
    if isinstance(state, Ledger):
        return state.lookup(companies, "_entry").withColumn("_entry", F.col("_entry").cast(RATING))
    entries = state.select("company_key", F.struct(*[f.name for f in RATING.fields]).cast(RATING).alias("_entry"))
    return companies.join(entries, "company_key", "left")


def _cache_view(companies: DataFrame, state: DataFrame | Ledger, run_epoch: int) -> DataFrame:
    """Companies with their cached entry and what may be done with it."""
    entry, company, key, norm = F.col("_entry"), F.col("company"), F.col("company_key"), F.col("company_norm")
    primary = F.lower(F.coalesce(entry["platform"], F.lit(""))) == R.PRIMARY_PLATFORM.lower()
    unnamed = blank_to_null(entry["matched_name"]).isNull()
    good = F.when(unnamed, is_plausible_legacy(company, key, norm, entry)).otherwise(is_trusted(norm, entry))
    return _with_entries(companies, state).withColumn(
        "_cache",
        F.when(is_ignored(norm), F.lit("ignored"))
        .when(entry.isNull(), F.lit("absent"))
        .when(primary & good, F.lit("usable"))
        .when(primary, F.lit("rejected"))
        .when(is_fresh(entry["checked_at"], run_epoch), F.lit("usable"))
        .otherwise(F.lit("stale")),
    )


def needs_lookup(companies: DataFrame, state: DataFrame | Ledger, run_epoch: int) -> DataFrame:
    """Companies the state cannot answer: only these reach the lookup joins."""
    return (
        _cache_view(companies, state, run_epoch)
        .filter(F.col("_cache").isin("absent", "rejected", "stale"))
        .select(*companies.columns)
    )


def decide(
    companies: DataFrame, state: DataFrame | Ledger, lookup: DataFrame, fallback: DataFrame, run_epoch: int
) -> DataFrame:
    """Rating of each company and what to write to the state.

    ``lookup``: (company_key, lookup_status, rating); ``fallback``:
    (company_key, rating), needed for misses without a cached entry. Returns
    (company_key, action, rating, entry); action is none, delete, replace,
    stamp or insert, entry the state row to write (null for none and delete).
    """
    now = F.lit(run_epoch).cast("bigint")
    stamped = lambda c: c.withField("checked_at", now)
    null = F.lit(None).cast(RATING)
    cache, status = F.col("_cache"), F.coalesce("lookup_status", F.lit("UNAVAILABLE"))
    kept = F.when(cache == "stale", F.col("_entry"))  # rejected entries are gone
    view = (
        _cache_view(companies, state, run_epoch)
        .join(lookup.select("company_key", "lookup_status", F.col("rating").cast(RATING).alias("_primary")),
              "company_key", "left")
        .join(fallback.select("company_key", F.col("rating").cast(RATING).alias("_second")),
              "company_key", "left")
    )
    action = (
        F.when(cache.isin("ignored", "usable"), F.lit("none"))
        .when(status == "UNAVAILABLE", F.when(cache == "rejected", F.lit("delete")).otherwise(F.lit("none")))
        .when(status == "HIT", F.lit("replace"))
        .when(cache == "stale", F.lit("stamp"))
        .otherwise(F.lit("insert"))
    )
    rating = (
        F.when(cache == "ignored", null)
        .when(cache == "usable", F.col("_entry"))
        .when(status == "UNAVAILABLE", kept)
        .when(status == "HIT", F.col("_primary"))
        .when(cache == "stale", stamped(F.col("_entry")))
        .otherwise(stamped(F.col("_second")))
    )
    return view.select("company_key", action.alias("action"), rating.alias("rating")).withColumn(
        "entry", F.when(F.col("action").isin("replace", "stamp", "insert"), F.col("rating"))
    )


def upsert(state: DataFrame, decisions: DataFrame) -> DataFrame:
    """Next state: written entries replace old ones, deleted ones go, rest stays."""
    cols = [f.name for f in RATING.fields]
    old = state.select("company_key", F.struct(*cols).cast(RATING).alias("_old"))
    merged = old.join(decisions.select("company_key", "action", "entry"), "company_key", "full")
    return (
        merged.withColumn("_e", F.coalesce("entry", F.when(F.coalesce("action", F.lit("none")) != "delete", F.col("_old"))))
        .filter(F.col("_e").isNotNull())
        .select("company_key", "_e.*")
    )


def changes_of(decisions: DataFrame) -> DataFrame:
    """What a ledger appends for the decisions of a run: written and deleted entries."""
    entry = F.col("entry").cast(RATING)
    return decisions.filter(F.col("action").isin("replace", "stamp", "insert", "delete")).select(
        "company_key", *[entry[f.name].alias(f.name) for f in RATING.fields], (F.col("action") == "delete").alias("deleted"))


def last_write(changes: DataFrame, order: str) -> DataFrame:
    """One row per company key: the latest change."""
    rest = [c for c in changes.columns if c != "company_key"]
    return (
        changes.groupBy("company_key")
        .agg(F.max_by(F.struct(*rest), order).alias("_last"))
        .select("company_key", "_last.*")
    )
