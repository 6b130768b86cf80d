"""The daily run: postings to a ranked, enriched list."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..ledger import Ledger
from ..operators import classify, contacts, dedup, ranking, ratings, resolve
from ..operators.limits import limit_by_manifest, union_feeds
from ..operators.skew import ROWS_PER_SALT
from ..session import materialize
from ..sources import html_feeds, json_feeds
from ..sources.captures import accepted, broken_bodies, quarantine, with_request, with_run


@dataclass(frozen=True)
class Options:
    run_epoch: int
    rules: R.Rules = field(default_factory=R.Rules)
    min_score: float = R.MIN_SCORE
    enrich: bool = True
    enrich_top: int = 10
    rows_per_salt: int = ROWS_PER_SALT


def ingest(captures: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, what was set aside) of all feeds, run by run.

    Set aside are single items that break the schema, and whole bodies that are
    no JSON or lack their feed's list. Everything is parsed once and written,
    so that both results can be read without parsing again; an item is written
    as it came only where it is set aside.
    """
    requested = with_request(with_run(captures), manifest)
    parsed = [parse(requested) for parse in json_feeds.PARSERS.values()]
    for source, parse in html_feeds.PARSERS.items():
        rows = parse(requested)
        if source == "LinkedIn":
            rows = limit_by_manifest(rows, manifest.filter(F.col("source") == source))
        parsed.append(rows)
    items = union_feeds(*parsed)
    everything = materialize(items.withColumn("raw", F.when(F.col("reject_reason").isNotNull(), F.col("raw"))), "parsed")
    broken = [
        broken_bodies(requested.filter(F.col("source") == source), path)
        for source, path in json_feeds.LIST_PATHS.items()
    ]
    return accepted(everything), union_feeds(quarantine(everything), *broken)


def candidates(postings: DataFrame, rules: R.Rules = R.DEFAULT_RULES) -> DataFrame:
    """Postings that pass the rules, one per identity, with their company key."""
    return resolve.with_company_key(dedup.first_seen(classify.prefilter(postings, rules)))


def rate(
    postings: DataFrame, state: DataFrame | Ledger, directory: DataFrame, evidence: DataFrame, options: Options
) -> tuple[DataFrame, DataFrame]:
    """(postings with ratings, next rating state; of a ledger, the changes to append).

    Only companies the state cannot answer reach the directory joins, and only
    their misses the fallback. ``directory`` is indexed. Frames that several
    joins read are written once; they hold one row per company.
    """
    companies = materialize(resolve.companies_of(postings), "companies")
    asked = materialize(ratings.needs_lookup(companies, state, options.run_epoch), "asked")
    lookup = materialize(resolve.primary_lookup(asked, directory), "lookup")
    missed = asked.join(lookup.filter(F.col("lookup_status") == "MISS").select("company_key"), "company_key", "left_semi")
    second = ratings.fallback_ratings(missed, evidence)
    decisions = materialize(ratings.decide(companies, state, lookup, second, options.run_epoch), "decisions")
    rated = ratings.join_ratings(postings, decisions, companies, options.rows_per_salt)
    return rated, ratings.changes_of(decisions) if isinstance(state, Ledger) else ratings.upsert(state, decisions)


def daily(
    postings: DataFrame,
    state: DataFrame | Ledger,
    directory: DataFrame,
    evidence: DataFrame,
    contact_directory: DataFrame,
    profile: DataFrame,
    options: Options,
) -> tuple[DataFrame, DataFrame]:
    """(ranked postings, next rating state; of a ledger, the changes to append)."""
    kept = materialize(candidates(postings, options.rules), "candidates")
    pages = materialize(resolve.index_directory(directory), "directory")
    rated, next_state = rate(kept, state, pages, evidence, options)
    eligible = rated.filter(
        classify.is_eligible(F.col("category"), F.col("rating_score"), options.min_score))
    ranked = ranking.ranked(eligible)
    wanted = contacts.contacts_for(contact_directory, ranked.filter(F.col("rank") <= options.enrich_top))
    return (
        contacts.enrich_top(ranked, contacts.best_contact(wanted), profile, options.enrich_top, options.enrich),
        next_state,
    )
