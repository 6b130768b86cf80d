"""Company-name resolution: name similarity, aliases, derived slugs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.names import (
    alias_slug,
    fold,
    key_of_folded,
    name_tokens,
    normalize_folded,
    similarity_of_normalized,
    slug_of_folded,
    variants_of,
)
from ..functions.text import collapse_ws
from ..schema import ORDER_COLUMNS
from ..session import materialize
from .containment import CELL_ROWS, first_rows, holders
from .dedup import first_by


def companies_of(postings: DataFrame, order: Sequence[str] = ORDER_COLUMNS) -> DataFrame:
    """First display name of each key: (company_key, company, n_postings,
    company_folded, company_norm).

    Names without any ASCII letter or digit share the empty key; they would
    share one rating too, so the empty key is left out.
    """
    return (
        with_company_key(postings)
        .filter(F.col("company_key") != "")
        .groupBy("company_key")
        .agg(
            F.min_by(F.struct("company", "company_folded"), F.struct(*order)).alias("c"),
            F.count(F.lit(1)).alias("n_postings"),
        )
        .select(
            "company_key",
            collapse_ws(F.col("c.company")).alias("company"),
            "n_postings",
            F.col("c.company_folded").alias("company_folded"),
            normalize_folded(F.col("c.company_folded")).alias("company_norm"),
        )
    )


def with_company_key(df: DataFrame) -> DataFrame:
    """Add ``company_folded`` and ``company_key``, unless they are there."""
    if "company_key" in df.columns:
        return df
    return df.withColumn("company_folded", fold(F.col("company"))).withColumn(
        "company_key", key_of_folded(F.col("company_folded")))


def with_norm(df: DataFrame, name: str = "company") -> DataFrame:
    """Add ``<name>_folded`` and ``<name>_norm``, computed once and reused."""
    return df.withColumn(f"{name}_folded", fold(F.col(name))).withColumn(
        f"{name}_norm", normalize_folded(F.col(f"{name}_folded")))


def is_ignored(norm: Column, ignored: Sequence[str] = R.IGNORED_COMPANIES) -> Column:
    """The normalised name is that of an ignored one (short ASCII list)."""
    names = [normalize_folded(F.lower(F.lit(n))) for n in ignored]
    return F.coalesce(norm.isin(*names), F.lit(True))


def drop_ignored(companies: DataFrame, ignored: Sequence[str] = R.IGNORED_COMPANIES) -> DataFrame:
    return companies.filter(~is_ignored(F.col("company_norm"), ignored))


def alias_lookup(df: DataFrame, aliases=None) -> DataFrame:
    """Add ``alias_slug``. ``aliases``: a mapping (default the known list)."""
    return df.withColumn("alias_slug", alias_slug(F.col("company"), aliases or R.ALIASES))


def best_candidates(
    sought: DataFrame,
    candidates: DataFrame,
    key: str = "company_key",
    norm: str = "company_norm",
    candidate_id: str = "profile_id",
    candidate_norm: str = "profile_name_norm",
    k: int = R.CANDIDATES_PER_QUERY,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """The ``k`` most similar candidates of each sought name.

    Both sides carry normalised names (see ``with_norm``). Returns (key,
    candidate_id, similarity, place). Equal names score 1.0; a
    candidate that holds every word sought scores 0.85; nothing else matches.
    Ties go to the smaller candidate id.

    Names are written once with their words. Each normalised form needs its k
    first candidates only; containment is a walk over a prefix trie, see
    ``containment``. Exact, and no pairs of a whole group are formed.
    """
    cid = F.col(candidate_id)
    wanted = materialize(sought.select(key, F.col(norm).alias("_norm")), "sought-names")
    names = wanted.filter(F.col("_norm") != "").select(F.col("_norm").alias("name")).distinct()
    near = materialize(
        first_rows(
            candidates.select(cid.alias("id"), F.col(candidate_norm).alias("name")).filter(F.col("name") != ""), "name", k, F.col("id")
        ).select("id", "name", name_tokens(F.col("name")).alias("words")),
        "candidate-names",
    )
    exact = names.join(near, "name").select("name", "id", F.lit(1.0).alias("similarity"))
    held = holders(names.withColumn("words", name_tokens(F.col("name"))), near.select("id", "words"), k, cell_rows)
    scored = (
        exact.unionByName(held.withColumn("similarity", F.lit(0.85)))
        .groupBy("name", "id")
        .agg(F.max("similarity").alias("similarity"))
    )
    best = first_rows(scored, "name", k, F.desc("similarity"), F.col("id"))
    return wanted.join(best, F.col("_norm") == F.col("name")).select(
        key, F.col("id").alias(candidate_id), "similarity", F.col("_n").alias("place"))


def derived_slugs(companies: DataFrame, suffixes: Sequence[str] = R.SLUG_SUFFIXES) -> DataFrame:
    """(company_key, company_norm, slug, probe): slugs guessed from name variants, in order."""
    folded = F.col("company_folded")
    # A variant of the folded name has the slug of the same variant of the name.
    guesses = F.flatten(
        F.transform(
            variants_of(folded, folded),
            lambda v: F.array(*[v if s == "" else F.concat(v, F.lit(f" {s.lower()}")) for s in suffixes]),
        )
    )
    slugs = F.array_distinct(F.filter(F.transform(guesses, slug_of_folded), lambda s: s != ""))
    return companies.select("company_key", "company_norm", F.posexplode(slugs).alias("probe", "slug"))


def _similar() -> Column:
    return similarity_of_normalized(F.col("company_norm"), F.col("profile_name_norm")) >= R.SIMILARITY_GATE


def slug_probe(companies: DataFrame, profiles: DataFrame) -> DataFrame:
    """First derived slug that is a profile with a similar enough name.

    ``profiles``: (slug, profile_name, ...), one row per slug.
    """
    hits = derived_slugs(companies).join(with_norm(profiles, "profile_name"), "slug").filter(_similar())
    return first_by(
        hits.drop("company_norm", "profile_name_folded", "profile_name_norm"), ["company_key"], ["probe"])


_ALIAS_PROBE = 1_000_000
_DERIVED_PROBE = 1_000_001


def index_directory(directory: DataFrame) -> DataFrame:
    """One page per slug, with the normalised profile name.

    ``directory``: (profile_id, slug, profile_name, status, score, numeric,
    reviews, url). The result does not depend on the postings: store it and
    rebuild it when the directory changes.
    """
    pages = first_by(directory, ["slug"], ["profile_id"])
    return with_norm(pages, "profile_name").drop("profile_name_folded")


def primary_lookup(companies: DataFrame, directory: DataFrame, aliases=None) -> DataFrame:
    """Look every company up in the primary directory.

    ``directory``: indexed profile pages, see ``index_directory``. Probe order per company: similar
    names, the alias slug, derived slugs; the first valid profile wins. A page
    that did not answer (403, 429, 5xx) before that makes the lookup
    UNAVAILABLE, which is not a miss. Returns (company_key, lookup_status,
    rating).
    """
    pages = directory
    readable = pages.filter(F.col("status") == 200)
    similar = (
        best_candidates(companies, readable)
        .join(readable.select("profile_id", "slug"), "profile_id")
        .select("company_key", "slug", F.col("place").alias("probe"), F.lit(False).alias("allow_alias"))
    )
    known = (
        alias_lookup(companies, aliases)
        .filter(F.col("alias_slug").isNotNull())
        .select("company_key", F.col("alias_slug").alias("slug"),
                F.lit(_ALIAS_PROBE).alias("probe"), F.lit(True).alias("allow_alias"))
    )
    derived = derived_slugs(companies).select(
        "company_key", "slug", (F.col("probe") + _DERIVED_PROBE).alias("probe"), F.lit(False).alias("allow_alias")
    )
    # A slug reached twice keeps the place and the alias flag of the first time.
    probes = (
        similar.unionByName(known)
        .unionByName(derived)
        .groupBy("company_key", "slug")
        .agg(F.min(F.struct("probe", "allow_alias")).alias("p"))
        .select("company_key", "slug", "p.*")
    )
    down = F.col("status").isin(403, 429) | (F.col("status") >= 500)
    valid = (
        (F.col("status") == 200)
        & F.col("profile_name").isNotNull()
        & (F.col("allow_alias") | _similar())
    )
    outcome = F.when(down, F.lit("UNAVAILABLE")).when(valid, F.lit("HIT"))
    rating = F.struct(
        F.lit(R.PRIMARY_PLATFORM).alias("platform"),
        "score",
        "numeric",
        "reviews",
        "url",
        F.col("profile_name").alias("matched_name"),
        F.col("allow_alias").alias("alias_match"),
        F.lit(None).cast("bigint").alias("checked_at"),
    )
    found = (
        probes.join(companies.select("company_key", "company_norm"), "company_key")
        .join(pages, "slug")
        .withColumn("lookup_status", outcome)
        .filter(F.col("lookup_status").isNotNull())
        .withColumn("rating", F.when(F.col("lookup_status") == "HIT", rating))
        .groupBy("company_key")
        .agg(F.min_by(F.struct("lookup_status", "rating"), "probe").alias("r"))
        .select("company_key", "r.*")
    )
    return companies.select("company_key").join(found, "company_key", "left").withColumn(
        "lookup_status", F.coalesce("lookup_status", F.lit("MISS"))
    )
