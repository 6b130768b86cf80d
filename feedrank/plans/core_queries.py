"""Rules, keys, dedup, ranking and the daily chain on the fixture postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.scores import finite_or_zero
from ..functions.text import matches_any
from ..session import materialize
from ..operators import classify, dedup, limits, ranking, ratings, resolve
from . import daily as D
from . import fixture as X
from . import oracle as O

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


P = O.POSTINGS


@query("q_entry_level", O.with_([P], f"SELECT job_id, title FROM postings WHERE {O.ENTRY}"))
def entry_level(spark, sf):
    return X.postings(spark, sf).filter(classify.has_entry_marker(F.col("title"))).select("job_id", "title")


@query("q_exclusion", O.with_([P], f"SELECT job_id, title, company FROM postings WHERE {O.EXCLUDED}"))
def exclusion(spark, sf):
    return X.postings(spark, sf).filter(classify.is_excluded(F.col("title"), F.col("company"))).select(
        "job_id", "title", "company")


@query("q_classify", O.with_([P], f"""SELECT job_id, coalesce({O.TOPIC}, 'none') AS topic,
 {O.has('title', R.AI_PATTERNS)} AS title_ai, {O.has('title', R.SOFTWARE_PATTERNS)} AS title_swe FROM postings"""))
def classification(spark, sf):
    return X.postings(spark, sf).select(
        "job_id",
        F.coalesce(classify.topic(F.col("title"), F.col("tags")), F.lit("none")).alias("topic"),
        matches_any(F.col("title"), R.AI_PATTERNS).alias("title_ai"),
        matches_any(F.col("title"), R.SOFTWARE_PATTERNS).alias("title_swe"),
    )


@query("q_prefilter", O.with_([P, O.PREFILTERED], f"""SELECT job_id, title, topic, {O.category('topic')} AS category,
 {O.q(R.SENIORITY_LABEL)} AS seniority FROM prefiltered"""))
def prefilter(spark, sf):
    return classify.prefilter(X.postings(spark, sf)).select("job_id", "title", "topic", "category", "seniority")


@query("q_fallback_key", O.with_([P], f"SELECT job_id, {O.DEDUP_KEY} AS dedup_key FROM postings"))
def fallback_key(spark, sf):
    return dedup.with_dedup_key(X.postings(spark, sf)).select("job_id", "dedup_key")


@query("q_first_seen", O.with_([P, O.PREFILTERED, O.DEDUPED],
                               "SELECT dedup_key, job_id, title, company, category FROM deduped"))
def first_seen(spark, sf):
    return D.candidates(X.postings(spark, sf)).select("dedup_key", "job_id", "title", "company", "category")


@query("q_feed_limit", O.with_([P], """SELECT source, query_ordinal, item_ordinal, job_id FROM postings
 QUALIFY row_number() OVER (PARTITION BY source, query_ordinal ORDER BY item_ordinal) <= 40"""))
def feed_limit(spark, sf):
    return limits.limit_per_request(X.postings(spark, sf), 40).select(
        "source", "query_ordinal", "item_ordinal", "job_id")


_LIMITS = [(i, f"feed_{i}", None, 10 * (i + 1), None) for i in range(6)]


@query("q_manifest_limit", O.with_([P], """SELECT source, item_ordinal FROM postings
 QUALIFY query_ordinal = 6 OR row_number() OVER (PARTITION BY source, query_ordinal ORDER BY item_ordinal)
  <= 10 * (query_ordinal + 1)"""))
def manifest_limit(spark, sf):
    requests = spark.createDataFrame(
        [(i, s, q, n, p) for i, s, q, n, p in _LIMITS],
        "query_ordinal int, source string, query string, row_limit int, base_location string")
    return limits.limit_by_manifest(X.postings(spark, sf), requests).select("source", "item_ordinal")


@query("q_status_gate", """WITH pages_of AS (
 SELECT event_type AS source, CAST(user_id % 50 AS INTEGER) AS query_ordinal, event_id AS page_no,
  CASE WHEN event_id % 211 = 0 THEN 429 ELSE 200 END AS status FROM events),
stops AS (SELECT source, query_ordinal, min(page_no) AS stop FROM pages_of WHERE status <> 200 GROUP BY 1, 2)
SELECT p.source, p.query_ordinal, p.page_no FROM pages_of p LEFT JOIN stops s
 ON p.source = s.source AND p.query_ordinal = s.query_ordinal
 WHERE p.status = 200 AND (s.stop IS NULL OR p.page_no < s.stop)""")
def status_gate(spark, sf):
    captured = X.table(spark, sf, "events").select(
        F.col("event_type").alias("source"),
        (F.col("user_id") % 50).cast("int").alias("query_ordinal"),
        F.col("event_id").alias("page_no"),
        F.when(F.col("event_id") % 211 == 0, F.lit(429)).otherwise(F.lit(200)).alias("status"),
    )
    return limits.ok_pages(captured).select("source", "query_ordinal", "page_no")


@query("q_union_feeds", O.with_([P], """SELECT source, count(*) AS n, min(item_ordinal) AS first_item,
 max(item_ordinal) AS last_item FROM postings GROUP BY source"""))
def union_feeds(spark, sf):
    rows = X.postings(spark, sf)
    feeds = [rows.filter(F.col("query_ordinal") == i) for i in range(7)]
    return limits.union_feeds(feeds[0].drop("tags"), *feeds[1:]).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("item_ordinal").alias("first_item"),
        F.max("item_ordinal").alias("last_item"),
    )


@query("q_topic_docs", rf"""SELECT doc_id, {{ai}} AS is_ai, {{swe}} AS is_swe, {{entry}} AS is_entry, {{excl}} AS is_excluded
FROM documents""".format(**{
    k: "regexp_matches(text, " + O.q(r"(?i)(?:^|[^\p{L}\p{N}_])(?:" + "|".join(
        p.removeprefix(r"\b").removesuffix(r"\b") for p in pats) + r")(?:$|[^\p{L}\p{N}_])") + ")"
    for k, pats in (("ai", R.AI_PATTERNS), ("swe", R.SOFTWARE_PATTERNS), ("entry", R.ENTRY_PATTERNS),
                    ("excl", R.EXCLUDE_PATTERNS))}))
def topic_docs(spark, sf):
    text = F.col("text")
    return X.table(spark, sf, "documents", "doc_id", "text").select(
        "doc_id",
        matches_any(text, R.AI_PATTERNS).alias("is_ai"),
        matches_any(text, R.SOFTWARE_PATTERNS).alias("is_swe"),
        matches_any(text, R.ENTRY_PATTERNS).alias("is_entry"),
        matches_any(text, R.EXCLUDE_PATTERNS).alias("is_excluded"),
    )


# --- the chain with ratings --------------------------------------------------------


def rated_by_profile(spark, sf, only_reviewed: bool = True) -> DataFrame:
    """Postings joined to the most similar profile only (no cached state)."""
    kept = materialize(D.candidates(X.postings(spark, sf)), "candidates")
    companies = materialize(resolve.companies_of(kept), "companies")
    profiles = X.profiles(spark, sf).filter(F.col("review_count") > 0)
    best = resolve.best_candidates(
        resolve.drop_ignored(companies), resolve.with_norm(profiles, "profile_name"), k=1)
    rating = F.struct(
        F.lit(R.PRIMARY_PLATFORM).alias("platform"),
        F.when(F.isnan("numeric_score"), F.lit(R.UNRATED)).otherwise(
            F.format_string("%.1f/5", "numeric_score")).alias("score"),
        F.col("numeric_score").alias("numeric"),
        F.concat(F.col("review_count").cast("string"), F.lit(" Reviews")).alias("reviews"),
        F.lit(None).cast("string").alias("url"),
    )
    found = best.join(profiles, "profile_id").select("company_key", rating.alias("rating"))
    return ratings.join_ratings(kept, found, companies)


BEST = f"""
best AS (
 SELECT c.company_key, p.profile_id, p.numeric_score, p.review_count FROM companies c JOIN (
  SELECT *, {O.norm('profile_name')} AS pn FROM profiles WHERE review_count > 0) p
 ON ({O.sim('c.n', 'p.pn')}) >= 0.45 WHERE c.n NOT IN {O.IGNORED}
 QUALIFY row_number() OVER (PARTITION BY c.company_key ORDER BY {O.sim('c.n', 'p.pn')} DESC, p.profile_id) = 1)"""
BY_PROFILE = [P, O.PROFILES, O.PREFILTERED, O.DEDUPED, O.COMPANIES, BEST, f"""
rated AS (
 SELECT p.*, coalesce(b.numeric_score, 0.0) AS rating_score, CASE WHEN b.company_key IS NULL THEN NULL
   WHEN isnan(b.numeric_score) THEN concat('🔍 ', {O.q(R.PRIMARY_PLATFORM)})
   ELSE concat('★ ', printf('%.1f/5', b.numeric_score), ' (', {O.q(R.PRIMARY_PLATFORM)}, ')') END AS company_score,
  CASE WHEN b.company_key IS NOT NULL THEN concat(b.review_count, ' Reviews') END AS company_reviews,
  CAST(NULL AS VARCHAR) AS rating_url
 FROM deduped p LEFT JOIN best b ON b.company_key = {O.ckey('p.company')})"""]


@query("q_rating_join", O.with_(BY_PROFILE, f"""SELECT job_id, company, {O.FINITE} AS rating_score,
 isnan(rating_score) AS is_nan FROM rated"""))
def rating_join(spark, sf):
    return rated_by_profile(spark, sf).select(
        "job_id", "company", finite_or_zero(F.col("rating_score")).alias("rating_score"),
        F.isnan("rating_score").alias("is_nan"))


@query("q_rating_display", O.with_(BY_PROFILE, "SELECT job_id, company_score, company_reviews FROM rated"))
def rating_display(spark, sf):
    return rated_by_profile(spark, sf).select("job_id", "company_score", "company_reviews")


@query("q_eligible", O.with_([*BY_PROFILE, O.ELIGIBLE], f"SELECT job_id, category, {O.FINITE} AS rating_score FROM eligible"))
def eligible(spark, sf):
    rows = rated_by_profile(spark, sf)
    return rows.filter(classify.is_eligible(F.col("category"), F.col("rating_score"))).select(
        "job_id", "category", finite_or_zero(F.col("rating_score")).alias("rating_score"))


@query("q_ranked", O.with_([*BY_PROFILE, O.ELIGIBLE, O.RANKED],
                           f"SELECT rank, job_id, company, title, {O.FINITE} AS rating_score FROM ranked"))
def ranked(spark, sf):
    rows = rated_by_profile(spark, sf).filter(classify.is_eligible(F.col("category"), F.col("rating_score")))
    return ranking.ranked(rows).select(
        "rank", "job_id", "company", "title", finite_or_zero(F.col("rating_score")).alias("rating_score"))


@query("q_top_n", O.with_([*BY_PROFILE, O.ELIGIBLE, O.RANKED], "SELECT job_id, company, title FROM ranked WHERE rank <= 10"))
def top_n(spark, sf):
    rows = rated_by_profile(spark, sf).filter(classify.is_eligible(F.col("category"), F.col("rating_score")))
    return ranking.top_n(rows, 10).select("job_id", "company", "title")


@query("q_daily", O.with_(O.FULL_CHAIN, f"""SELECT rank, job_id, title, company, category, {O.FINITE} AS rating_score,
 company_score, company_reviews, rating_url FROM ranked"""))
def daily(spark, sf):
    rows, _ = D.daily(
        X.postings(spark, sf), X.rating_state(spark, sf), X.directory(spark, sf), X.evidence(spark, sf),
        X.contact_directory(spark, sf), X.person(spark), D.Options(X.RUN_EPOCH))
    return rows.select(
        "rank", "job_id", "title", "company", "category",
        finite_or_zero(F.col("rating_score")).alias("rating_score"),
        "company_score", "company_reviews", "rating_url")
