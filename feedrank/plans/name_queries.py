"""Company names, directory lookup and rating state."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules as R
from ..functions import names as N, sql
from ..functions.text import collapse_ws
from ..ledger import Ledger
from ..operators import ratings, resolve
from ..session import materialize, scratch_path
from . import daily as D
from . import fixture as X
from . import oracle as O

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


SFX = O.POSTINGS.split("postings AS")[0].rstrip().rstrip(",")
C = [SFX, O.CUSTOMERS]


def employers(spark, sf):
    return X.table(spark, sf, "customer").select(
        "c_custkey", X.employer(F.col("c_custkey"), F.col("c_name")).alias("company"))


def _form(fn):
    return lambda spark, sf: employers(spark, sf).select("c_custkey", fn(F.col("company")).alias("value"))


for _name, _fn, _sql in (
    ("q_company_key", N.company_key, O.ckey("employer")),
    ("q_normalize_name", N.normalize_name, O.norm("employer")),
    ("q_slug", N.slugify, O.slug("employer")),
    ("q_compact_name", N.compact_name, f"trim(regexp_replace({O.folded('employer')}, '\\s+', ' ', 'g'))"),
):
    QUERIES[_name] = (_form(_fn), O.with_(C, f"SELECT c_custkey, {_sql} AS value FROM customers"))


@query("q_name_variants", O.with_(C, f"""SELECT c_custkey, v AS variant, min(i) AS place FROM (
 SELECT c_custkey, unnest(vs) AS v, generate_subscripts(vs, 1) AS i FROM (
  SELECT c_custkey, {O.variants("concat(employer, CASE WHEN c_custkey % 7 = 0 THEN ' & Services Group' ELSE '' END)")} AS vs
  FROM customers)) GROUP BY ALL"""))
def name_variants(spark, sf):
    # Places are compared after ranking, since repeats are dropped here.
    name = F.concat("company", F.when(F.col("c_custkey") % 7 == 0, F.lit(" & Services Group")).otherwise(F.lit("")))
    return employers(spark, sf).select("c_custkey", F.posexplode(N.name_variants(name)).alias("place", "variant")).select(
        "c_custkey", "variant", (F.col("place") + 1).alias("place"))


QUERIES["q_name_variants"] = (
    name_variants,
    O.with_(C, f"""SELECT c_custkey, variant, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY first) AS INTEGER) AS place
FROM (SELECT c_custkey, v AS variant, min(i) AS first FROM (
 SELECT c_custkey, unnest(vs) AS v, generate_subscripts(vs, 1) AS i FROM (
  SELECT c_custkey, {O.variants("concat(employer, CASE WHEN c_custkey % 7 = 0 THEN ' & Services Group' ELSE '' END)")} AS vs
  FROM customers)) GROUP BY ALL)"""),
)


def kept_companies(spark, sf):
    return materialize(resolve.companies_of(D.candidates(X.postings(spark, sf))), "companies")


BASE = [O.POSTINGS, O.PROFILES, O.PREFILTERED, O.DEDUPED, O.COMPANIES]


def _candidates_sql(k: int) -> str:
    return O.with_(BASE, f"""SELECT c.company_key, p.profile_id, {O.sim('c.n', 'p.pn')} AS similarity FROM companies c JOIN (
  SELECT *, {O.norm('profile_name')} AS pn FROM profiles WHERE review_count > 0) p
 ON ({O.sim('c.n', 'p.pn')}) >= 0.45 WHERE c.n NOT IN {O.IGNORED}
 QUALIFY row_number() OVER (PARTITION BY c.company_key ORDER BY {O.sim('c.n', 'p.pn')} DESC, p.profile_id) <= {k}""")


def _candidates(spark, sf, k, **opts):
    profiles = X.profiles(spark, sf).filter(F.col("review_count") > 0)
    return resolve.best_candidates(
        resolve.drop_ignored(kept_companies(spark, sf)), resolve.with_norm(profiles, "profile_name"), k=k, **opts
    ).select("company_key", "profile_id", "similarity")


@query("q_similarity_join", _candidates_sql(R.CANDIDATES_PER_QUERY))
def similarity_join(spark, sf):
    return _candidates(spark, sf, R.CANDIDATES_PER_QUERY)


@query("q_best_profile", _candidates_sql(1))
def best_profile(spark, sf):
    return _candidates(spark, sf, 1)


# One word sought, held by every profile.
@query("q_common_word", O.with_([O.EVERY_PROFILE], f"""SELECT lower(n_name) AS nation, p.profile_id,
 {O.sim(O.norm("'Customer'"), 'p.pn')} AS similarity FROM nation CROSS JOIN (
  SELECT profile_id, {O.norm('profile_name')} AS pn FROM profiles) p
 QUALIFY row_number() OVER (PARTITION BY n_name ORDER BY similarity DESC, p.profile_id) <= 8"""))
def common_word(spark, sf):
    wanted = resolve.with_norm(
        X.table(spark, sf, "nation").select(F.lower("n_name").alias("nation"), F.lit("Customer").alias("company")))
    return resolve.best_candidates(
        wanted, resolve.with_norm(X.profiles(spark, sf, gaps=False), "profile_name"), key="nation", cell_rows=100
    ).select("nation", "profile_id", "similarity")


_ALIAS_SQL = ", ".join(f"({O.q(k)}, {O.q(v)})" for k, v in R.ALIASES.items())
_NAMES = tuple(R.ALIASES)
_named = f"CASE WHEN c_custkey % 3 = 0 THEN ([{', '.join(O.q(n.title()) for n in _NAMES)}])[c_custkey % {len(_NAMES)} + 1] ELSE employer END"


@query("q_alias", O.with_([*C, f"alias(compact, slug) AS (VALUES {_ALIAS_SQL})"], f"""SELECT c_custkey, a.slug AS alias_slug
 FROM (SELECT c_custkey, {_named} AS company FROM customers) c LEFT JOIN alias a ON a.compact = {O.folded('c.company')}"""))
def alias(spark, sf):
    key = F.col("c_custkey")
    named = F.element_at(F.array(*[F.lit(n.title()) for n in _NAMES]), (key % len(_NAMES) + 1).cast("int"))
    rows = employers(spark, sf).withColumn("company", F.when(key % 3 == 0, named).otherwise(F.col("company")))
    return resolve.alias_lookup(rows).select("c_custkey", "alias_slug")


@query("q_ignored", O.with_([O.POSTINGS], f"SELECT job_id, company FROM postings WHERE {O.norm('company')} NOT IN {O.IGNORED}"))
def ignored(spark, sf):
    rows = resolve.with_norm(X.postings(spark, sf))
    return resolve.drop_ignored(rows).select("job_id", "company")


@query("q_slug_probe", O.with_([*BASE, O.DIRECTORY, O.lookup("SELECT * FROM companies")], f"""
SELECT company_key, slug, profile_name FROM (
 SELECT v.company_key, g.slug, g.profile_name, min(v.i * 4 + s.j) AS probe
 FROM variant_list v CROSS JOIN slug_suffix s JOIN pages g ON g.slug = {O.slug('concat(v.v, s.add_text)')}
 JOIN companies c ON c.company_key = v.company_key WHERE ({O.sim('c.n', 'g.pn')}) >= 0.45 GROUP BY 1, 2, 3)
QUALIFY row_number() OVER (PARTITION BY company_key ORDER BY probe) = 1"""))
def slug_probe(spark, sf):
    pages = resolve.index_directory(X.directory(spark, sf)).select("slug", "profile_name")
    return resolve.slug_probe(kept_companies(spark, sf), pages).select("company_key", "slug", "profile_name")


@query("q_primary_lookup", O.with_([*BASE, O.DIRECTORY, O.lookup("SELECT * FROM companies")], """
SELECT company_key, lookup_status, CASE WHEN lookup_status = 'HIT' THEN url END AS url,
 CASE WHEN lookup_status = 'HIT' THEN score END AS score FROM looked"""))
def primary_lookup(spark, sf):
    pages = materialize(resolve.index_directory(X.directory(spark, sf)), "directory")
    return resolve.primary_lookup(kept_companies(spark, sf), pages).select(
        "company_key", "lookup_status", "rating.url", "rating.score")


@query("q_primary_fallback", O.with_([*BASE, O.CUSTOMERS, O.DIRECTORY, O.EVIDENCE, O.lookup("SELECT * FROM companies"), O.SECOND],
                                     f"""SELECT l.company_key, l.lookup_status,
 CASE l.lookup_status WHEN 'HIT' THEN {O.q(R.PRIMARY_PLATFORM)} WHEN 'MISS' THEN d.platform END AS platform,
 CASE l.lookup_status WHEN 'HIT' THEN l.score WHEN 'MISS' THEN d.score END AS score,
 CASE l.lookup_status WHEN 'HIT' THEN l.url WHEN 'MISS' THEN d.url END AS url
 FROM looked l JOIN second d USING (company_key)"""))
def primary_fallback(spark, sf):
    companies = kept_companies(spark, sf)
    pages = materialize(resolve.index_directory(X.directory(spark, sf)), "directory")
    lookup = materialize(resolve.primary_lookup(companies, pages), "lookup")
    return ratings.primary_else_fallback(companies, lookup, X.evidence(spark, sf)).select(
        "company_key", "lookup_status", "rating.platform", "rating.score", "rating.url")


# --- state ------------------------------------------------------------------------

STATE_CHAIN = [O.POSTINGS, O.PROFILES, O.PREFILTERED, O.DEDUPED, O.COMPANIES, O.CUSTOMERS, O.DIRECTORY, O.STATE,
               O.EVIDENCE, O.CACHE, O.lookup(O.ASKED), O.SECOND, O.DECIDED]
_FIELDS = ", ".join(O.RATING_FIELDS)


def _decisions(spark, sf, state=None):
    companies = kept_companies(spark, sf)
    state = X.rating_state(spark, sf) if state is None else state
    pages = materialize(resolve.index_directory(X.directory(spark, sf)), "directory")
    asked = materialize(ratings.needs_lookup(companies, state, X.RUN_EPOCH), "asked")
    lookup = materialize(resolve.primary_lookup(asked, pages), "lookup")
    second = ratings.fallback_ratings(asked, X.evidence(spark, sf))
    return state, ratings.decide(companies, state, lookup, second, X.RUN_EPOCH)


@query("q_cache_decision", O.with_(STATE_CHAIN, f"SELECT company_key, action, {_FIELDS} FROM decided"))
def cache_decision(spark, sf):
    _, decisions = _decisions(spark, sf)
    return decisions.select("company_key", "action", *[f"rating.{f}" for f in O.RATING_FIELDS])


_UPSERTED = O.with_(STATE_CHAIN, f"""SELECT company_key, {_FIELDS} FROM state s
 WHERE company_key NOT IN (SELECT company_key FROM decided WHERE action <> 'none')
 UNION ALL SELECT company_key, {_FIELDS} FROM decided WHERE action IN ('replace', 'stamp', 'insert')""")


@query("q_cache_upsert", _UPSERTED)
def cache_upsert(spark, sf):
    return ratings.upsert(*_decisions(spark, sf))


@query("q_state_ledger", _UPSERTED)
def state_ledger(spark, sf):
    """The same next state from a compacted base and the delta of the run's changes."""
    ledger = Ledger(spark, scratch_path(spark, "ledger"))
    ledger.append(X.rating_state(spark, sf).withColumn("deleted", F.lit(False)))
    ledger.compact()
    ledger.append(ratings.changes_of(_decisions(spark, sf, ledger)[1]))
    return ledger.load()


@query("q_cache_trust", O.with_([*BASE, O.CUSTOMERS, O.STATE], f"""SELECT c.company_key, ({O.TRUSTED_SQL}) AS trusted,
 ({O.PLAUSIBLE_SQL}) AS plausible FROM companies c JOIN state s USING (company_key)"""))
def cache_trust(spark, sf):
    entries = X.rating_state(spark, sf)
    entry = F.struct(*[c for c in entries.columns if c != "company_key"])
    rows = kept_companies(spark, sf).join(entries.select("company_key", entry.alias("e")), "company_key")
    return rows.select(
        "company_key",
        ratings.is_trusted(F.col("company_norm"), F.col("e")).alias("trusted"),
        ratings.is_plausible_legacy(F.col("company"), F.col("company_key"), F.col("company_norm"), F.col("e")).alias("plausible"),
    )


@query("q_ttl", f"""SELECT event_id, checked_at, checked_at > 0 AND {X.RUN_EPOCH} - checked_at < {R.RECHECK_SECONDS} AS fresh
FROM (SELECT event_id, CASE WHEN user_id % 7 = 0 THEN 0 ELSE {X.RUN_EPOCH} - CAST(value * 10000 AS BIGINT) END AS checked_at
 FROM events)""")
def ttl(spark, sf):
    at = F.when(F.col("user_id") % 7 == 0, F.lit(0)).otherwise(
        F.lit(X.RUN_EPOCH) - F.round(F.col("value") * 10_000).cast("bigint"))
    return X.table(spark, sf, "events").select("event_id", at.cast("bigint").alias("checked_at")).select(
        "event_id", "checked_at", ratings.is_fresh(F.col("checked_at"), X.RUN_EPOCH).alias("fresh"))


@query("q_last_write", """SELECT company_key, numeric, event_id FROM (
 SELECT concat('user', user_id) AS company_key, value AS numeric, event_id FROM events)
 QUALIFY row_number() OVER (PARTITION BY company_key ORDER BY event_id DESC) = 1""")
def last_write(spark, sf):
    changes = X.table(spark, sf, "events").select(
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("company_key"),
        F.col("value").alias("numeric"), "event_id")
    return ratings.last_write(changes, "event_id")


@query("q_sql_functions", O.with_(C, f"""SELECT c_custkey, {O.ckey('employer')} AS key, {O.slug('employer')} AS slug, {O.norm('employer')} AS norm,
 {O.sim(O.norm('label'), O.norm('employer'))} AS similarity, concat('url:https://a.example/', c_custkey) AS dedup FROM customers"""))
def sql_functions(spark, sf):
    """The same functions called from SQL text."""
    sql.register(spark)
    rows = employers(spark, sf).withColumn("label", X.customer_label(F.regexp_replace("company", "(Customer [0-9]+).*", "$1")))
    return rows.selectExpr(
        "c_custkey", "company_key(company) AS key", "slugify(company) AS slug", "normalize_name(company) AS norm",
        "name_similarity(label, company) AS similarity",
        "dedup_key(concat('HTTPS://A.example/', c_custkey, '/?q=1'), '', '', company, '') AS dedup")
