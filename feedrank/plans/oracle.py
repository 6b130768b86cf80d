"""SQL statements of the fixture frames and of the expected results.

Written against the driver tables for another SQL engine, independently of the
DataFrame operators, to check them.
"""

from __future__ import annotations

from .. import rules as R
from . import fixture as X


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rx(patterns) -> str:
    return q("(?i)(?:" + "|".join(patterns) + ")")


def has(col: str, patterns) -> str:
    return f"regexp_matches(coalesce({col}, ''), {rx(patterns)})"


def any_of(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(w)})" for w in words) + ")"


def inlist(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


_t = ", ".join(f"({i}, {q(t)}, {q(g)})" for i, (t, g) in enumerate(X.TITLES))
_l = ", ".join(f"({i}, {q(p)}, {q(m)})" for i, (p, m) in enumerate(X.PLACES))
_s = ", ".join(f"({i}, {q(s)})" for i, s in enumerate(X.SUFFIXES))

POSTINGS = f"""
t(i, title, tag) AS (VALUES {_t}),
l(i, location, modality) AS (VALUES {_l}),
sfx(i, s) AS (VALUES {_s}),
postings AS (
 SELECT CAST(o.o_orderkey % 7 AS INTEGER) AS query_ordinal, o.o_orderkey AS item_ordinal,
  concat('feed_', CAST(o.o_orderkey % 7 AS VARCHAR)) AS source,
  CAST(o.o_orderkey AS VARCHAR) AS job_id, t.title, t.tag,
  CASE WHEN o.o_custkey % 41 = 0 THEN 'Confidencial' WHEN o.o_custkey % 43 = 0 THEN 'N/A'
       ELSE concat(replace(c.c_name, '#', ' '), sfx.s) END AS company,
  l.location, l.modality,
  CASE WHEN o.o_orderkey % 97 = 0 THEN '' ELSE concat(
   CASE WHEN o.o_orderkey % 2 = 0 THEN 'https://Jobs.Example' ELSE 'HTTPS://jobs.example' END, '/p/',
   CAST(o.o_orderkey - o.o_orderkey % 3 AS VARCHAR),
   CASE o.o_orderkey % 3 WHEN 0 THEN '/' WHEN 1 THEN '?ref=x' ELSE '' END) END AS job_url,
  o.o_orderdate AS captured_at
 FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
 JOIN t ON o.o_orderkey % 16 = t.i JOIN l ON o.o_orderkey % 5 = l.i JOIN sfx ON o.o_custkey % 5 = sfx.i)"""

PROFILES = """
profiles AS (
 SELECT c_custkey AS profile_id,
  concat(upper(replace(c_name, '#', ' ')), CASE WHEN c_custkey % 3 = 0 THEN ' Soluções' ELSE '' END) AS profile_name,
  CASE WHEN c_custkey % 50 = 1 THEN CAST('NaN' AS DOUBLE)
       ELSE CAST(10 + c_custkey % 41 AS DOUBLE) / 10 END AS numeric_score,
  c_custkey % 150 AS review_count
 FROM customer WHERE c_custkey % 4 <> 3)"""

EVERY_PROFILE = PROFILES.replace(" WHERE c_custkey % 4 <> 3", "")

EXCLUDED = f"({has('company', R.BLOCKED_EMPLOYER_PATTERNS)} OR {has('title', R.BLOCKED_EMPLOYER_PATTERNS)} OR {has('title', R.EXCLUDE_PATTERNS)})"
ENTRY = has("title", R.ENTRY_PATTERNS)
TOPIC = f"""CASE WHEN {has('title', R.AI_PATTERNS)} THEN 'AI' WHEN {has('title', R.SOFTWARE_PATTERNS)} THEN 'SWE'
 WHEN {has('tag', R.AI_PATTERNS)} THEN 'AI' WHEN {has('tag', R.SOFTWARE_PATTERNS)} THEN 'SWE' END"""


def category(topic: str) -> str:
    return f"CASE WHEN {topic} = 'AI' THEN {q(R.CATEGORY_AI)} ELSE {q(R.CATEGORY_SWE)} END"


URL_SPLIT = q(r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?//([^/?#]*)([^?#]*)")


def url_part(url: str, i: int) -> str:
    return f"regexp_extract(trim({url}), {URL_SPLIT}, {i})"


def canonical(url: str) -> str:
    s, a, p = (url_part(url, i) for i in (1, 2, 3))
    return (f"CASE WHEN {a} <> '' AND {p} <> '' THEN concat(CASE WHEN {s} = '' THEN '//' ELSE concat(lower({s}), '://') END, "
            f"lower({a}), regexp_replace({p}, '/+$', '')) END")


def alnum(x: str) -> str:
    return rf"regexp_replace(replace(lower({x}), 'ß', 'ss'), '[^\p{{L}}\p{{N}}]', '', 'g')"


DEDUP_KEY = (f"coalesce(concat('url:', nullif({canonical('job_url')}, '')), concat('job:', {alnum('source')}, ':', "
             f"{alnum('job_id')}, ':', {alnum('company')}, ':', {alnum('title')}))")
# concat() ignores nulls in this engine, so the key is chosen by the URL alone.
DEDUP_KEY = (f"CASE WHEN {canonical('job_url')} IS NOT NULL THEN concat('url:', {canonical('job_url')}) ELSE concat('job:', "
             f"{alnum('source')}, ':', {alnum('job_id')}, ':', {alnum('company')}, ':', {alnum('title')}) END")

PREFILTERED = f"""
prefiltered AS (
 SELECT * FROM (SELECT *, {TOPIC} AS topic FROM postings WHERE {ENTRY} AND NOT {EXCLUDED}) WHERE topic IS NOT NULL)"""

DEDUPED = f"""
deduped AS (
 SELECT * FROM (SELECT *, {DEDUP_KEY} AS dedup_key, {category('topic')} AS category FROM prefiltered)
 QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY query_ordinal, item_ordinal) = 1)"""


# --- names ---------------------------------------------------------------------

def folded(x: str) -> str:
    return f"lower(strip_accents({x}))"


def ckey(x: str) -> str:
    return f"regexp_replace({folded(x)}, '[^a-z0-9]', '', 'g')"


def norm(x: str) -> str:
    raw = f"trim({folded(x)})"
    clean = rf"regexp_replace(replace({raw}, '&', ' and '), '\bs\.?\s*a\.?\b', ' ', 'g')"
    tokens = f"trim(regexp_replace({clean}, '[^a-z0-9]+', ' ', 'g'))"
    tail = "|".join(s.replace(".", r"\.") for s in R.SUFFIX_TOKENS)
    return f"coalesce(nullif(regexp_replace({tokens}, '(?:(?:^| )(?:{tail}))+$', ''), ''), {raw})"


def slug(x: str) -> str:
    return f"trim(regexp_replace(replace({folded(x)}, '&', ' and '), '[^a-z0-9]+', '-', 'g'), '-')"


def sim(a: str, b: str) -> str:
    """Similarity of two normalised names."""
    return (f"CASE WHEN coalesce({a}, '') = '' OR coalesce({b}, '') = '' THEN 0.0::DOUBLE WHEN {a} = {b} THEN 1.0::DOUBLE "
            f"WHEN list_has_all(string_split({b}, ' '), string_split({a}, ' ')) THEN 0.85::DOUBLE ELSE 0.0::DOUBLE END")


IGNORED = "(" + ", ".join(norm(q(n)) for n in R.IGNORED_COMPANIES) + ")"

COMPANIES = f"""
companies AS (
 SELECT company_key, company, {norm('company')} AS n FROM (
  SELECT {ckey('company')} AS company_key, min_by(company, struct_pack(a := query_ordinal, b := item_ordinal)) AS company
  FROM deduped GROUP BY 1) WHERE company_key <> '')"""

EMPLOYER = "concat(replace(c_name, '#', ' '), sfx.s)"
CUSTOMERS = f"""
customers AS (
 SELECT c.*, {EMPLOYER} AS employer, replace(c_name, '#', ' ') AS label
 FROM customer c JOIN sfx ON c.c_custkey % 5 = sfx.i)"""


def variants(name: str) -> str:
    """List of name variants with repeats, in order."""
    original = rf"trim(regexp_replace({name}, '\s+', ' ', 'g'))"
    normal = norm(original)
    toks = f"string_split({normal}, ' ')"
    plain = f"regexp_extract_all({folded(original)}, '[a-z0-9]+')"
    suffix = inlist(R.SUFFIX_TOKENS)
    skip = inlist((*R.SUFFIX_TOKENS, *R.VARIANT_STOP_TOKENS))
    one = (f"list_filter(list_transform({toks}, lambda t, i: CASE WHEN t IN {suffix} THEN "
           f"array_to_string(list_filter({toks}, lambda u, j: j <> i), ' ') END), lambda v: v IS NOT NULL)")
    rest = f"array_to_string(list_filter({toks}, lambda t: t NOT IN {suffix}), ' ')"
    single = f"list_filter(list_concat({plain}, {toks}), lambda t: length(t) >= 3 AND t NOT IN {skip})"
    raw = f"list_concat([{original}, replace({original}, '&', 'and'), {normal}], {one}, [{rest}], {single})"
    spell = rf"trim(regexp_replace(replace(v, '&', ' and '), '\s+', ' ', 'g'))"
    return f"list_filter(list_transform({raw}, lambda v: {spell}), lambda v: v <> '')"


# --- ratings -------------------------------------------------------------------

DIRECTORY = f"""
directory AS (
 SELECT profile_id, {slug('profile_name')} AS slug,
  CASE WHEN review_count > 0 THEN profile_name END AS profile_name,
  CASE WHEN profile_id % 29 = 0 THEN 503 WHEN profile_id % 31 = 0 THEN 404 ELSE 200 END AS status,
  CASE WHEN isnan(numeric_score) THEN {q(R.UNRATED)} ELSE printf('%.1f/5', numeric_score) END AS score,
  CASE WHEN isnan(numeric_score) THEN 0.0 ELSE numeric_score END AS numeric,
  concat(review_count, ' Reviews') AS reviews,
  concat('https://{R.PRIMARY_HOST}/companies/', {slug('profile_name')}) AS url
 FROM profiles)"""

STATE = f"""
state AS (
 SELECT {ckey('employer')} AS company_key,
  CASE WHEN k < 6 THEN {q(R.PRIMARY_PLATFORM)} ELSE {q(R.FALLBACK_PLATFORM)} END AS platform,
  CASE WHEN k = 5 THEN '5.0/5' WHEN k < 6 THEN '3.5/5' ELSE '4.2/5' END AS score,
  CAST(CASE WHEN k = 5 THEN 5.0 WHEN k < 6 THEN 3.5 ELSE 4.2 END AS DOUBLE) AS numeric,
  CASE WHEN k = 5 THEN '0 Reviews' ELSE '12 Reviews' END AS reviews,
  concat('https://{R.PRIMARY_HOST}/companies/', CASE WHEN k = 1 THEN 'other-place' ELSE {slug('employer')} END) AS url,
  CASE WHEN k IN (2, 5) THEN employer WHEN k IN (3, 4) THEN 'Another Firm' END AS matched_name,
  CASE WHEN k < 6 THEN k = 4 END AS alias_match,
  CASE k WHEN 6 THEN {X.RUN_EPOCH - 100} WHEN 7 THEN {X.RUN_EPOCH - 100_000} END AS checked_at
 FROM (SELECT *, c_custkey % 12 AS k FROM customers) WHERE k < 9)"""

EVERY_STATE = STATE.replace(" WHERE k < 9", "")

EVIDENCE = f"""
evidence AS (
 SELECT {ckey('employer')} AS company_key, {q(R.FALLBACK_PLATFORM)} AS platform,
  printf('%.1f/5', CAST(10 + c_custkey % 41 AS DOUBLE) / 10) AS score,
  CAST(10 + c_custkey % 41 AS DOUBLE) / 10 AS numeric, {q(R.FALLBACK_REVIEWS)} AS reviews,
  {q(R.FALLBACK_SEARCH_PREFIX)} AS url
 FROM customers)"""

# Verdict on the cached entry of each company: ignored, absent, usable, rejected, stale.
_trust = (f"NOT (s.numeric >= 5.0 AND regexp_matches(s.reviews, '(?i)\\b0\\s+reviews?\\b')) AND "
          f"(coalesce(s.matched_name, '') = '' OR coalesce(s.alias_match, false) OR "
          f"({sim('c.n', norm('s.matched_name'))}) >= {R.TRUST_SIMILARITY})")
_slug_of = "lower(regexp_extract(s.url, '/companies/([^/?#]+)', 1))"
_compact = f"regexp_replace({_slug_of}, '[^a-z0-9]', '', 'g')"
_plausible = (f"{_slug_of} <> '' AND (list_has_all(regexp_extract_all({_slug_of}, '[a-z0-9]+'), string_split(c.n, ' ')) "
              f"OR contains({_compact}, c.company_key) OR contains(c.company_key, {_compact}))")
TRUSTED_SQL, PLAUSIBLE_SQL = _trust, f"({_trust}) AND {_plausible}"
CACHE = f"""
cache AS (
 SELECT c.company_key, c.company, c.n, s.platform, s.score, s.numeric, s.reviews, s.url, s.matched_name, s.alias_match,
  s.checked_at,
  CASE WHEN c.n IN {IGNORED} THEN 'ignored' WHEN s.company_key IS NULL THEN 'absent'
   WHEN s.platform = {q(R.PRIMARY_PLATFORM)} THEN CASE WHEN
     CASE WHEN coalesce(s.matched_name, '') = '' THEN ({PLAUSIBLE_SQL}) ELSE ({TRUSTED_SQL}) END
     THEN 'usable' ELSE 'rejected' END
   WHEN coalesce(s.checked_at, 0) > 0 AND {X.RUN_EPOCH} - s.checked_at < {R.RECHECK_SECONDS} THEN 'usable'
   ELSE 'stale' END AS verdict
 FROM companies c LEFT JOIN state s USING (company_key))"""


def lookup(asked: str) -> str:
    """CTEs ending in ``looked`` (company_key, lookup_status, and rating columns)."""
    suffix = ", ".join(f"({i}, {q('' if s == '' else ' ' + s)})" for i, s in enumerate(R.SLUG_SUFFIXES))
    alias = ", ".join(f"({q(k)}, {q(v)})" for k, v in R.ALIASES.items())
    return f"""
slug_suffix(j, add_text) AS (VALUES {suffix}),
alias(compact, slug) AS (VALUES {alias}),
asked AS ({asked}),
pages AS (SELECT *, {norm('profile_name')} AS pn FROM directory
 QUALIFY row_number() OVER (PARTITION BY slug ORDER BY profile_id) = 1),
ranked_pages AS (
 SELECT a.company_key, p.slug, row_number() OVER (PARTITION BY a.company_key ORDER BY {sim('a.n', 'p.pn')} DESC, p.profile_id) AS probe
 FROM asked a JOIN pages p ON p.status = 200 AND ({sim('a.n', 'p.pn')}) >= 0.45),
variant_list AS (
 SELECT company_key, unnest(vs) AS v, generate_subscripts(vs, 1) AS i
 FROM (SELECT company_key, {variants('company')} AS vs FROM asked)),
probes AS (
 SELECT company_key, slug, min(struct_pack(probe := probe, allow_alias := allow_alias)) AS p FROM (
  SELECT company_key, slug, CAST(probe AS BIGINT) AS probe, false AS allow_alias FROM ranked_pages WHERE probe <= 8
  UNION ALL
  SELECT a.company_key, alias.slug, 1000000, true FROM asked a
   JOIN alias ON alias.compact = regexp_replace({folded('a.company')}, '\\s+', ' ', 'g')
  UNION ALL
  SELECT company_key, {slug('concat(v, add_text)')}, 1000001 + i * 4 + j, false FROM variant_list CROSS JOIN slug_suffix
 ) GROUP BY 1, 2),
outcomes AS (
 SELECT a.company_key, b.p.probe AS probe, b.p.allow_alias AS allow_alias, g.* EXCLUDE (status),
  CASE WHEN g.status IN (403, 429) OR g.status >= 500 THEN 'UNAVAILABLE'
   WHEN g.status = 200 AND g.profile_name IS NOT NULL AND (b.p.allow_alias OR ({sim('a.n', 'g.pn')}) >= 0.45) THEN 'HIT'
   END AS lookup_status
 FROM asked a JOIN probes b USING (company_key) JOIN pages g ON g.slug = b.slug),
looked AS (
 SELECT a.company_key, coalesce(o.lookup_status, 'MISS') AS lookup_status, o.score, o.numeric, o.reviews, o.url,
  o.profile_name AS matched_name, o.allow_alias AS alias_match
 FROM asked a LEFT JOIN (SELECT * FROM outcomes WHERE lookup_status IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY company_key ORDER BY probe) = 1) o USING (company_key))"""


def pct(x: str) -> str:
    return f"url_encode({x})"


SECOND = f"""
second AS (
 SELECT c.company_key, {q(R.FALLBACK_PLATFORM)} AS platform,
  coalesce(e.score, {q(R.UNRATED)}) AS score, coalesce(e.numeric, 0.0) AS numeric,
  coalesce(e.reviews, {q(R.FALLBACK_UNRATED_REVIEWS)}) AS reviews,
  coalesce(e.url, concat({q(R.FALLBACK_SEARCH_PREFIX)}, {pct('c.company')})) AS url
 FROM companies c LEFT JOIN evidence e USING (company_key))"""


def _decided(field: str, stamped: bool = False) -> str:
    old, new, sec = f"c.{field}", f"l.{field}", f"d.{field}"
    if field == "platform":
        new = q(R.PRIMARY_PLATFORM)
    if field in ("matched_name", "alias_match"):
        sec = "NULL"
    if field == "checked_at":
        new, stale, sec = "NULL", str(X.RUN_EPOCH), str(X.RUN_EPOCH)
    else:
        stale = old
    return (f"CASE action WHEN 'none' THEN CASE WHEN verdict IN ('usable', 'stale') THEN {old} END WHEN 'delete' THEN NULL "
            f"WHEN 'replace' THEN {new} WHEN 'stamp' THEN {stale} ELSE {sec} END AS {field}")


RATING_FIELDS = ("platform", "score", "numeric", "reviews", "url", "matched_name", "alias_match", "checked_at")
DECIDED = f"""
decided AS (
 SELECT c.company_key, action, {', '.join(_decided(f) for f in RATING_FIELDS)}
 FROM (SELECT c.*, l.lookup_status, CASE WHEN verdict IN ('ignored', 'usable') THEN 'none'
   WHEN lookup_status = 'UNAVAILABLE' THEN CASE WHEN verdict = 'rejected' THEN 'delete' ELSE 'none' END
   WHEN lookup_status = 'HIT' THEN 'replace' WHEN verdict = 'stale' THEN 'stamp' ELSE 'insert' END AS action
  FROM cache c LEFT JOIN looked l USING (company_key)) c
 LEFT JOIN looked l USING (company_key) LEFT JOIN second d USING (company_key))"""

ASKED = "SELECT company_key, company, n FROM cache WHERE verdict IN ('absent', 'rejected', 'stale')"

RATED = f"""
rated AS (
 SELECT p.*, coalesce(d.numeric, 0.0) AS rating_score,
  CASE WHEN d.platform IS NULL THEN NULL WHEN d.score = {q(R.UNRATED)} THEN concat('🔍 ', d.platform)
   ELSE concat('★ ', d.score, ' (', d.platform, ')') END AS company_score,
  CASE WHEN d.platform IS NOT NULL THEN coalesce(d.reviews, '') END AS company_reviews,
  CASE WHEN d.platform IS NOT NULL THEN d.url END AS rating_url
 FROM deduped p LEFT JOIN decided d ON d.company_key = {ckey('p.company')} AND d.company_key <> '')"""

FINITE = "CASE WHEN rating_score IS NULL OR isnan(rating_score) OR isinf(rating_score) THEN 0.0 ELSE rating_score END"
ELIGIBLE = f"""
eligible AS (
 SELECT * FROM rated WHERE category = {q(R.CATEGORY_AI)} OR (category = {q(R.CATEGORY_SWE)} AND ({FINITE}) >= {R.MIN_SCORE}))"""
RATING_ORDER = f"{FINITE} DESC, lower(company), lower(title), job_url, query_ordinal, item_ordinal"
RANKED = f"""
ranked AS (SELECT *, row_number() OVER (ORDER BY {RATING_ORDER}) AS rank FROM eligible)"""

FULL_CHAIN = [POSTINGS, PROFILES, PREFILTERED, DEDUPED, COMPANIES, CUSTOMERS, DIRECTORY, STATE, EVIDENCE, CACHE,
              lookup(ASKED), SECOND, DECIDED, RATED, ELIGIBLE, RANKED]


def with_(parts, select: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + select
