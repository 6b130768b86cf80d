"""Feed parsing, URLs, markup, and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules as R
from ..functions import dates, html as H, scores, text as T, urls as U
from ..functions.names import company_key
from ..operators.dedup import dedup_in_feed
from ..operators.limits import limit_by_manifest
from ..sources import captures as C, directory as Dir, documents, html_feeds as HF, json_feeds as JF
from ..schema import conform
from ..session import materialize
from . import fixture as X
from . import oracle as O
from . import renders

QUERIES: dict = {}
LIMIT = 20


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


P = O.POSTINGS
ITEMS = f"""
items AS (SELECT *, item_ordinal AS k, item_ordinal // 175 AS page_no,
 row_number() OVER (PARTITION BY query_ordinal, item_ordinal // 175 ORDER BY item_ordinal) - 1 AS pos FROM postings)"""
DATE = "strftime(captured_at, '%d/%m/%Y')"


def _limited(captures):
    return captures.withColumn("row_limit", F.lit(LIMIT))


def _rows(parsed, *cols):
    return C.accepted(parsed).select(*cols)


@query("q_json_feed_a", O.with_([P, ITEMS], f"""SELECT job_id, title, CASE WHEN k % 13 = 0 THEN 'N/A' ELSE company END AS company,
 CASE WHEN k % 11 = 0 THEN 'Remote / Europe' ELSE location END AS location, k % 4 < 2 AS is_remote,
 CASE WHEN k % 4 < 2 THEN 'Remote' ELSE 'Hybrid / On-site' END AS modality,
 CASE k % 3 WHEN 0 THEN {DATE} WHEN 1 THEN '2024-01-05' ELSE 'Recente' END AS post_date,
 CASE k % 3 WHEN 0 THEN concat(tag, ',x') WHEN 1 THEN tag ELSE '' END AS tags, 'more' AS description_snippet
 FROM items WHERE pos < {LIMIT} AND k % 101 <> 0"""))
def json_feed_a(spark, sf):
    parsed = JF.parse_arbeitnow(_limited(renders.feed_a(X.postings(spark, sf))))
    return _rows(parsed, "job_id", "title", "company", "location", "is_remote", "modality", "post_date",
                 F.array_join("tags", ",").alias("tags"), "description_snippet")


@query("q_quarantine", O.with_([P, ITEMS], f"""SELECT 'Arbeitnow' AS source, 'title is not text' AS reason, count(*) AS n
 FROM items WHERE pos < {LIMIT} AND k % 101 = 0 UNION ALL
 SELECT 'broken', 'body is not JSON', count(*) FROM events WHERE event_id % 50 = 0"""))
def quarantine(spark, sf):
    parsed = JF.parse_arbeitnow(_limited(renders.feed_a(X.postings(spark, sf))))
    events = X.table(spark, sf, "events").select(
        F.lit("broken").alias("source"), F.lit(200).alias("status"),
        F.when(F.col("event_id") % 50 == 0, F.substring("props", 1, 4)).otherwise(F.col("props")).alias("body"),
        F.col("ts").alias("captured_at"))
    aside = C.quarantine(parsed).unionByName(C.broken_bodies(events))
    return aside.groupBy("source", "reason").agg(F.count(F.lit(1)).alias("n"))


_URL_B = """CASE k % 4 WHEN 0 THEN concat('https://a.example/x/', job_id) WHEN 1 THEN concat('https://g.example/', job_id)
 WHEN 2 THEN concat('https://himalayas.app/companies/c/jobs/', job_id) ELSE 'https://himalayas.app/jobs' END"""


@query("q_json_feed_b", O.with_([P, ITEMS], f"""SELECT k AS item, {_URL_B} AS job_url,
 CASE WHEN k % 2 = 0 OR k % 4 <> 3 THEN job_id ELSE 'jobs' END AS job_id,
 CASE k % 3 WHEN 0 THEN concat('EUR ', format('{{:,}}', k), ' - 1,234,567') WHEN 1 THEN 'USD 1,000.5 - 2,000.0' END AS salary,
 CASE k % 3 WHEN 0 THEN 'Spain, Portugal' WHEN 1 THEN 'Spain' ELSE 'Worldwide Remote' END AS location,
 {DATE} AS post_date, company FROM items"""))
def json_feed_b(spark, sf):
    parsed = JF.parse_himalayas(renders.feed_b(X.postings(spark, sf)))
    # place in the feed: 25 items a page, every seventh order
    item = F.col("item_ordinal")
    place = (F.shiftright(item, 32) * renders.PAGE + F.pmod(item, F.lit(2**32))) * 7 + F.col("query_ordinal")
    return _rows(parsed, place.alias("item"), "job_url", "job_id", "salary", "location", "post_date", "company")


@query("q_json_feed_c", O.with_([P, ITEMS], f"""SELECT job_id, title, job_url,
 CASE k % 4 WHEN 0 THEN {O.q(R.SENIORITY_LABEL)} WHEN 1 THEN {O.q(R.SENIORITY_LABEL)} WHEN 2 THEN 'Any' ELSE '' END AS seniority,
 tag AS tags, CASE k % 3 WHEN 0 THEN '2024-02-03' WHEN 1 THEN '17' END AS post_date FROM items WHERE k % 9 <> 0 AND job_url <> ''"""))
def json_feed_c(spark, sf):
    parsed = JF.parse_jobicy(renders.feed_c(X.postings(spark, sf)))
    return _rows(parsed, "job_id", "title", "job_url", "seniority", F.array_join("tags", ",").alias("tags"), "post_date")


# A null description is no text, but the field is optional: the row is kept.
@query("q_json_feed_d", O.with_([P, ITEMS], f"""SELECT job_id, title, company, job_url, tag AS tags, post_date FROM (
 SELECT *, '2024-03-04' AS post_date, row_number() OVER (PARTITION BY query_ordinal, page_no ORDER BY k) - 1 AS place
 FROM items WHERE k % 17 <> 0) WHERE place < {LIMIT} AND job_url <> ''"""))
def json_feed_d(spark, sf):
    parsed = JF.parse_remoteok(_limited(renders.feed_d(X.postings(spark, sf))))
    return _rows(parsed, "job_id", "title", "company", "job_url", F.array_join("tags", ",").alias("tags"), "post_date")


_PLACE_E = "CASE WHEN k % 11 = 0 THEN 'Portugal' ELSE location END"
_REMOTE_E = f"contains(lower({_PLACE_E}), 'remote')"


@query("q_html_feed_e", O.with_([P, ITEMS], f"""SELECT job_id, concat(title, ' & more') AS title,
 CASE WHEN k % 13 = 0 THEN 'Confidencial' ELSE company END AS company, {_PLACE_E} AS location,
 concat('https://l.example/jobs/view/role-at-', job_id) AS job_url, CASE WHEN {_REMOTE_E} THEN 'Remote' ELSE 'On-site / Hybrid' END AS modality,
 {_REMOTE_E} AS is_remote, CASE WHEN k % 2 = 0 THEN '2 days ago' END AS post_date FROM items WHERE k % 19 <> 0
 QUALIFY row_number() OVER (PARTITION BY query_ordinal ORDER BY k) <= 30"""))
def html_feed_e(spark, sf):
    parsed = HF.parse_linkedin(renders.feed_e(X.postings(spark, sf)))
    requests = spark.createDataFrame(
        [(i, "LinkedIn", "q", 30, None) for i in range(7)],
        "query_ordinal int, source string, query string, row_limit int, base_location string")
    return _rows(limit_by_manifest(parsed, requests), "job_id", "title", "company", "location", "job_url", "modality",
                 "is_remote", "post_date")


@query("q_html_cards", O.with_([P, ITEMS], f"""SELECT query_ordinal, count(*) AS n, count(DISTINCT title) AS n_titles,
 count(*) FILTER (WHERE {_REMOTE_E}) AS n_remote FROM items WHERE k % 19 <> 0 GROUP BY 1"""))
def html_cards(spark, sf):
    parsed = HF.parse_linkedin(renders.feed_e(X.postings(spark, sf)))
    return parsed.groupBy("query_ordinal").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("title").alias("n_titles"), F.count_if("is_remote").alias("n_remote"))


_WORD_F = "CASE k % 4 WHEN 0 THEN 'lisboa remoto' WHEN 1 THEN 'porto' WHEN 2 THEN 'remote' ELSE 'sede' END"
_BLOCK_F = f"lower(concat(CASE WHEN k % 23 = 0 THEN 'ab' ELSE title END, ' ', {_WORD_F}))"


@query("q_html_feed_f", O.with_([P, ITEMS], f"""SELECT job_id, title, company, location, is_remote, salary, post_date, job_url FROM (
 SELECT CAST(k - k % 2 AS VARCHAR) AS job_id, CASE WHEN k % 23 = 0 THEN 'ab' ELSE title END AS title,
 CASE WHEN k % 3 < 2 THEN company ELSE 'Consultar Anúncio' END AS company, query_ordinal, k,
 CASE k % 4 WHEN 0 THEN 'Lisbon, Portugal' WHEN 1 THEN 'Porto, Portugal' WHEN 2 THEN 'Portugal (Remote)' ELSE 'Portugal' END AS location,
 k % 4 IN (0, 2) AS is_remote, CASE WHEN k % 4 = 0 THEN '€20 000 - €45 000' END AS salary, '14 ago' AS post_date,
 concat('https://www.itjobs.pt/oferta/', k - k % 2, '/slug') AS job_url FROM items
 QUALIFY row_number() OVER (PARTITION BY query_ordinal, k - k % 2 ORDER BY k) = 1) WHERE length(title) >= 3"""))
def html_feed_f(spark, sf):
    parsed = HF.parse_itjobs(renders.feed_f(X.postings(spark, sf)))
    return _rows(parsed, "job_id", "title", "company", "location", "is_remote", "salary", "post_date", "job_url")


_PLACE_G = "CASE WHEN k % 2 = 0 THEN concat(location, ' PT') ELSE 'Unknown' END"
_REMOTE_G = f"contains(lower(concat({_PLACE_G}, ' ', title)), 'remote')"


@query("q_html_feed_g", O.with_([P, ITEMS], f"""SELECT job_id, title, CASE WHEN k % 3 < 2 THEN company ELSE 'Landing.jobs Partner' END AS company,
 {_PLACE_G} AS location, CASE k % 3 WHEN 0 THEN concat('https://landing.jobs/at/x/', job_id, '?r=1')
 WHEN 1 THEN concat('https://o.example/', job_id) ELSE concat('https://landing.jobs/z/', job_id) END AS job_url,
 CASE WHEN {_REMOTE_G} THEN '100% Remote' ELSE 'Unknown' END AS modality FROM items WHERE pos < {LIMIT}"""))
def html_feed_g(spark, sf):
    parsed = HF.parse_landing(_limited(renders.feed_g(X.postings(spark, sf))))
    return _rows(parsed, "job_id", "title", "company", "location", "job_url", "modality")


_case_p = "profile_id % 5"


@query("q_profile_pages", O.with_([O.EVERY_PROFILE], f"""SELECT profile_id, name AS profile_name,
 CASE WHEN {_case_p} < 2 THEN printf('%.1f/5', s) ELSE {O.q(R.UNRATED)} END AS score, CASE WHEN {_case_p} < 2 THEN s ELSE 0.0 END AS numeric,
 CASE WHEN {_case_p} < 2 THEN concat(review_count, ' Reviews') ELSE {O.q(R.NO_REVIEWS)} END AS reviews,
 CASE WHEN {_case_p} <> 4 THEN concat('https://{R.PRIMARY_HOST}/companies/firm-', profile_id) END AS url
 FROM (SELECT *, CASE WHEN isnan(numeric_score) THEN 1.0 ELSE numeric_score END AS s,
  CASE WHEN {_case_p} < 2 AND review_count > 0 THEN profile_name WHEN {_case_p} = 2 THEN profile_name END AS name FROM profiles)"""))
def profile_pages(spark, sf):
    pages = renders.profile_pages(X.profiles(spark, sf, gaps=False), R.PRIMARY_HOST)
    return Dir.parse_profile_pages(pages).select("profile_id", "profile_name", "score", "numeric", "reviews", "url")


_SFX = P.split("postings AS")[0].rstrip().rstrip(",")


@query("q_search_ratings", O.with_([_SFX, O.CUSTOMERS], f"""SELECT {O.ckey('employer')} AS company_key,
 CASE WHEN hit THEN CASE c WHEN 0 THEN '4.2/5' WHEN 1 THEN '3.5/5' WHEN 3 THEN '4.0/5' ELSE '4.9/5' END END AS score,
 CASE WHEN hit THEN CASE c WHEN 0 THEN 4.2 WHEN 1 THEN 3.5 WHEN 3 THEN 4.0 ELSE 4.9 END END::DOUBLE AS numeric,
 CASE WHEN hit THEN CASE WHEN c = 0 THEN '1,234 Reviews' ELSE {O.q(R.FALLBACK_REVIEWS)} END END AS reviews,
 CASE WHEN hit THEN concat({O.q(R.FALLBACK_SEARCH_PREFIX)}, url_encode(employer)) END AS url
 FROM (SELECT *, c_custkey % 5 AS c, c_custkey % 37 <> 0 AND c_custkey % 3 <> 0 AND c_custkey % 5 <> 2 AS hit FROM customers)"""))
def search_ratings(spark, sf):
    firms = X.table(spark, sf, "customer").select("c_custkey", X.employer(F.col("c_custkey"), F.col("c_name")).alias("company"))
    pages = renders.search_pages(firms.withColumn("company_key", company_key(F.col("company"))))
    return Dir.search_ratings(pages).select("company_key", "rating.score", "rating.numeric", "rating.reviews", "rating.url")


@query("q_autocomplete", f"""SELECT c_custkey, CASE c_custkey % 4 WHEN 1 THEN 'a b' ELSE replace(c_name, '#', ' ') END AS name,
 CASE c_custkey % 4 WHEN 1 THEN 'a-b' WHEN 2 THEN 'firm-two' ELSE {O.slug("replace(c_name, '#', ' ')")} END AS slug FROM customer WHERE c_custkey % 4 <> 3""")
def autocomplete(spark, sf):
    key, name = F.col("c_custkey"), X.customer_label(F.col("c_name"))
    body = renders._layout(key % 4, (
        F.concat(F.lit('{"results":[{"name":"'), name, F.lit('","slug":"'), name, F.lit('"}, 5, {"name":"no slug"}]}')),
        F.lit('{"results":[],"json_list":{"0":{"value":"A B"}}}'),
        F.concat(F.lit('[{"label":"'), name, F.lit('","slug":"https://x/companies/Firm Two/about"}]')),
        F.lit('"text"')))
    payloads = X.table(spark, sf, "customer").select("c_custkey", body.alias("body"))
    return Dir.autocomplete_candidates(payloads).select("c_custkey", "name", "slug")


@query("q_cache_scan", """SELECT concat('k', c_custkey) AS company_key, 'P' AS platform, c_acctbal AS numeric,
 CASE WHEN c_custkey % 3 = 0 THEN 17 END AS checked_at FROM customer WHERE c_custkey % 10 <> 9""")
def cache_scan(spark, sf):
    key = F.col("c_custkey")
    entry = F.concat(
        F.lit('{"k'), key.cast("string"), F.lit('":{"platform":"P","numeric":'),
        F.when(key % 2 == 0, F.col("c_acctbal").cast("string")).otherwise(
            F.concat(F.lit('"'), F.col("c_acctbal").cast("string"), F.lit('"'))),
        F.when(key % 3 == 0, F.lit(',"teamlyzer_checked_at":17')).otherwise(F.lit("")), F.lit("}}"))
    docs = X.table(spark, sf, "customer").select(
        F.when(key % 10 == 9, F.lit("[1]")).otherwise(entry).alias("body"))
    return documents.explode_cache(docs).select("company_key", "platform", "numeric", "checked_at")


# --- scalar functions ---------------------------------------------------------------

_PROP = "CAST(json_extract(props, '$.k') AS BIGINT)"


@query("q_truthy", f"""SELECT event_id, {_PROP} % 6 IN (0, 1, 3) AS value FROM events""")
def truthy(spark, sf):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint") % 6
    flag = renders._layout(k, (F.lit('{"f":true}'), F.lit('{"f":" YES "}'), F.lit('{"f":0}'), F.lit('{"f":1}'), F.lit('{"f":null}'), F.lit("{}")))
    return X.table(spark, sf, "events").select(
        "event_id", T.truthy(F.try_variant_get(F.try_parse_json(flag), "$.f", "string")).alias("value"))


@query("q_as_list", f"""SELECT event_id, CASE {_PROP} % 4 WHEN 0 THEN 'a|7' WHEN 1 THEN event_type ELSE '' END AS items,
 CASE {_PROP} % 4 WHEN 0 THEN 'a, 7' WHEN 1 THEN event_type WHEN 3 THEN '' END AS joined FROM events""")
def as_list(spark, sf):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint") % 4
    doc = renders._layout(k, (
        F.lit('{"f":["a",7]}'), F.concat(F.lit('{"f":"'), F.col("event_type"), F.lit('"}')), F.lit("{}"), F.lit('{"f":[]}')))
    value = F.try_variant_get(F.try_parse_json(doc), "$.f", "variant")
    return X.table(spark, sf, "events").select(
        "event_id", F.array_join(T.as_list(value), "|").alias("items"), T.join_list(value).alias("joined"))


@query("q_salary", """SELECT o_orderkey, concat('EUR ', format('{:,}', o_orderkey * 1000), ' - ', format('{:,}', o_custkey)) AS salary FROM orders""")
def salary(spark, sf):
    return X.table(spark, sf, "orders", "o_orderkey", "o_custkey").select(
        "o_orderkey", scores.salary_range((F.col("o_orderkey") * 1000).cast("string"), F.col("o_custkey").cast("string"), F.lit("EUR")).alias("salary"))


@query("q_epoch_date", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'Recente' WHEN event_id % 5 = 1 THEN 'soon' ELSE strftime(ts, '%d/%m/%Y') END AS post_date FROM events""")
def epoch_date(spark, sf):
    key = F.col("event_id") % 5
    number = F.when(key > 1, F.unix_timestamp("ts").cast("double")).when(key == 0, F.when(F.col("event_id") % 2 == 0, F.lit(1e300)))
    return X.table(spark, sf, "events").select(
        "event_id", dates.posted_on(F.when(key == 1, F.lit("soon")), number).alias("post_date"))


@query("q_canonical_url", f"SELECT page_id, {O.canonical('url')} AS canonical FROM pages")
def canonical_url(spark, sf):
    return X.table(spark, sf, "pages", "page_id", "url").select("page_id", U.canonical_url(F.col("url")).alias("canonical"))


@query("q_url_parts", """SELECT page_id, string_split(url, '?')[1] AS no_query, string_split(url, '/')[-1] AS last_part,
 string_split(url, '-')[-1] AS after_dash FROM pages""")
def url_parts(spark, sf):
    url = F.col("url")
    return X.table(spark, sf, "pages").select(
        "page_id", U.strip_query(url).alias("no_query"), U.last_segment(url).alias("last_part"), U.id_after_dash(url).alias("after_dash"))


_HREFS = r"""unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g'),
 '<a href="([^"]*)"', 1)) AS href"""


def _links(spark, sf):
    tags = F.regexp_extract_all(H.drop_hidden(F.col("html")), F.lit('(<a href="[^"]*")'))
    rows = X.table(spark, sf, "pages", "page_id", "html").select("page_id", F.posexplode(tags).alias("pos", "tag"))
    return rows.select("page_id", "pos", H.attr(F.concat("tag", F.lit(">")), "href").alias("href"))


@query("q_absolute_links", f"""SELECT page_id, href, CASE WHEN starts_with(href, 'http') THEN href ELSE concat('https://b.example', href) END AS link,
 count(*) AS n FROM (SELECT page_id, replace(href, '&amp;', '&') AS href FROM (SELECT page_id, {_HREFS} FROM pages)) GROUP BY ALL""")
def absolute_links(spark, sf):
    return _links(spark, sf).groupBy(
        "page_id", "href", U.absolute_url(F.col("href"), "https://b.example").alias("link")).agg(F.count(F.lit(1)).alias("n"))


@query("q_link_dedup", f"SELECT DISTINCT page_id, replace(href, '&amp;', '&') AS job_id FROM (SELECT page_id, {_HREFS} FROM pages) WHERE href <> ''")
def link_dedup(spark, sf):
    rows = _links(spark, sf).select(
        F.lit("pages").alias("source"), F.col("page_id").alias("query_ordinal"), F.col("pos").alias("item_ordinal"),
        F.col("href").alias("job_id"))
    return dedup_in_feed(rows).select(F.col("query_ordinal").alias("page_id"), "job_id")


_TAG_RE = """<[a-zA-Z/!?](?:[^>"'']|"[^"]*"|''[^'']*'')*>"""
_UNESCAPED = "replace(replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
_TEXT_SQL = _UNESCAPED.format(rf"""regexp_replace(replace(regexp_replace(html,
 '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g'), '&nbsp;', ' '), '{_TAG_RE}', ' ', 'g')""")


@query("q_html_text", rf"SELECT page_id, trim(regexp_replace({_TEXT_SQL}, '\s+', ' ', 'g')) AS text FROM pages")
def html_text(spark, sf):
    return X.table(spark, sf, "pages", "page_id", "html").select("page_id", H.page_text(F.col("html")).alias("text"))


@query("q_html_attr", r"""SELECT page_id, nullif(regexp_extract(html, '<html lang="([^"]*)"', 1), '') AS lang,
 nullif(regexp_extract(html, '<meta charset="([^"]*)"', 1), '') AS charset,
 trim(replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '&amp;', '&')) AS heading FROM pages""")
def html_attr(spark, sf):
    page = H.drop_hidden(F.col("html"))
    return X.table(spark, sf, "pages").select(
        "page_id",
        H.attr(H.first_tag(page, tag="html"), "lang").alias("lang"),
        H.attr(H.first_tag(page, tag="meta", having="charset"), "charset").alias("charset"),
        F.coalesce(H.text_of(H.first_element(page, tag="h1")), F.lit("")).alias("heading"),
    )


@query("q_escape", f"""SELECT page_id, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS safe,
 replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS page FROM pages""")
def escape(spark, sf):
    return X.table(spark, sf, "pages").select(
        "page_id", U.safe_url(F.col("url")).alias("safe"), T.html_escape(F.col("html")).alias("page"))


@query("q_pct_encode", O.with_([P], "SELECT job_id, url_encode(concat(title, '/', company)) AS encoded FROM postings"))
def pct_encode(spark, sf):
    return X.postings(spark, sf).select("job_id", T.pct_encode(F.concat("title", F.lit("/"), "company")).alias("encoded"))


_BLURB = "concat(title, ' em ', location, ' ', modality, CASE job_id::BIGINT % 4 WHEN 0 THEN ' LISBOA 14 Ago €20 000 - €45 000.' WHEN 1 THEN ' Aveiro 3 dez $ 900 ' WHEN 2 THEN ' braga remoto' ELSE '' END)"


def _blurb():
    return F.concat("title", F.lit(" em "), "location", F.lit(" "), "modality", renders._layout(
        F.col("item_ordinal") % 4, (F.lit(" LISBOA 14 Ago €20 000 - €45 000."), F.lit(" Aveiro 3 dez $ 900 "), F.lit(" braga remoto"), F.lit(""))))


_LADDER = "CASE " + " ".join(f"WHEN {O.any_of('b', w)} THEN {O.q(n)}" for w, n in R.CITY_LADDER) + \
    " WHEN contains(b, 'remot') AND (contains(b, 'remoto') OR contains(b, 'remote')) THEN 'Portugal (Remote)' ELSE 'Portugal' END"


@query("q_location", O.with_([P], f"SELECT job_id, {_LADDER} AS place FROM (SELECT job_id, lower({_BLURB}) AS b FROM postings)"))
def location(spark, sf):
    return X.postings(spark, sf).select("job_id", HF.location_of_text(_blurb()).alias("place"))


@query("q_modality", O.with_([P], """SELECT job_id,
 CASE WHEN contains(lower(location), 'remote') OR contains(lower(title), 'remote') THEN 'Remote' ELSE 'On-site / Hybrid' END AS by_card,
 CASE WHEN contains(lower(modality), 'remote') THEN '100% Remote' ELSE 'On-site / Hybrid' END AS by_text,
 CASE WHEN contains(lower(concat(location, ' ', title)), 'remote') THEN '100% Remote' ELSE 'Unknown' END AS by_place FROM postings"""))
def modality(spark, sf):
    return X.postings(spark, sf).select(
        "job_id",
        HF.modality_of_card(F.col("location"), F.col("title"))[0].alias("by_card"),
        HF.modality_of_text(F.col("modality"))[0].alias("by_text"),
        HF.modality_of_place(F.col("location"), F.col("title"))[0].alias("by_place"),
    )


@query("q_daymonth", O.with_([P], "SELECT job_id, CASE job_id::BIGINT % 4 WHEN 0 THEN '14 Ago' WHEN 1 THEN '3 dez' END AS day FROM postings"))
def daymonth(spark, sf):
    return X.postings(spark, sf).select("job_id", dates.day_month_in_text(_blurb()).alias("day"))


@query("q_salary_text", O.with_([P], "SELECT job_id, CASE job_id::BIGINT % 4 WHEN 0 THEN '€20 000 - €45 000' WHEN 1 THEN '$ 900' END AS pay FROM postings"))
def salary_text(spark, sf):
    return X.postings(spark, sf).select("job_id", scores.salary_in_text(_blurb()).alias("pay"))


@query("q_profile_url", f"""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN concat('https://{R.PRIMARY_HOST}/companies/c', c_custkey)
 WHEN 1 THEN concat('https://{R.PRIMARY_HOST}/companies/F', c_custkey) END AS url, c_custkey % 4 = 0 AS is_profile FROM customer""")
def profile_url(spark, sf):
    key = F.col("c_custkey").cast("string")
    url = renders._layout(F.col("c_custkey") % 4, (
        F.concat(F.lit("https://PT.teamlyzer.com/companies/c"), key, F.lit("/?a=1#b")), F.lit(""),
        F.concat(F.lit("https://x.example/companies/c"), key), F.concat(F.lit(f"https://{R.PRIMARY_HOST}/companies/a/b"), key)))
    fallback = F.concat(F.lit(f"https://{R.PRIMARY_HOST}/companies/F"), key)
    return X.table(spark, sf, "customer").select(
        "c_custkey", U.canonical_profile_url(url, fallback, R.PRIMARY_HOST).alias("url"),
        U.is_profile_url(url, R.PRIMARY_HOST).alias("is_profile"))


@query("q_parse_score", """SELECT l_orderkey, l_linenumber, CAST(nullif(regexp_extract(t, '([1-5](?:[.][0-9])?)', 1), '') AS DOUBLE) AS score
 FROM (SELECT l_orderkey, l_linenumber, concat('nota ', CAST(l_tax * 100 AS INTEGER), '.', CAST(l_discount * 100 AS INTEGER) % 10, ' de') AS t FROM lineitem)""")
def parse_score(spark, sf):
    text = F.concat(F.lit("nota "), F.round(F.col("l_tax") * 100).cast("int").cast("string"), F.lit(","),
                    (F.round(F.col("l_discount") * 100).cast("int") % 10).cast("string"), F.lit(" de"))
    return X.table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_tax", "l_discount").select("l_orderkey", "l_linenumber", scores.parse_score(text).alias("score"))


@query("q_all_feeds", O.with_([P, ITEMS], f"""SELECT 'Arbeitnow' AS source, count(*) AS n FROM items WHERE k % 101 <> 0
 UNION ALL SELECT 'Himalayas', count(*) FROM items
 UNION ALL SELECT 'Jobicy', count(*) FROM items WHERE k % 9 <> 0 AND job_url <> ''
 UNION ALL SELECT 'RemoteOK', count(*) FROM items WHERE k % 17 <> 0 AND job_url <> ''
 UNION ALL SELECT 'LinkedIn', count(*) FROM items WHERE k % 19 <> 0
 UNION ALL SELECT 'ITJobs.pt', count(*) FROM (SELECT query_ordinal, k - k % 2 AS j, min_by(CASE WHEN k % 23 = 0 THEN 2 ELSE 9 END, k) AS len
  FROM items GROUP BY 1, 2) WHERE len >= 3
 UNION ALL SELECT 'Landing.jobs', count(*) FROM items"""))
def all_feeds(spark, sf):
    """Ingest of all seven feeds at once, conformed to the posting schema."""
    from .daily import ingest

    p = materialize(X.postings(spark, sf), "postings")  # seven renders read them
    landed = None
    for render in (renders.feed_a, renders.feed_b, renders.feed_c, renders.feed_d, renders.feed_e, renders.feed_f, renders.feed_g):
        landed = render(p) if landed is None else landed.unionByName(render(p))
    requests = spark.createDataFrame(
        [], "query_ordinal int, source string, query string, row_limit int, base_location string")
    rows, _ = ingest(landed, requests)
    return conform(rows, *["query_ordinal", "item_ordinal"], run_ts=X.RUN_TS).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
