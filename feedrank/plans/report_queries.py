"""Report sections, badges, watch list, contacts, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules as R, sinks
from ..functions.scores import finite_or_zero
from ..operators import classify, contacts, dedup, ranking, report, watchlist
from ..schema import conform
from ..session import materialize, scratch_path
from ..sources.documents import read_published
from . import fixture as X
from . import oracle as O
from .core_queries import BY_PROFILE, rated_by_profile
from .daily import candidates

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


P = O.POSTINGS
SECTION = (f"CASE WHEN {O.any_of('lower(location)', R.SECTION_ONE_PLACES)} THEN 1 WHEN {O.any_of('lower(modality)', R.SECTION_TWO_MODALITIES)} "
           f"OR {O.any_of('lower(location)', R.SECTION_TWO_PLACES)} THEN 2 ELSE 3 END")
RANKED = [*BY_PROFILE, O.ELIGIBLE]


def _eligible(spark, sf):
    return rated_by_profile(spark, sf).filter(classify.is_eligible(F.col("category"), F.col("rating_score")))


@query("q_sections", O.with_(RANKED, f"""SELECT section, job_id,
 row_number() OVER (PARTITION BY section ORDER BY {O.RATING_ORDER}) AS section_rank
 FROM (SELECT *, {SECTION} AS section FROM eligible)"""))
def sections(spark, sf):
    return report.with_sections(_eligible(spark, sf)).select("section", "job_id", "section_rank")


_TITLES = ", ".join(f"({i}, {O.q(t)})" for i, t in R.SECTION_TITLES.items())


@query("q_section_counts", O.with_([P, f"titles(section, section_title) AS (VALUES {_TITLES})"], f"""
SELECT t.section, t.section_title, count(p.section) AS n FROM titles t
LEFT JOIN (SELECT {SECTION} AS section FROM postings) p ON p.section = t.section GROUP BY ALL"""))
def section_counts(spark, sf):
    return report.section_counts(X.postings(spark, sf))


_COLOURS = " ".join(f"WHEN {O.q(s)} THEN {O.q(c)}" for s, c in R.SOURCE_COLOURS.items())
_SOURCES = (*R.SOURCE_COLOURS, "RemoteOK")
_SOURCE = f"([{', '.join(O.q(s) for s in _SOURCES)}])[query_ordinal + 1]"
_LINK = "CASE WHEN item_ordinal % 5 = 0 THEN 'ftp://x/y' WHEN item_ordinal % 5 = 1 THEN 'https://pt.teamlyzer.com/companies/a' WHEN item_ordinal % 5 = 2 THEN 'https://a.example/?q=1&b=<2>' END"


@query("q_badges", O.with_(RANKED, f"""SELECT job_id, CASE WHEN contains(lower(category), 'ai') THEN {O.q(R.CATEGORY_BADGES[0])} ELSE {O.q(R.CATEGORY_BADGES[1])} END AS category_badge,
 CASE WHEN coalesce(company_score, '') = '' THEN 'none' WHEN link IS NULL OR link LIKE 'ftp%' THEN 'plain'
  WHEN contains(link, 'teamlyzer') THEN 'primary' ELSE 'fallback' END AS rating_badge,
 CASE {_SOURCE} {_COLOURS} ELSE {O.q(R.SOURCE_COLOUR_DEFAULT)} END AS source_colour
 FROM (SELECT *, {_LINK} AS link FROM eligible)"""))
def badges(spark, sf):
    item = F.col("item_ordinal")
    link = (F.when(item % 5 == 0, F.lit("ftp://x/y")).when(item % 5 == 1, F.lit("https://pt.teamlyzer.com/companies/a"))
            .when(item % 5 == 2, F.lit("https://a.example/?q=1&b=<2>")))
    source = F.element_at(F.array(*[F.lit(s) for s in _SOURCES]), F.col("query_ordinal") + 1)
    rows = _eligible(spark, sf).withColumns({"rating_url": link, "source": source})
    return report.with_badges(rows).select("job_id", "category_badge", "rating_badge", "source_colour")


_TARGETS = ("customer 000000012", "trainee", "confidencial", "group", "no such name")


@query("q_targets", O.with_([P, f"targets(target) AS (VALUES {', '.join(f'({O.q(t)})' for t in _TARGETS)})"], """
SELECT t.target, p.job_id FROM targets t JOIN postings p ON contains(lower(p.company), t.target) OR contains(lower(p.title), t.target)"""))
def targets(spark, sf):
    return watchlist.target_matches(X.postings(spark, sf), _TARGETS).select("target", "job_id")


@query("q_target_counts", O.with_([P, f"targets(target) AS (VALUES {', '.join(f'({O.q(t)})' for t in _TARGETS)})"], """
SELECT t.target, count(p.job_id) AS n FROM targets t LEFT JOIN postings p
 ON contains(lower(p.company), t.target) OR contains(lower(p.title), t.target) GROUP BY 1"""))
def target_counts(spark, sf):
    return watchlist.target_counts(X.postings(spark, sf), _TARGETS)


# A watch list as long as the customer table: whole names, parts of names, parts that many share, and some that match nothing.
@query("q_target_table", O.with_([O.POSTINGS, """
needle AS (
 SELECT DISTINCT lower(CASE c_custkey % 4 WHEN 0 THEN replace(c_name, '#', ' ') WHEN 1 THEN right(c_name, 5) WHEN 2 THEN right(c_name, 2)
  ELSE concat('nobody ', c_custkey) END) AS target FROM customer)"""], """SELECT target, count(p.job_id) AS n FROM needle t
LEFT JOIN postings p ON contains(lower(p.company), t.target) OR contains(lower(p.title), t.target) GROUP BY 1"""))
def target_table(spark, sf):
    key, name = F.col("c_custkey") % 4, F.col("c_name")
    target = (
        F.when(key == 0, F.replace(name, F.lit("#"), F.lit(" "))).when(key == 1, F.substring(name, -5, 5)).when(key == 2, F.substring(name, -2, 2))
        .otherwise(F.concat(F.lit("nobody "), F.col("c_custkey").cast("string"))))
    targets = X.table(spark, sf, "customer", "c_custkey", "c_name").select(F.lower(target).alias("target"))
    return watchlist.target_counts(X.postings(spark, sf), targets)


@query("q_display", O.with_(BY_PROFILE, f"""SELECT CASE WHEN coalesce(company_score, '') = '' THEN {O.q(R.NO_RATING)}
 ELSE concat(company_score, ' (', company_reviews, ')') END AS score, company, title, category, location, modality, job_url
 FROM rated"""))
def display(spark, sf):
    return report.display(rated_by_profile(spark, sf))


# --- contacts ----------------------------------------------------------------------

_turn = "(c_custkey + qn) % 6"
DIRECTORY = f"""
contact_rows AS (
 SELECT {O.ckey('employer')} AS company_key, CASE WHEN qn = 0 THEN 'Machine Learning' END AS area,
  CASE WHEN qn < 4 THEN 0 ELSE 1 END AS tier, CAST(qn AS INTEGER) AS query_ordinal, CAST(c_custkey % 4 AS INTEGER) AS result_ordinal,
  CASE WHEN c_custkey % 17 = 0 THEN 'Jobs Overview' ELSE concat('alex sample', c_custkey % 100) END AS name,
  CASE {_turn} WHEN 0 THEN 'Engineering Manager' WHEN 1 THEN 'Head of AI & Machine Learning' WHEN 2 THEN 'Technical Recruiter'
   WHEN 3 THEN 'CTO and Tech Lead' WHEN 4 THEN 'Sales' ELSE 'Talent Acquisition Partner' END AS role,
  concat('https://pt.linkedin.com/in/alex-', c_custkey) AS profile_url,
  concat('Machine Learning team in ', CASE c_custkey % 3 WHEN 0 THEN 'Lisbon' WHEN 1 THEN 'Madrid' ELSE 'EMEA' END) AS snippet
 FROM customers CROSS JOIN range(6) r(qn) WHERE c_custkey % 5 <> 4),
contacts AS (
 SELECT *, lower(concat(role, ' ', snippet)) AS about FROM contact_rows WHERE result_ordinal < {R.RESULTS_PER_QUERY}),
usable AS (
 SELECT * FROM contacts WHERE NOT {O.any_of('lower(name)', R.GENERIC_NAME_WORDS)} AND
  CASE WHEN tier = 0 THEN {O.any_of('about', R.MANAGER_PHRASES)} AND NOT {O.any_of('about', R.EXECUTIVE_PHRASES)}
   ELSE {O.any_of('about', R.RECRUITER_PHRASES)} END)"""


EVERY_DIRECTORY = DIRECTORY.replace(" WHERE c_custkey % 5 <> 4", "")


@query("q_contact_parse", O.with_([P.split("postings AS")[0].rstrip().rstrip(","), O.CUSTOMERS, EVERY_DIRECTORY],
                                  "SELECT company_key, tier, query_ordinal, name, role, profile_url FROM usable"))
def contact_parse(spark, sf):
    return contacts.contact_results(X.contact_directory(spark, sf, gaps=False)).select(
        "company_key", "tier", "query_ordinal", "name", "role", "profile_url")


@query("q_contact_best", O.with_([P.split("postings AS")[0].rstrip().rstrip(","), O.CUSTOMERS, EVERY_DIRECTORY], """
SELECT company_key, coalesce(area, 'any') AS area, tier, query_ordinal, name FROM usable
QUALIFY row_number() OVER (PARTITION BY company_key, area ORDER BY tier, query_ordinal, result_ordinal) = 1"""))
def contact_best(spark, sf):
    return contacts.best_contact(X.contact_directory(spark, sf, gaps=False)).select(
        "company_key", F.coalesce("area", F.lit("any")).alias("area"), "contact.tier", "contact.query_ordinal", "contact.name")


_TEXT = "lower(concat(title, '  ', tag))"
AREA = "CASE " + " ".join(f"WHEN {O.any_of(_TEXT, words)} THEN {O.q(name)}" for name, words in R.AREAS) + f" ELSE {O.q(R.AREA_DEFAULT)} END"


@query("q_job_area", O.with_([P], f"SELECT job_id, {AREA} AS job_area FROM postings"))
def job_area(spark, sf):
    return contacts.with_area(X.postings(spark, sf)).select("job_id", "job_area")


def _tech_sql(text: str) -> str:
    hits = ", ".join(
        "CASE WHEN regexp_matches({t}, {p}) THEN {v} END".format(
            t=text, v=O.q(t), p=O.q(r"(?:^|[^\p{L}\p{N}_])" + t.lower() + r"(?:$|[^\p{L}\p{N}_])")) for t in R.TECHNOLOGIES)
    return f"concat_ws(', ', {hits})"


_DOC_TEXT = "lower(text)"
_DOC_AREA = AREA.replace(_TEXT, _DOC_TEXT)


@query("q_doc_areas", f"SELECT doc_id, {_DOC_AREA} AS job_area, {_tech_sql(_DOC_TEXT)} AS job_tech FROM documents")
def doc_areas(spark, sf):
    text = F.lower("text")
    return X.table(spark, sf, "documents", "doc_id", "text").select(
        "doc_id", contacts.job_area(text).alias("job_area"), F.array_join(contacts.technologies(text), ", ").alias("job_tech"))


_SIGNALS = (f"(CASE WHEN contains(about, lower(job_area)) THEN 2 ELSE 0 END + CASE WHEN {O.any_of('about', R.MANAGER_PLACES)} THEN 1 ELSE 0 END "
            f"+ CASE WHEN {O.any_of('about', R.TEAM_WORDS)} THEN 1 ELSE 0 END)")
CONFIDENCE = (f"CASE WHEN tier IS NULL THEN 'NONE' WHEN tier = 0 THEN CASE WHEN {_SIGNALS} >= 2 THEN 'HIGH' ELSE 'MEDIUM' END "
              f"WHEN {O.any_of('about', R.RECRUITER_PLACES)} THEN 'HIGH' ELSE 'MEDIUM' END")
MATCHED = f"""
matched AS (
 SELECT p.*, u.* EXCLUDE (company_key, area), {CONFIDENCE} AS level FROM (
  SELECT *, {AREA} AS job_area, {_tech_sql(_TEXT)} AS job_tech FROM picked) p LEFT JOIN usable u
  ON u.company_key = {O.ckey('p.company')} AND (u.area IS NULL OR u.area = p.job_area)
 QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY tier, u.query_ordinal, result_ordinal) = 1)"""
MATCHED = MATCHED.replace("SELECT p.*, u.* EXCLUDE (company_key, area)",
                          "SELECT p.* , u.tier, u.name, u.role, u.about, u.profile_url").replace("ORDER BY tier,", "ORDER BY u.tier,")
OUTREACH_BASE = [P, O.PREFILTERED, O.DEDUPED, O.CUSTOMERS, DIRECTORY]
_REC = "CASE level WHEN 'HIGH' THEN 'YES' WHEN 'MEDIUM' THEN 'VERIFY_FIRST' ELSE 'NO' END"


def _outreach(spark, sf):
    return contacts.with_outreach(
        candidates(X.postings(spark, sf)), contacts.best_contact(X.contact_directory(spark, sf)), X.person(spark))


@query("q_confidence", O.with_([*OUTREACH_BASE, "picked AS (SELECT * FROM deduped)", MATCHED], f"""SELECT job_id, level AS confidence,
 {_REC} AS recommendation, CASE WHEN tier IS NULL THEN 'NONE' WHEN tier = 0 THEN 'HIRING_MANAGER' ELSE 'RECRUITER' END AS target_type
 FROM matched"""))
def confidence(spark, sf):
    o = F.col("human_outreach")
    return _outreach(spark, sf).select(
        "job_id", o["confidence"].alias("confidence"), o["outreach_recommendation"].alias("recommendation"),
        o["target_type"].alias("target_type"))


_RETRIEVAL = "(contains(lower(concat(title, ' ', job_area)), 'rag') OR regexp_matches(job_tech, 'RAG|LLMs|FastAPI'))"
_MESSAGE = (f"CASE WHEN level <> 'NONE' THEN concat('Hi ', upper(name[1]), lower(string_split(name, ' ')[1])[2:], ' — I applied for the ', title, "
            f"' position today.\n\nI saw the work your team is doing in this area. I recently ', proof, ', so the overlap with the vacancy stood out to me."
            f"\n\nI wanted to introduce myself directly after submitting my official application. Thanks for taking a look!') END")


@query("q_facts_message", O.with_([*OUTREACH_BASE, "picked AS (SELECT * FROM deduped)", MATCHED], f"""
SELECT job_id, proof, {_MESSAGE} AS message FROM (
 SELECT *, CASE WHEN level = 'NONE' THEN NULL WHEN {_RETRIEVAL} THEN
  'built an end-to-end RAG and semantic search pipeline using FastAPI and vector search' ELSE
  'developed an asynchronous data pipeline in Python with automated scraping, strict regex filtering, and CI/CD' END AS proof
 FROM matched)"""))
def facts_message(spark, sf):
    o = F.col("human_outreach")
    return _outreach(spark, sf).select("job_id", o["candidate_proof"].alias("proof"), o["suggested_message"].alias("message"))


_EVIDENCE = (f"CASE WHEN tier = 0 THEN concat_ws('|', CASE WHEN contains(about, lower(job_area)) THEN concat('Cargo diretamente ligado à área da vaga (', job_area, ').') END, "
             f"CASE WHEN {O.any_of('about', R.MANAGER_PLACES)} THEN 'Localização compatível com a posição anunciada.' END, "
             f"CASE WHEN {O.any_of('about', R.TEAM_WORDS)} THEN 'Sinais públicos de gestão e liderança técnica na equipa.' END, "
             f"concat('Atua como ', role, ' na empresa ', company, '.')) WHEN tier = 1 THEN concat_ws('|', "
             f"concat('Recrutador(a) técnico(a) identificado(a) na empresa ', company, '.'), "
             f"CASE WHEN {O.any_of('about', R.RECRUITER_PLACES)} THEN 'Foco em recrutamento técnico na região relevante.' END) ELSE '' END")


@query("q_evidence", O.with_([*OUTREACH_BASE, "picked AS (SELECT * FROM deduped)", MATCHED],
                             f"SELECT job_id, {_EVIDENCE} AS evidence FROM matched"))
def evidence(spark, sf):
    return _outreach(spark, sf).select("job_id", F.array_join("human_outreach.evidence", "|").alias("evidence"))


@query("q_topn_enrich", O.with_([*RANKED, O.RANKED, O.CUSTOMERS, DIRECTORY, "picked AS (SELECT * FROM ranked WHERE rank <= 10)", MATCHED], f"""
SELECT r.rank, r.job_id, CASE WHEN m.job_id IS NULL THEN NULL ELSE m.level END AS confidence
FROM ranked r LEFT JOIN matched m ON m.job_id = r.job_id"""))
def topn_enrich(spark, sf):
    rows = ranking.ranked(_eligible(spark, sf))
    wanted = contacts.contacts_for(X.contact_directory(spark, sf), rows.filter("rank <= 10"))
    return contacts.enrich_top(rows, contacts.best_contact(wanted), X.person(spark), 10).select(
        "rank", "job_id", F.col("human_outreach.confidence").alias("confidence"))


# --- exports ------------------------------------------------------------------------


def _export(spark, sf):
    return conform(rated_by_profile(spark, sf).withColumn("rating_score", finite_or_zero(F.col("rating_score"))),
                   run_ts=X.RUN_TS)


_EXPORT_SQL = f"""SELECT job_id, title, company, category, company_score, {O.FINITE} AS rating_score, tag AS tags,
 {O.q(X.RUN_TS)} AS fetched_at FROM rated"""


@query("q_json_roundtrip", O.with_(BY_PROFILE, _EXPORT_SQL))
def json_roundtrip(spark, sf):
    path = scratch_path(spark, "json")
    sinks.write_json(_export(spark, sf), path)
    return read_published(spark, path).select(
        "job_id", "title", "company", "category", "company_score", "rating_score",
        F.array_join("tags", ",").alias("tags"), "fetched_at")


@query("q_csv_roundtrip", O.with_(BY_PROFILE, _EXPORT_SQL.replace("tag AS tags", "concat('[\"', tag, '\"]') AS tags")
                                  .replace("company_score,", "coalesce(company_score, '') AS company_score,")))
def csv_roundtrip(spark, sf):
    path = scratch_path(spark, "csv")
    sinks.write_csv(_export(spark, sf), path)
    return sinks.read_csv(spark, path).select(
        "job_id", "title", "company", "category", "company_score", F.col("rating_score").try_cast("double").alias("rating_score"),
        "tags", "fetched_at")


@query("q_empty_publish", O.with_([P], "SELECT count(*) AS n, 20 AS n_columns FROM postings WHERE title = 'no such title'"))
def empty_publish(spark, sf):
    """A run without rows replaces the rows of the run before it."""
    path = scratch_path(spark, "publish")
    rows = conform(X.postings(spark, sf), run_ts=X.RUN_TS)
    sinks.write_table(rows, path)
    sinks.write_table(rows.filter(F.col("title") == "no such title"), path)
    back = spark.read.parquet(path)
    return back.agg(F.count(F.lit(1)).alias("n")).withColumn("n_columns", F.lit(len(back.columns)))


@query("q_report", O.with_(RANKED, f"""SELECT section, row_number() OVER (PARTITION BY section ORDER BY {O.RATING_ORDER}) AS section_rank,
 title AS title_text, {O.q(R.RECENT)} AS posted_text, coalesce(replace(company_score, '&', '&amp;'), '') AS score_text, job_url AS job_link
 FROM (SELECT *, {SECTION} AS section FROM eligible)"""))
def report_table(spark, sf):
    path = scratch_path(spark, "report")
    rows = conform(_eligible(spark, sf), "query_ordinal", "item_ordinal", run_ts=X.RUN_TS)
    sinks.write_report(report.report(rows), path)
    return spark.read.parquet(path).select(
        "section", "section_rank", "title_text", "posted_text", "score_text", "job_link")
