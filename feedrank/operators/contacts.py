"""Outreach records for the top postings: area, contact, facts, message."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.names import company_key
from ..functions.text import blank_to_null, contains_any, filled, quote_java, strip, title_case, truthy, FLAG_WORDS
from ..functions.urls import strip_query
from ..schema import OUTREACH
from .ranking import top_n


def posting_text(title: Column, description: Column, tags: Column) -> Column:
    blank = F.lit("")
    return F.lower(
        F.concat_ws(" ", F.coalesce(title, blank), F.coalesce(description, blank),
                    F.array_join(F.coalesce(tags, F.array().cast("array<string>")), " "))
    )


def job_area(text: Column) -> Column:
    """Area of a lower-case posting text. Words count as substrings."""
    area = None
    for name, words in R.AREAS:
        hit = contains_any(text, words)
        area = F.when(hit, F.lit(name)) if area is None else area.when(hit, F.lit(name))
    return area.otherwise(F.lit(R.AREA_DEFAULT))


def technologies(text: Column) -> Column:
    """Known technologies found as whole words, in list order."""
    return F.array_compact(
        F.array(*[
            F.when(text.rlike(rf"(?U)\b{quote_java(t.lower())}\b"), F.lit(t)) for t in R.TECHNOLOGIES
        ])
    )


def parse_contact(title: Column) -> tuple[Column, Column, Column]:
    """(name, role, is_person) from a result title like "Name - Role - Company | Site"."""
    clean = strip(F.regexp_replace(F.coalesce(title, F.lit("")), r"(?isU)\s*\|\s*LinkedIn.*$", ""))
    parts = F.filter(F.transform(F.split(clean, "-"), strip), lambda p: p != "")
    name = F.get(parts, 0)
    role = F.coalesce(F.get(parts, 1), F.lit(""))
    words = F.size(F.split(strip(name), r"(?U)\s+"))
    person = name.isNotNull() & (words <= 5) & ~contains_any(F.lower(name), R.GENERIC_NAME_WORDS)
    return name, role, F.coalesce(person, F.lit(False))


def contact_results(directory: DataFrame) -> DataFrame:
    """Parse captured people-search results and keep usable contacts.

    ``directory``: (company_key, area, tier, query_ordinal, result_ordinal,
    title, link, snippet); tier 0 manager queries, 1 recruiter queries; area
    null when the query does not name one. Adds name, role, profile_url and
    ``about`` (lower-case role and snippet).
    """
    name, role, person = parse_contact(F.col("title"))
    about = F.lower(F.concat(role, F.lit(" "), F.coalesce(F.col("snippet"), F.lit(""))))
    manager = contains_any(about, R.MANAGER_PHRASES) & ~contains_any(about, R.EXECUTIVE_PHRASES)
    recruiter = contains_any(about, R.RECRUITER_PHRASES)
    return (
        directory.filter(F.col("result_ordinal") < R.RESULTS_PER_QUERY)
        .filter((F.coalesce(F.col("title"), F.lit("")) != "") & (F.coalesce(F.col("link"), F.lit("")) != ""))
        .withColumns({"name": name, "role": role, "about": about, "_person": person})
        .filter(F.col("_person") & F.when(F.col("tier") == 0, manager).otherwise(recruiter))
        .withColumn("profile_url", profile_link(F.col("link")))
        .drop("_person")
    )


def profile_link(link: Column) -> Column:
    """Link without query when it is a personal profile, else the link as it is."""
    short = strip_query(link)
    return F.when(F.contains(short, F.lit("linkedin.com/in/")), short).otherwise(link)


def best_contact(directory: DataFrame) -> DataFrame:
    """First usable contact of each (company_key, area): managers, then recruiters.

    Aggregated before any join, so a company with many postings or many
    results adds one row per area.
    """
    found = contact_results(directory)
    rest = ["tier", "query_ordinal", "result_ordinal", "name", "role", "about", "profile_url"]
    return (
        found.groupBy("company_key", "area")
        .agg(F.min_by(F.struct(*rest), F.struct("tier", "query_ordinal", "result_ordinal")).alias("contact"))
    )


def attach_contact(postings: DataFrame, contacts: DataFrame) -> DataFrame:
    """Join the best contact: of the posting's area and of any area, first one wins."""
    had_key = "company_key" in postings.columns
    keyed = postings.withColumn("company_key", company_key(F.col("company")))
    own = contacts.filter(F.col("area").isNotNull()).select(
        "company_key", F.col("area").alias("job_area"), F.col("contact").alias("_own"))
    general = contacts.filter(F.col("area").isNull()).select("company_key", F.col("contact").alias("_any"))
    place = lambda c: F.struct(F.col(c)["tier"], F.col(c)["query_ordinal"], F.col(c)["result_ordinal"])
    first = (
        F.when(F.col("_own").isNull(), F.col("_any"))
        .when(F.col("_any").isNull(), F.col("_own"))
        .when(place("_own") <= place("_any"), F.col("_own"))
        .otherwise(F.col("_any"))
    )
    return (
        keyed.join(own, ["company_key", "job_area"], "left")
        .join(general, "company_key", "left")
        .withColumn("contact", first)
        .drop("_own", "_any", *([] if had_key else ["company_key"]))
    )


def confidence(contact: Column, area: Column) -> Column:
    """HIGH or MEDIUM for a contact, NONE without one."""
    about = contact["about"]
    signals = (
        F.when(F.contains(about, F.lower(area)), F.lit(2)).otherwise(F.lit(0))
        + F.when(contains_any(about, R.MANAGER_PLACES), F.lit(1)).otherwise(F.lit(0))
        + F.when(contains_any(about, R.TEAM_WORDS), F.lit(1)).otherwise(F.lit(0))
    )
    manager = F.when(signals >= 2, F.lit("HIGH")).otherwise(F.lit("MEDIUM"))
    recruiter = F.when(contains_any(about, R.RECRUITER_PLACES), F.lit("HIGH")).otherwise(F.lit("MEDIUM"))
    return F.when(contact.isNull(), F.lit("NONE")).when(contact["tier"] == 0, manager).otherwise(recruiter)


def evidence(contact: Column, area: Column, company: Column, texts: dict[str, str] = R.EVIDENCE_TEXTS) -> Column:
    """Reasons in rule order."""
    about, firm = contact["about"], strip(company)
    manager = F.array_compact(F.array(
        F.when(F.contains(about, F.lower(area)), filled(texts["area"], area=area)),
        F.when(contains_any(about, R.MANAGER_PLACES), F.lit(texts["place"])),
        F.when(contains_any(about, R.TEAM_WORDS), F.lit(texts["team"])),
        filled(texts["role"], role=contact["role"], company=firm),
    ))
    recruiter = F.array_compact(F.array(
        filled(texts["recruiter"], company=firm),
        F.when(contains_any(about, R.RECRUITER_PLACES), F.lit(texts["region"])),
    ))
    return F.when(contact["tier"] == 0, manager).otherwise(recruiter)


def recommendation(level: Column) -> Column:
    return (
        F.when(level == "HIGH", F.lit("YES")).when(level == "MEDIUM", F.lit("VERIFY_FIRST")).otherwise(F.lit("NO"))
    )


RETRIEVAL_WORDS = ("rag", "semantic")  # fixed values: words in project names
AGGREGATOR_WORDS = ("aggregator", "autonomous")


@dataclass(frozen=True)
class ProfileFacts:
    """What the facts need to know of a profile."""

    retrieval_project: bool = False
    aggregator_project: bool = False
    python_and_pytorch: bool = False


def profile_facts(profile: DataFrame) -> ProfileFacts | None:
    """Read the profile document (one row). None without one: nothing is enriched."""
    def has_project(words):
        return F.coalesce(
            F.exists("projects", lambda p: contains_any(F.lower(F.coalesce(p["name"], F.lit(""))), words)), F.lit(False))

    row = profile.select(
        has_project(RETRIEVAL_WORDS).alias("a"),
        has_project(AGGREGATOR_WORDS).alias("b"),
        F.coalesce(F.array_contains("skills", "Python") & F.array_contains("skills", "PyTorch"), F.lit(False)).alias("c"),
    ).first()
    return None if row is None else ProfileFacts(row.a, row.b, row.c)


def facts(
    title: Column, area: Column, tech: Column, known: ProfileFacts, texts: dict[str, tuple[str, str]] = R.CLAIM_TEXTS
) -> tuple[Column, Column]:
    """(hook, proof) backed by the profile: a fitting project, else its skills."""
    wants_retrieval = F.contains(F.lower(F.concat(title, F.lit(" "), area)), F.lit("rag")) | F.exists(
        tech, lambda t: F.lower(t).isin("rag", "llms", "fastapi"))
    tests = {
        "retrieval": wants_retrieval & F.lit(known.retrieval_project),
        "aggregator": F.lit(known.aggregator_project),
        "skills": F.lit(known.python_and_pytorch),
    }

    def chosen(which: int) -> Column:
        text = {name: filled(pair[which], title=title, area=area) for name, pair in texts.items()}
        out = None
        for name, test in tests.items():
            out = F.when(test, text[name]) if out is None else out.when(test, text[name])
        return out.otherwise(text["none"])

    return chosen(1), chosen(0)


def message(name: Column, title: Column, proof: Column, level: Column, text: str = R.MESSAGE_TEXT) -> Column:
    """Short introduction; only for HIGH and MEDIUM confidence."""
    first = F.coalesce(title_case(blank_to_null(F.get(F.split(strip(name), r"(?U)\s+"), 0))), F.lit("there"))
    return F.when(level.isin("HIGH", "MEDIUM"), filled(text, name=first, title=title, proof=proof))


def empty_outreach() -> Column:
    values = {
        "target_found": F.lit(False),
        "target_type": F.lit("NONE"),
        "confidence": F.lit("NONE"),
        "outreach_recommendation": F.lit("NO"),
        "evidence": F.array(),
    }
    return F.struct(
        *[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in OUTREACH.fields]
    )


def with_area(df: DataFrame) -> DataFrame:
    """Add job_area and job_tech."""
    text = posting_text(F.col("title"), F.col("description_snippet"), F.col("tags"))
    return df.withColumn("_text", text).withColumns(
        {"job_area": job_area(F.col("_text")), "job_tech": technologies(F.col("_text"))}
    ).drop("_text")


def with_outreach(df: DataFrame, contacts: DataFrame, profile: DataFrame) -> DataFrame:
    """Outreach record for every row of ``df``.

    ``profile`` is one nested row; without a row nothing is enriched.
    """
    rest = [c for c in df.columns if c != "human_outreach"]
    known = profile_facts(profile)
    if known is None:
        return df.select(*rest, F.lit(None).cast(OUTREACH).alias("human_outreach"))
    rows = attach_contact(with_area(df), contacts)
    contact, area, company = F.col("contact"), F.col("job_area"), F.col("company")
    level = confidence(contact, area)
    hook, proof = facts(F.col("title"), area, F.col("job_tech"), known)
    filled = F.struct(
        F.lit(True).alias("target_found"),
        F.when(contact["tier"] == 0, F.lit("HIRING_MANAGER")).otherwise(F.lit("RECRUITER")).alias("target_type"),
        contact["name"].alias("name"),
        contact["role"].alias("current_title"),
        company.alias("company"),
        contact["profile_url"].alias("profile_url"),
        F.col("_level").alias("confidence"),
        recommendation(F.col("_level")).alias("outreach_recommendation"),
        evidence(contact, area, company).alias("evidence"),
        hook.alias("personalization_hook"),
        proof.alias("candidate_proof"),
        message(contact["name"], F.col("title"), proof, F.col("_level")).alias("suggested_message"),
    )
    record = F.when(contact.isNull(), empty_outreach()).otherwise(filled)
    return (
        rows.withColumn("_level", level)
        .withColumn("human_outreach", record)
        .select(*rest, "human_outreach")
    )


def contacts_for(directory: DataFrame, top: DataFrame) -> DataFrame:
    """Search results of the companies of ``top``, which must be few (a top N): only they are parsed."""
    return directory.join(F.broadcast(top.select("company_key").distinct()), "company_key", "left_semi")


def enrich_top(
    ranked: DataFrame,
    contacts: DataFrame,
    profile: DataFrame,
    n: int = 10,
    enabled: bool = True,
    key: str = "dedup_key",
) -> DataFrame:
    """Outreach records for the first ``n`` postings; the others keep null.

    The top rows are chosen first, enriched alone, and joined back: n rows,
    whatever the size of the list. Order columns stay as they are.
    """
    rest = [c for c in ranked.columns if c != "human_outreach"]
    if not enabled or n == 0:
        return ranked.select(*rest, F.lit(None).cast(OUTREACH).alias("human_outreach"))
    top = with_outreach(top_n(ranked, n), contacts, profile).select(key, "human_outreach")
    if n <= 100_000:
        top = F.broadcast(top)
    return ranked.select(*rest).join(top, key, "left")


def is_enabled(flag: Column) -> Column:
    """Feature flag text: true, 1, yes or on."""
    return truthy(flag, FLAG_WORDS)


def flag_enabled(text: str | None) -> bool:
    return (text if text is not None else "true").strip().lower() in FLAG_WORDS


def lookup_cap(text: str | None, default: int = 10) -> int:
    """Integer cap from option text; unreadable text gives the default."""
    try:
        value = int((text if text is not None else str(default)).strip())
    except ValueError:
        return default
    if value < 0:
        raise ValueError("the cap must not be negative")
    return value
