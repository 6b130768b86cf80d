"""Report tables: sections, badges, totals, display columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.chars import literal_map
from ..functions.text import blank_to_null, contains_any, html_escape
from ..functions.urls import safe_url
from .ranking import rating_order, with_position


def section(location: Column, modality: Column) -> Column:
    """1 listed places, 2 remote, 3 the rest; first match wins."""
    place = F.lower(F.coalesce(location, F.lit("")))
    mode = F.lower(F.coalesce(modality, F.lit("")))
    return (
        F.when(contains_any(place, R.SECTION_ONE_PLACES), F.lit(1))
        .when(contains_any(mode, R.SECTION_TWO_MODALITIES) | contains_any(place, R.SECTION_TWO_PLACES), F.lit(2))
        .otherwise(F.lit(3))
    )


def with_sections(df: DataFrame) -> DataFrame:
    """Add ``section`` and the position inside it (``section_rank``)."""
    cut = df.withColumn("section", section(F.col("location"), F.col("modality")))
    return with_position(cut, "section_rank", rating_order(cut), groups=["section"])


def section_counts(df: DataFrame) -> DataFrame:
    """Rows per section, empty sections included."""
    titles = df.sparkSession.createDataFrame(list(R.SECTION_TITLES.items()), "section int, section_title string")
    counts = df.groupBy(section(F.col("location"), F.col("modality")).alias("section")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return titles.join(counts, "section", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def category_badge(category: Column) -> Column:
    topical = F.contains(F.lower(F.coalesce(category, F.lit(R.CATEGORY_AI))), F.lit("ai"))
    return F.when(topical, F.lit(R.CATEGORY_BADGES[0])).otherwise(F.lit(R.CATEGORY_BADGES[1]))


def rating_badge(score: Column, url: Column) -> Column:
    """primary, fallback, plain (no usable link) or none (no score)."""
    link = safe_url(F.coalesce(url, F.lit("")))
    scored = F.coalesce(score, F.lit("")) != ""
    primary = F.contains(F.lower(link), F.lit(R.PRIMARY_PLATFORM.lower()))
    return (
        F.when(scored & (link != ""), F.when(primary, F.lit("primary")).otherwise(F.lit("fallback")))
        .when(scored, F.lit("plain"))
        .otherwise(F.lit("none"))
    )


def source_colour(source: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(R.SOURCE_COLOURS), source), F.lit(R.SOURCE_COLOUR_DEFAULT))


def with_badges(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "category_badge": category_badge(F.col("category")),
            "rating_badge": rating_badge(F.col("company_score"), F.col("rating_url")),
            "source_colour": source_colour(F.col("source")),
        }
    )


def contact_card(outreach: Column) -> dict[str, Column]:
    """Columns of the contact block, null when no contact was found."""
    found = F.coalesce(outreach["target_found"], F.lit(False))
    pick = lambda c, default: F.when(found, html_escape(F.coalesce(blank_to_null(c), F.lit(default))))
    return {
        "contact_name": pick(outreach["name"], R.CONTACT_DEFAULTS["name"]),
        "contact_role": pick(outreach["current_title"], R.CONTACT_DEFAULTS["role"]),
        "contact_confidence": pick(outreach["confidence"], R.CONTACT_DEFAULTS["confidence"]),
        "contact_evidence": pick(F.get(outreach["evidence"], 0), R.CONTACT_DEFAULTS["evidence"]),
        "contact_link": F.when(found, safe_url(F.coalesce(outreach["profile_url"], F.lit("")))),
        "contact_hook": pick(outreach["personalization_hook"], ""),
        "contact_message": pick(outreach["suggested_message"], ""),
        "contact_colour": F.when(
            found,
            F.when(outreach["confidence"] == "HIGH", F.lit(R.CONFIDENCE_COLOURS[0])).otherwise(
                F.lit(R.CONFIDENCE_COLOURS[1])
            ),
        ),
    }


def report(df: DataFrame) -> DataFrame:
    """The report table: section, place in it, and every column shown."""
    e = lambda name: html_escape(F.coalesce(F.col(name), F.lit("")))
    rows = with_badges(with_sections(df))
    columns = {
        "title_text": e("title"),
        "company_text": e("company"),
        "location_text": e("location"),
        "modality_text": html_escape(F.coalesce(F.col("modality"), F.lit(R.MODALITY_DEFAULT))),
        "posted_text": html_escape(F.coalesce(blank_to_null(F.col("post_date")), F.lit(R.RECENT))),
        "score_text": e("company_score"),
        "reviews_text": e("company_reviews"),
        "rating_link": safe_url(F.coalesce(F.col("rating_url"), F.lit(""))),
        "job_link": safe_url(F.coalesce(F.col("job_url"), F.lit(""))),
    }
    shown = rows.withColumns({**columns, **contact_card(F.col("human_outreach"))})
    return shown.select(
        "section",
        "section_rank",
        "source",
        "source_colour",
        "category_badge",
        "rating_badge",
        *columns,
        *contact_card(F.col("human_outreach")),
    )


def display(df: DataFrame) -> DataFrame:
    """The seven columns of the console listing."""
    scored = F.coalesce(F.col("company_score"), F.lit("")) != ""
    return df.select(
        F.when(scored, F.concat(F.col("company_score"), F.lit(" ("),
                                F.coalesce(F.col("company_reviews"), F.lit("None")), F.lit(")")))
        .otherwise(F.lit(R.NO_RATING))
        .alias("score"),
        "company",
        "title",
        "category",
        "location",
        "modality",
        "job_url",
    )
