"""Title rules: exclusion, entry-level marker, topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.text import matches_any, strip
from ..session import once


def is_excluded(title: Column, company: Column, rules: R.Rules = R.DEFAULT_RULES) -> Column:
    """Blocked employer in company or title, or an excluded title. Always wins."""
    return (
        matches_any(company, rules.blocked)
        | matches_any(title, rules.blocked)
        | matches_any(title, rules.exclude)
    )


def has_entry_marker(title: Column, rules: R.Rules = R.DEFAULT_RULES) -> Column:
    return matches_any(title, rules.entry)


def topic(title: Column, tags: Column, rules: R.Rules = R.DEFAULT_RULES) -> Column:
    """"AI", "SWE" or null; the title decides before the tags do.

    Free text is not an argument: a description must not change the topic.
    """
    tag_text = F.array_join(tags, " ")
    return (
        F.when(matches_any(title, rules.ai), F.lit("AI"))
        .when(matches_any(title, rules.software), F.lit("SWE"))
        .when(matches_any(tag_text, rules.ai), F.lit("AI"))
        .when(matches_any(tag_text, rules.software), F.lit("SWE"))
    )


def prefilter(df: DataFrame, rules: R.Rules = R.DEFAULT_RULES) -> DataFrame:
    """Keep explicit entry-level postings of a known topic. Narrow, no shuffle."""
    title = strip(F.coalesce(F.col("title"), F.lit("")))
    kept = (
        df.filter(has_entry_marker(title, rules))
        .filter(~is_excluded(title, F.col("company"), rules))
    )
    return (
        once(kept, topic=topic(title, F.col("tags"), rules))
        .filter(F.col("topic").isNotNull())
        .withColumns(
            {
                "category": F.when(F.col("topic") == "AI", F.lit(R.CATEGORY_AI)).otherwise(
                    F.lit(R.CATEGORY_SWE)
                ),
                "seniority": F.lit(R.SENIORITY_LABEL),
            }
        )
    )


def is_eligible(category: Column, score: Column, min_score: float = R.MIN_SCORE) -> Column:
    """AI postings always; software postings with a finite score of min_score."""
    from ..functions.scores import finite_or_zero

    return F.coalesce(
        (category == R.CATEGORY_AI)
        | ((category == R.CATEGORY_SWE) & (finite_or_zero(score) >= min_score)),
        F.lit(False),
    )
