"""Score, salary and review expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .text import blank_to_null


def finite_or_zero(value: Column) -> Column:
    """Null, unparsable, NaN and infinite become 0.0.

    NaN compares as larger than every number in Spark, so this comes before
    any comparison or sort.
    """
    x = value.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def parse_score(text: Column, decimals: str = "[.,]") -> Column:
    """First 1-5 score in the text, with an optional decimal; else null."""
    found = F.regexp_extract(text, rf"([1-5](?:{decimals}[0-9])?)", 1)
    return F.replace(found, F.lit(","), F.lit(".")).try_cast("double")


def format_score(score: Column) -> Column:
    """"4.2/5", or the unrated label when there is no score."""
    return F.when(score.isNull(), F.lit(rules.UNRATED)).otherwise(F.format_string("%.1f/5", score))


def reviews_text(reviews: Column, default: Column) -> Column:
    """"12 Reviews" for a number, other text as it is, else ``default``."""
    return F.when(reviews.rlike("^[0-9]+$"), F.concat(reviews, F.lit(" Reviews"))).otherwise(
        F.coalesce(blank_to_null(reviews), default)
    )


def score_display(score: Column, platform: Column) -> Column:
    return F.when(score == rules.UNRATED, F.concat(F.lit("🔍 "), platform)).otherwise(
        F.concat(F.lit("★ "), score, F.lit(" ("), platform, F.lit(")"))
    )


def _grouped(number: Column) -> Column:
    """Thousands separators on the plain text of a number, fraction kept."""
    whole = F.regexp_extract(number, r"^(-?\d+)", 1)
    fraction = F.regexp_extract(number, r"(\.\d+)$", 1)
    return F.concat(F.regexp_replace(whole, r"(?<=\d)(?=(?:\d{3})+$)", ","), fraction)


def salary_range(low: Column, high: Column, currency: Column) -> Column:
    """"USD 1,000 - 2,000" from two numeric texts; null unless both are given."""
    numeric = r"^-?\d+(?:\.\d+)?$"
    return F.when(
        low.rlike(numeric) & high.rlike(numeric),
        F.concat(currency, F.lit(" "), _grouped(low), F.lit(" - "), _grouped(high)),
    )


def salary_in_text(text: Column) -> Column:
    """First amount or range with a currency sign."""
    found = F.regexp_extract(text, r"(?U)([€$]\s*[\d\s]+(?:-\s*[€$]?\s*[\d\s]+)?)", 1)
    return blank_to_null(F.regexp_replace(found, r"(?U)^\s+|\s+$", ""))
