"""Date expressions. All dates are UTC, whatever the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .text import blank_to_null

# Years 1 to 9999; outside there is no calendar date to show.
_MIN_EPOCH, _MAX_EPOCH = -62_135_596_800, 253_402_300_799


def epoch_to_date(seconds: Column) -> Column:
    """Epoch seconds to dd/MM/yyyy; null when out of range."""
    whole = F.floor(seconds)
    inside = whole.between(_MIN_EPOCH, _MAX_EPOCH)
    bounded = F.least(F.greatest(whole, F.lit(_MIN_EPOCH)), F.lit(_MAX_EPOCH)).cast("bigint")
    days = F.floor(bounded / 86_400).cast("int")
    return F.when(inside, F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), "dd/MM/yyyy"))


def posted_on(text: Column, number: Column) -> Column:
    """Display date of a feed value given as a number, as text, or not at all."""
    return (
        F.when(number.isNotNull(), F.coalesce(epoch_to_date(number), F.lit(rules.RECENT)))
        .otherwise(F.coalesce(blank_to_null(text), F.lit(rules.RECENT)))
    )


def day_month_in_text(text: Column) -> Column:
    """First "14 ago"-like date in the text."""
    months = "|".join(rules.MONTHS)
    return blank_to_null(F.regexp_extract(text, rf"(?iU)(\d{{1,2}}\s+(?:{months}))", 1))


def run_label(run_ts: Column) -> Column:
    return F.date_format(run_ts, "dd/MM/yyyy")
