"""First-seen selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import dedup_key
from ..schema import ORDER_COLUMNS, request_keys


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key: the first in ``order``.

    An aggregate, so every map task first reduces its own rows to one per key;
    a key that holds a third of the table costs one row per task to shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
        .select(*keys, "_first.*")
        .select(*df.columns)
    )


def with_dedup_key(df: DataFrame) -> DataFrame:
    return df.withColumn("dedup_key", dedup_key(*map(F.col, ("job_url", "source", "job_id", "company", "title"))))


def first_seen(df: DataFrame, order: Sequence[str] = ORDER_COLUMNS) -> DataFrame:
    """Keep the first posting of every identity, in feed order.

    Of several runs the first by run_id counts. Call it after ``prefilter``: a rejected copy must not hide a kept one.
    """
    runs = [c for c in ("run_id",) if c in df.columns]
    return first_by(with_dedup_key(df), ["dedup_key"], [*runs, *order])


def dedup_in_feed(df: DataFrame, order: Sequence[str] = ORDER_COLUMNS) -> DataFrame:
    """First row per job id inside one request of one run; rows without id are dropped."""
    kept = df.filter(F.coalesce(F.col("job_id"), F.lit("")) != "")
    return first_by(kept, [*request_keys(df), "job_id"], order)
