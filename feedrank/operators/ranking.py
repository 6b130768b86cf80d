"""Total order, top N, global and per-group positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chars import casefold
from ..functions.scores import finite_or_zero
from ..schema import ORDER_COLUMNS
from ..session import materialize


def rating_order(df: DataFrame) -> list[Column]:
    """Score descending, company, title, URL; equal rows stay in feed order."""
    ties = [F.col(c) for c in ORDER_COLUMNS if c in df.columns]
    return [
        finite_or_zero(F.col("rating_score")).desc(),
        casefold(F.coalesce(F.col("company"), F.lit(""))),
        casefold(F.coalesce(F.col("title"), F.lit(""))),
        F.coalesce(F.col("job_url"), F.lit("")),
        *ties,
    ]


def top_n(df: DataFrame, n: int) -> DataFrame:
    """First ``n`` rows of the rating order (a top-k, not a full sort)."""
    if n < 0:
        raise ValueError("n must not be negative")
    return df.orderBy(*rating_order(df)).limit(n)


def with_position(
    df: DataFrame, name: str, order: Sequence[Column], groups: Sequence[str] = ()
) -> DataFrame:
    """Row numbers from 1 in ``order``, inside each group, without one big task.

    A window over everything, or over three report sections, would put a third
    of the table or more into one task. Here a range-partitioned sort lays the
    rows out over all tasks; the sorted rows are written once, with their
    partition and place in it, so that no recomputation can move a row; then
    each partition adds the number of rows before it. That table of offsets
    has one row per partition and group present in it.

    ``groups`` must have few distinct values (sections, categories).
    """
    laid_out = df.orderBy(*[F.col(g) for g in groups], *order).withColumn(
        "_at", F.monotonically_increasing_id()
    )
    rows = materialize(laid_out, "positions").withColumn("_part", F.shiftright("_at", 33))
    blocks = rows.groupBy("_part", *groups).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_start")
    )
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        "_part", *groups, "_start", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    # At most partitions x groups rows: safe to send to every task.
    return (
        rows.join(F.broadcast(offsets), ["_part", *groups])
        .withColumn(name, F.col("_at") - F.col("_start") + F.col("_before") + 1)
        .drop("_part", "_at", "_start", "_before")
        .select(*df.columns, name)
    )


def ranked(df: DataFrame, name: str = "rank") -> DataFrame:
    """Global position of every row in the rating order."""
    return with_position(df, name, rating_order(df))
