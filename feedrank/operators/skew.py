"""Equi-join with hot keys split over several tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small

ROWS_PER_SALT = 1_000_000


def hot_keys(counts: DataFrame, key: str, n: str, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Keys with more than ``rows_per_salt`` rows, and how often to split them.

    There are at most total_rows / rows_per_salt of them, whatever the skew.
    """
    return counts.filter(F.col(n) > rows_per_salt).select(
        key, F.ceil(F.col(n) / F.lit(rows_per_salt)).cast("int").alias("_salts")
    )


def salted_left_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, salt_on: str) -> DataFrame:
    """``left.join(right, key, "left")`` where hot keys are spread by ``salt_on``.

    Rows of a hot key go to one of its salts; the matching right rows (one or
    few per key) are repeated for each salt. Cold keys are not repeated. Exact.
    ``hot`` is small by construction, and counted before it is broadcast.
    """
    hot = broadcast_if_small(hot)
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    spread = (
        left.join(hot, key, "left")
        .withColumn("_salt", F.when(salts > 1, F.pmod(F.xxhash64(salt_on), salts)).otherwise(F.lit(0)).cast("int"))
        .drop("_salts")
    )
    repeated = (
        right.join(hot, key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("_salts")
    )
    return spread.join(repeated, [key, "_salt"], "left").drop("_salt")
