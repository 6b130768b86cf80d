"""Landed captures: one row per response body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CAPTURE_OF_RUN
from ..session import broadcast_if_small

_ORDINAL_STEP = 2**32


def read_captures(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Captures written as parquet or JSON lines, with a fixed schema.

    Partition the landing folder by source or date: filters on them then skip
    whole folders.
    """
    return with_run(spark.read.schema(CAPTURE_OF_RUN).format(fmt).load(path))


def with_run(captures: DataFrame) -> DataFrame:
    """The run of every capture: its own, else the day it was captured on."""
    day = F.coalesce(F.date_format("captured_at", "yyyy-MM-dd"), F.lit(""))
    return captures.withColumn("run_id", F.coalesce("run_id", day) if "run_id" in captures.columns else day)


def read_bodies(
    spark: SparkSession, path: str, source: str, query_ordinal: int, status: int = 200
) -> DataFrame:
    """One file per response body (e.g. saved HTML), read whole."""
    files = spark.read.text(path, wholetext=True).select(
        F.col("value").alias("body"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_modification_time").alias("captured_at"),
    )
    return files.select(
        F.lit(source).alias("source"),
        F.lit(query_ordinal).alias("query_ordinal"),
        # "...-3.html" is page 3; a name without a number is page 0
        F.coalesce(F.regexp_extract("file", r"(\d+)\.[^./]*$", 1).try_cast("int"), F.lit(0)).alias("page_no"),
        F.lit(status).alias("status"),
        "body",
        F.lit(None).cast("string").alias("base_location"),
        "captured_at",
    )


def with_request(captures: DataFrame, manifest: DataFrame) -> DataFrame:
    """Add row_limit and the request location from the manifest of the run."""
    request = manifest.select("source", "query_ordinal", "row_limit", F.col("base_location").alias("_place"))
    return (
        captures.join(broadcast_if_small(request), ["source", "query_ordinal"], "left")
        .withColumn("base_location", F.coalesce("base_location", "_place"))
        .drop("_place")
    )


def item_ordinal(position: str = "_pos") -> Column:
    """Order of an item in its request: page, then place in the page."""
    return F.col("page_no").cast("bigint") * _ORDINAL_STEP + F.col(position)


def within_limit(df: DataFrame, position: str = "_pos") -> DataFrame:
    """Keep the first row_limit items of one response."""
    if "row_limit" not in df.columns:
        return df
    return df.filter(F.col("row_limit").isNull() | (F.col(position) < F.col("row_limit")))


def accepted(parsed: DataFrame) -> DataFrame:
    """Rows that satisfy the schema."""
    return parsed.filter(F.col("reject_reason").isNull()).drop("reject_reason", "raw")


def quarantine(parsed: DataFrame) -> DataFrame:
    """Rows set aside: one broken item never stops the rest of its feed."""
    return parsed.filter(F.col("reject_reason").isNotNull()).select(
        "source", F.col("reject_reason").alias("reason"), F.col("raw").alias("body"), "captured_at"
    )


def broken_bodies(captures: DataFrame, list_path: str | None = None) -> DataFrame:
    """JSON bodies that cannot be parsed at all, or that lack the feed's list at ``list_path``."""
    value = F.try_parse_json(F.coalesce("body", F.lit("")))
    reason = F.when(value.isNull(), F.lit("body is not JSON"))
    if list_path is not None:
        kind = F.coalesce(F.schema_of_variant(F.try_variant_get(value, list_path, "variant")), F.lit("ABSENT"))
        reason = reason.when(~F.startswith(kind, F.lit("ARRAY")), F.lit("body has no list of items"))
    return (
        captures.filter(F.col("status") == 200)
        .withColumn("reason", reason)
        .filter("reason is not null")
        .select("source", "reason", "body", "captured_at")
    )
