"""Request manifest, row limits and the page status gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import rules as R
from ..schema import request_keys
from ..session import broadcast_if_small


def manifest(spark: SparkSession, requests=R.REQUESTS) -> DataFrame:
    """(query_ordinal, source, query, row_limit, base_location), in request order."""
    rows = [(i, *request) for i, request in enumerate(requests)]
    return spark.createDataFrame(
        rows, "query_ordinal int, source string, query string, row_limit int, base_location string"
    )


def ok_pages(captures: DataFrame) -> DataFrame:
    """Pages with status 200 before the first other status of their request, run by run.

    The first bad page per request is an aggregate over three narrow columns. It
    is counted before it is broadcast, so page bodies are not shuffled and a
    request with very many pages is never gathered in one task.
    """
    stops = (
        captures.filter(F.coalesce(F.col("status"), F.lit(0)) != 200)
        .groupBy(*request_keys(captures))
        .agg(F.min("page_no").alias("_stop"))
    )
    return (
        captures.filter(F.col("status") == 200)
        .join(broadcast_if_small(stops), request_keys(captures), "left")
        .filter(F.col("_stop").isNull() | (F.col("page_no") < F.col("_stop")))
        .drop("_stop")
    )


def limit_per_request(df: DataFrame, limit: int, order: str = "item_ordinal") -> DataFrame:
    """First ``limit`` rows of each request.

    ``row_number() <= constant`` lets Spark cut each map task to ``limit`` rows
    per request before the shuffle, so a large request costs tasks x limit rows.
    """
    w = Window.partitionBy(*request_keys(df)).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit).drop("_n")


def limit_by_manifest(df: DataFrame, requests: DataFrame, order: str = "item_ordinal") -> DataFrame:
    """Row limit taken from the manifest; requests without a limit keep all rows.

    Ranks are only needed where a limit exists, and only up to the largest one,
    which keeps the map-side cut. A row of a request without a limit is a group
    of its own, so one pass serves both and no such request is gathered. Runs
    are limited each for itself.
    """
    limits = requests.filter(F.col("row_limit").isNotNull()).select("source", "query_ordinal", "row_limit")
    largest = limits.agg(F.max("row_limit")).first()[0]
    if largest is None:
        return df
    marked = df.join(broadcast_if_small(limits), ["source", "query_ordinal"], "left").withColumn(
        "_alone", F.when(F.col("row_limit").isNull(), F.monotonically_increasing_id())
    )
    w = Window.partitionBy(*request_keys(df), "_alone").orderBy(order)
    return (
        marked.withColumn("_n", F.row_number().over(w))
        .filter(F.col("_n") <= max(1, int(largest)))
        .filter(F.col("row_limit").isNull() | (F.col("_n") <= F.col("row_limit")))
        .select(*df.columns)
    )


def union_feeds(*feeds: DataFrame) -> DataFrame:
    """All feeds in one frame; list order is in the ordinal columns."""
    first, *rest = feeds
    for feed in rest:
        first = first.unionByName(feed, allowMissingColumns=True)
    return first
