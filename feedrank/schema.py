"""Record types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OUTREACH = T.StructType(
    [
        T.StructField("target_found", T.BooleanType()),
        T.StructField("target_type", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("current_title", T.StringType()),
        T.StructField("company", T.StringType()),
        T.StructField("profile_url", T.StringType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("outreach_recommendation", T.StringType()),
        T.StructField("evidence", T.ArrayType(T.StringType())),
        T.StructField("personalization_hook", T.StringType()),
        T.StructField("candidate_proof", T.StringType()),
        T.StructField("suggested_message", T.StringType()),
    ]
)

# The 20 exported fields, in export order.
POSTING = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("job_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("company", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("job_url", T.StringType()),
        T.StructField("modality", T.StringType()),
        T.StructField("seniority", T.StringType()),
        T.StructField("is_remote", T.BooleanType()),
        T.StructField("salary", T.StringType()),
        T.StructField("post_date", T.StringType()),
        T.StructField("company_score", T.StringType()),
        T.StructField("company_reviews", T.StringType()),
        T.StructField("rating_url", T.StringType()),
        T.StructField("rating_score", T.DoubleType()),
        T.StructField("category", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("description_snippet", T.StringType()),
        T.StructField("human_outreach", OUTREACH),
        T.StructField("fetched_at", T.StringType()),
    ]
)

RATING = T.StructType(
    [
        T.StructField("platform", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("numeric", T.DoubleType()),
        T.StructField("reviews", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("matched_name", T.StringType()),
        T.StructField("alias_match", T.BooleanType()),
        T.StructField("checked_at", T.LongType()),
    ]
)

RATING_STATE = T.StructType([T.StructField("company_key", T.StringType()), *RATING.fields])

CAPTURE = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("query_ordinal", T.IntegerType()),
        T.StructField("page_no", T.IntegerType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("body", T.StringType()),
        T.StructField("base_location", T.StringType()),
        T.StructField("captured_at", T.TimestampType()),
    ]
)

# A landing folder holds many runs; with this column a request is one of its run.
RUN = T.StructField("run_id", T.StringType())
CAPTURE_OF_RUN = T.StructType([*CAPTURE.fields, RUN])


def request_keys(df: DataFrame) -> list[str]:
    """Columns that name a request: the run where there is one, the feed, the request."""
    return [c for c in ("run_id", "source", "query_ordinal") if c in df.columns]


# Columns that carry the list order of the feeds through the plan.
ORDER_COLUMNS = ("query_ordinal", "item_ordinal")

_DEFAULTS = {
    "modality": "Unknown",
    "is_remote": False,
    "rating_score": 0.0,
    "category": "AI / ML",
}


def conform(df: DataFrame, *extra: str, run_ts: str | None = None) -> DataFrame:
    """Project to the posting schema, filling absent fields with their defaults.

    ``run_ts`` ("yyyy-MM-dd HH:mm:ss", UTC) becomes ``fetched_at``; it is an
    argument so that a rerun gives the same rows.
    """
    have = set(df.columns)

    def field(f: T.StructField) -> Column:
        if f.name == "fetched_at" and run_ts is not None:
            return F.lit(run_ts).alias(f.name)
        if f.name == "tags":
            empty = F.array().cast(f.dataType)
            return (F.coalesce(F.col("tags"), empty) if "tags" in have else empty).alias("tags")
        if f.name not in have:
            return F.lit(_DEFAULTS.get(f.name)).cast(f.dataType).alias(f.name)
        value = F.col(f.name)
        if f.name in _DEFAULTS:
            value = F.coalesce(value, F.lit(_DEFAULTS[f.name]))
        return value.cast(f.dataType).alias(f.name)

    return df.select(*[F.col(c) for c in extra], *[field(f) for f in POSTING.fields])
