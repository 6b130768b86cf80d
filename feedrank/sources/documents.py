"""Single JSON documents: rating cache, profile, published results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from ..schema import POSTING, RATING_STATE

PROFILE = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("skills", T.ArrayType(T.StringType())),
    T.StructField("projects", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("technologies", T.ArrayType(T.StringType())),
    ]))),
    T.StructField("education", T.ArrayType(T.StructType([
        T.StructField("degree", T.StringType()),
        T.StructField("institution", T.StringType()),
        T.StructField("status", T.StringType()),
    ]))),
    T.StructField("experience", T.ArrayType(T.StringType())),
])


def explode_cache(documents: DataFrame) -> DataFrame:
    """JSON objects keyed by company (column ``body``) to rating rows.

    A document of another shape gives no rows.
    """
    doc = F.try_parse_json(F.coalesce("body", F.lit("")))
    entry = F.col("entry")
    get = lambda key, kind: F.try_variant_get(entry, f"$.{key}", kind)
    return (
        documents.select(F.explode(F.try_variant_get(doc, "$", "map<string,variant>")).alias("company_key", "entry"))
        .filter(F.schema_of_variant("entry").startswith("OBJECT"))
        .select(
            "company_key",
            get("platform", "string").alias("platform"),
            get("score", "string").alias("score"),
            F.coalesce(get("numeric", "double"), get("numeric", "string").try_cast("double")).alias("numeric"),
            get("reviews", "string").alias("reviews"),
            get("url", "string").alias("url"),
            get("matched_name", "string").alias("matched_name"),
            get("alias_match", "boolean").alias("alias_match"),
            # fixed value: name of the time stamp in cache files
            F.coalesce(get("teamlyzer_checked_at", "bigint"),
                       get("teamlyzer_checked_at", "double").try_cast("bigint")).alias("checked_at"),
        )
    )


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Rating cache file; an absent file gives no rows."""
    try:
        text = spark.read.text(path, wholetext=True).withColumnRenamed("value", "body")
    except AnalysisException:
        return spark.createDataFrame([], RATING_STATE)
    return explode_cache(text)


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """Profile document; absent or unreadable gives an empty frame (no enrichment)."""
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], PROFILE)
    # A document that breaks off in the middle is rejected whole.
    whole = text.filter(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"))
    return whole.select(F.from_json("value", PROFILE).alias("p")).select("p.*")


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """Published postings (JSON lines)."""
    return spark.read.schema(POSTING).json(path)
