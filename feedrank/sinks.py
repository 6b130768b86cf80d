"""Exports: CSV, JSON lines, parquet, report table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schema import POSTING


def _flat(df: DataFrame) -> DataFrame:
    """CSV has no nested values: they are written as JSON text."""
    return df.select(*[
        F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))
        else F.col(f.name) for f in df.schema.fields
    ])


def write_csv(df: DataFrame, path: str) -> None:
    """The 20 fields, quoted, with a header; null is an empty quoted value."""
    flat = _flat(df.select(*[f.name for f in POSTING.fields]))
    (flat.write.mode("overwrite").option("header", True).option("quoteAll", True)
     .option("nullValue", "").option("emptyValue", "").option("escape", '"').csv(path))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([T.StructField(f.name, T.StringType()) for f in POSTING.fields])
    return (spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True)
            .option("emptyValue", "").option("nullValue", "\x00").csv(path))


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, nulls kept."""
    df.select(*[f.name for f in POSTING.fields]).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_table(df: DataFrame, path: str) -> None:
    """Publish a table. An empty run replaces the last one with an empty table."""
    df.write.mode("overwrite").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """Report rows in folders by section. A reader orders by section_rank."""
    report.write.mode("overwrite").partitionBy("section").parquet(path)
