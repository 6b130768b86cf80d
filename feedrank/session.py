"""Session settings and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime settings the plans are designed for; all can be set on a live session.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join partition even where that costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession, **settings: str) -> SparkSession:
    for key, value in {**SETTINGS, **settings}.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without the setting gets a temporary folder; on a
    cluster that would not be visible to other machines, so it is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    root = tempfile.mkdtemp(prefix="feedrank-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{checkpoint_root(spark)}/feedrank/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write the frame once and read it back.

    Cuts the lineage with a table that outlives lost executors. Parquet rather
    than an RDD checkpoint, so later passes read only the columns they use.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a small file.

    A file of one row group is read by one task, and every narrow step after it
    would run there. Only a scan with fewer splits than cores is redistributed;
    a large table has more splits than cores and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once a row.

    A filter on a plain column is pushed below it with a copy of its expression,
    so the expression would be computed twice; no filter passes a generator's output.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


SMALL_ROWS = 100_000


def broadcast_if_small(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Hint a broadcast only after counting the rows; otherwise a shuffled join.

    For narrow frames (keys and numbers) whose other side is wide: without the
    hint the wide side would be shuffled before the small one is measured.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
