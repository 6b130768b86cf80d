"""Rating state on storage: numbered snapshots, never overwritten while read.

A snapshot is a folder ``v=<n>``. Spark's committer writes ``_SUCCESS`` last,
so a snapshot without it (a job that died) is not seen; readers take the
largest complete one. Several versions stay, which also lets a streaming batch
that is run again start from the version before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .schema import RATING_STATE


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the complete snapshots, ascending (names only, no data)."""
    path, fs = _fs(spark, root)
    if not fs.exists(path):
        return []
    found = []
    for entry in fs.listStatus(path):
        name = entry.getPath().getName()
        if name.startswith("v=") and fs.exists(_fs(spark, f"{root}/{name}/_SUCCESS")[0]):
            found.append(int(name[2:]))
    return sorted(found)


def load_state(spark: SparkSession, root: str, schema=RATING_STATE, before: int | None = None) -> DataFrame:
    """Latest snapshot (or the latest below ``before``); empty when there is none."""
    known = [v for v in versions(spark, root) if before is None or v < before]
    if not known:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/v={known[-1]}")


def save_state(state: DataFrame, root: str, version: int | None = None) -> int:
    """Write the next snapshot and return its number.

    With ``version`` the write can be repeated: the same number is replaced.
    """
    known = versions(state.sparkSession, root)
    number = version if version is not None else (known[-1] + 1 if known else 1)
    state.write.mode("overwrite").parquet(f"{root}/v={number}")
    return number


def prune(spark: SparkSession, root: str, keep: int) -> None:
    """Delete all but the last ``keep`` complete snapshots."""
    for version in versions(spark, root)[:-keep]:
        path, fs = _fs(spark, f"{root}/v={version}")
        fs.delete(path, True)
