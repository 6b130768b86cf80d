"""The daily run as increments: captures that arrived since the last run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import rules as R
from ..ledger import Ledger
from ..operators.classify import prefilter
from ..operators.dedup import with_dedup_key
from ..operators.ratings import is_fresh, join_ratings
from ..operators.resolve import companies_of, with_company_key
from ..schema import CAPTURE, RATING
from ..session import materialize
from ..state import load_state, prune, save_state

SEEN_FOR = "7 days"
KEPT = 24  # snapshots of the check times
CHECKS = T.StructType([T.StructField("company_key", T.StringType()), T.StructField("checked_at", T.LongType())])


def read_stream(
    spark: SparkSession, path: str, schema: T.StructType = CAPTURE, fmt: str = "parquet", files_per_batch: int | None = None
) -> DataFrame:
    """New files of a landing folder."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def first_seen_stream(postings: DataFrame, seen_for: str = SEEN_FOR, rules: R.Rules = R.DEFAULT_RULES) -> DataFrame:
    """Rules, then one posting per identity.

    State is one key per posting seen within ``seen_for`` of event time and is
    dropped after that; a posting that comes back later enters again. The copy
    that arrives first is kept.
    """
    kept = with_dedup_key(prefilter(postings, rules))
    return kept.withWatermark("captured_at", seen_for).dropDuplicatesWithinWatermark(["dedup_key"])


def append_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process what has arrived, append it to a parquet folder, and stop."""
    (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).outputMode("append").start().awaitTermination())


def each_available(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Run ``batch(frame, batch_id)`` for each micro-batch of what has arrived."""
    (stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a checkpoint keeps for its stream over restarts."""
    return spark.read.json(f"{checkpoint}/metadata").first()["id"]


def rate_batches(stream: DataFrame, state: str | Ledger, out: str, checkpoint: str) -> None:
    """Join each batch to the newest rating state: the root of its snapshots, or a ledger.

    A ledger is asked for the companies of the batch only, where its buckets lie.

    The state is read again for every batch. Each batch of a stream owns a folder
    that a repeated batch replaces, so a retry cannot write rows twice; a stream
    with a new checkpoint has folders of its own. The batch is written once
    before the join reads it twice.
    """
    def batch(frame: DataFrame, batch_id: int) -> None:
        spark = frame.sparkSession
        rows = materialize(with_company_key(frame), "batch")
        companies = companies_of(rows)
        if isinstance(state, Ledger):
            ratings = state.lookup(companies.select("company_key"), "rating")
        else:
            ratings = load_state(spark, state).select("company_key", F.struct(*[f.name for f in RATING.fields]).alias("rating"))
        rated = join_ratings(rows, ratings, companies)
        rated.write.mode("overwrite").parquet(f"{out}/stream={stream_id(spark, checkpoint)}/batch={batch_id}")

    each_available(stream, batch, checkpoint)


def merge_checks(state: DataFrame, checks: DataFrame) -> DataFrame:
    """Latest check time of each company."""
    return state.unionByName(checks.select("company_key", "checked_at")).groupBy("company_key").agg(
        F.max("checked_at").alias("checked_at"))


def recheck_due(state: DataFrame, run_epoch: int, ttl: int = R.RECHECK_SECONDS) -> DataFrame:
    """Companies whose last check is not fresh any more."""
    return state.filter(~is_fresh(F.col("checked_at"), run_epoch, ttl)).select("company_key", "checked_at")


def track_checks(stream: DataFrame, state_root: str, checkpoint: str) -> None:
    """Keep the check-time state up to date with a stream of checks.

    Each batch writes the next snapshot from the newest one, whatever number the
    checkpoint gives the batch. The latest time wins, so a batch that runs again
    changes nothing. Old snapshots go; readers of the last KEPT are safe.
    """
    def batch(frame: DataFrame, batch_id: int) -> None:
        old = load_state(frame.sparkSession, state_root, CHECKS)
        save_state(merge_checks(old, frame), state_root)
        prune(frame.sparkSession, state_root, KEPT)

    each_available(stream, batch, checkpoint)
