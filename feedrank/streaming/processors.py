"""Keyed state of streams: first-seen postings with late ones set aside, and rechecks that fall due.

Identities seen are snapshots in the checkpoint, cut to what event time still
needs. The state of rechecks lives in the RocksDB store of the checkpoint: a
batch reads and writes the state of its own keys only, so its cost follows the
batch and not the state.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import (
    ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues,
)

from .. import rules as R
from ..operators.classify import prefilter
from ..operators.dedup import first_by, with_dedup_key
from ..schema import ORDER_COLUMNS
from ..session import materialize, scratch_path
from ..state import load_state, prune, save_state
from .incremental import each_available, stream_id

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FIRST, LATE = "first", "late"
DUE, RENEWED = "due", "renewed"
DAY_MS = 86_400_000
SNAPSHOTS = 2  # of the identities seen: the last one, and the one that a repeated batch starts from


def use_store(spark: SparkSession) -> None:
    """Keyed state of this kind needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class FirstSeen(StatefulProcessor):
    """Per identity: the first posting of each span of ``seen_for_ms``; what is older than the watermark is late.

    The rule of ``append_by_outcome`` row by row, for streams that keep their state in Spark's
    store. It asks the store from Python for every key, so its time grows with the keys.
    Input rows carry ``_ms``, their event time (null: that of the watermark).
    The state of an identity is the event time of its last first posting; the
    store forgets it when it has not changed for the span on the clock.
    """

    def __init__(self, seen_for_ms: int, order: tuple[str, ...]) -> None:
        self.seen_for_ms, self.order = seen_for_ms, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "at long", ttlDurationMs=self.seen_for_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        first, = self.seen.get() or (None,)  # asking whether it exists would be one more call to the store
        known = first
        timed = [(watermark if r["_ms"] is None else r["_ms"], r) for r in rows]
        for at, row in sorted(timed, key=lambda x: (x[0], *[(x[1][c] is None, x[1][c]) for c in self.order])):
            if at < watermark:
                yield Row(**{**row.asDict(), "outcome": LATE})
            elif first is None or at >= first + self.seen_for_ms:
                first = at
                yield Row(**{**row.asDict(), "outcome": FIRST})
        if first != known:
            self.seen.update((first,))

    def close(self) -> None:
        pass


@dataclass(frozen=True)
class Arrivals:
    """A stream of postings after the rules, with their identities, and the span for which an identity is remembered."""

    rows: DataFrame
    seen_for_ms: int


def first_seen_or_late(postings: DataFrame, seen_for_days: int = 7, rules: R.Rules = R.DEFAULT_RULES) -> Arrivals:
    """A stream of postings, after the rules; ``append_by_outcome`` gives each an ``outcome``.

    ``first``: the first posting of an identity, or the first that comes
    ``seen_for_days`` of event time or more after the last first one. ``late``:
    a posting older than the watermark (the latest event time of the batches
    before, less the span); its identity may have been forgotten, so it is set
    aside, not dropped. Copies leave no row. Inside a batch, rows count in the
    order of event time, then feed order. Rows without an event time are never late.
    """
    return Arrivals(with_dedup_key(prefilter(postings, rules)), seen_for_days * DAY_MS)


def _begun(turns: Column, known: Column, span: int) -> Column:
    """The event times that begin a span of an identity, after its last known one (null for none)."""
    begin = F.struct(known.alias("last"), F.array().cast("array<bigint>").alias("begun"))

    def step(acc, at):
        new = acc["last"].isNull() | (at >= acc["last"] + span)
        return F.struct(
            F.when(new, at).otherwise(acc["last"]).alias("last"),
            F.when(new, F.concat(acc["begun"], F.array(at))).otherwise(acc["begun"]).alias("begun"))

    return F.aggregate(F.sort_array(turns), begin, step, lambda acc: acc["begun"])


def spans_begun(rows: DataFrame, seen: DataFrame, watermark: int, span: int) -> DataFrame:
    """(dedup_key, _at): the event times at which the identities of a batch begin a span.

    Only keys and times move, and an identity's times meet once each, however many copies it has.
    """
    turns = _timed(rows, watermark).filter(F.col("_at") >= watermark).groupBy("dedup_key").agg(
        F.collect_set("_at").alias("_turns"))
    known = seen.select("dedup_key", F.col("at").alias("_known"))
    return turns.join(known, "dedup_key", "left").select(
        "dedup_key", F.explode(_begun(F.col("_turns"), F.col("_known"), span)).alias("_at"))


def _timed(rows: DataFrame, watermark: int) -> DataFrame:
    return rows.withColumn("_at", F.coalesce(F.unix_millis(F.col("captured_at")), F.lit(watermark).cast("bigint")))


def outcomes(rows: DataFrame, begun: DataFrame, watermark: int) -> DataFrame:
    """The rows of a batch that are first (of those at one time the first in feed order) or late."""
    timed = _timed(rows, watermark)
    order = [c for name in ORDER_COLUMNS for c in (F.col(name).isNull(), F.col(name))]
    turns = first_by(timed.filter(F.col("_at") >= watermark), ["dedup_key", "_at"], order)
    first = turns.join(begun, ["dedup_key", "_at"], "left_semi").select(*timed.columns)
    late = timed.filter(F.col("_at") < watermark)
    return first.withColumn("outcome", F.lit(FIRST)).unionByName(late.withColumn("outcome", F.lit(LATE))).drop("_at")


#: What a stream remembers of its identities; the row without a key holds the latest event time of all batches.
SEEN = T.StructType([
    T.StructField("dedup_key", T.StringType()), T.StructField("at", T.LongType()), T.StructField("written", T.LongType())])


def append_by_outcome(arrivals: Arrivals, out: str, checkpoint: str) -> None:
    """Process what has arrived into ``out``/outcome=first and ``out``/outcome=late, and stop.

    Batches are joined with the identities seen, a snapshot in the checkpoint for
    each batch, so no row and no key passes through Python. A span that ended
    before the watermark decides nothing any more, so a snapshot holds those of the last
    two spans of event time (and, as the clock goes on, of one span of the
    clock), whatever came before. Each batch of a stream owns its folders, and
    starts from the snapshot before it: a repeated batch replaces its rows.
    """
    span, spark, root = arrivals.seen_for_ms, arrivals.rows.sparkSession, f"{checkpoint}/seen"

    def batch(frame: DataFrame, batch_id: int) -> None:
        path = scratch_path(spark, "arrivals")
        frame.write.parquet(path)
        rows = spark.read.schema(frame.schema).parquet(path)
        now = int(time.time() * 1000)
        before = load_state(spark, root, SEEN, before=batch_id)
        latest = before.filter(F.col("dedup_key").isNull()).agg(F.max("at")).first()[0] or 0
        watermark = max(0, latest - span)
        seen = before.filter(F.col("dedup_key").isNotNull() & (F.col("written") > now - span))
        begun = materialize(spans_begun(rows, seen, watermark, span), "begun")
        outcomes(rows, begun, watermark).withColumns({
            "stream": F.lit(stream_id(spark, checkpoint)), "batch": F.lit(batch_id),
        }).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("outcome", "stream", "batch").parquet(out)
        latest = max(latest, rows.agg(F.max(F.unix_millis(F.col("captured_at")))).first()[0] or 0)
        news = seen.unionByName(begun.select("dedup_key", F.col("_at").alias("at"), F.lit(now).alias("written")))
        kept = news.groupBy("dedup_key").agg(F.max(F.struct("at", "written")).alias("_last")).select("dedup_key", "_last.*")
        save_state(kept.filter(F.col("at") + span > latest - span).unionByName(
            spark.createDataFrame([(None, latest, now)], SEEN)), root, version=batch_id)
        prune(spark, root, SNAPSHOTS)

    each_available(arrivals.rows, batch, checkpoint)


CHANGES = T.StructType([
    T.StructField("company_key", T.StringType()), T.StructField("checked_at", T.LongType()), T.StructField("kind", T.StringType())])


class Recheck(StatefulProcessor):
    """Per company: its latest check and a timer that tells when it is not fresh any more."""

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "checked_at long, due boolean")

    def _stale_from(self, checked_at: int) -> int:
        return (checked_at + self.ttl) * 1000

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        newest = max(r["checked_at"] for r in rows)
        checked_at, due = self.last.get() or (None, False)
        if checked_at is not None and newest <= checked_at:
            return
        if due:
            yield Row(company_key=key[0], checked_at=newest, kind=RENEWED)
        elif checked_at is not None:
            self.handle.deleteTimer(self._stale_from(checked_at))
        self.last.update((newest, False))
        self.handle.registerTimer(self._stale_from(newest))

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        checked_at, _ = self.last.get()
        self.last.update((checked_at, True))
        yield Row(company_key=key[0], checked_at=checked_at, kind=DUE)

    def close(self) -> None:
        pass


def recheck_changes(checks: DataFrame, ttl: int = R.RECHECK_SECONDS) -> DataFrame:
    """(company_key, checked_at, kind): companies that fall due, and due ones that were checked again.

    ``checks``: a stream of (company_key, checked_at, landed_at). The clock is
    ``landed_at``, the time at which a run landed its checks; it must not go
    back from run to run, so no check is late, however old it is. A company is
    due as soon as the clock reaches ``checked_at`` + ``ttl``; without a check
    time it is due at once.
    """
    use_store(checks.sparkSession)
    timed = checks.select(
        "company_key", F.coalesce("checked_at", F.lit(0)).cast("long").alias("checked_at"), "landed_at"
    ).withWatermark("landed_at", "0 seconds")
    return timed.groupBy("company_key").transformWithState(Recheck(ttl), CHANGES, "append", "eventTime")


def due_now(changes: DataFrame) -> DataFrame:
    """(company_key, checked_at) of the companies whose last change says that they are due."""
    last = changes.groupBy("company_key").agg(
        F.max_by(F.struct("checked_at", "kind"), F.struct("checked_at", F.col("kind") == DUE)).alias("_last"))
    return last.select("company_key", "_last.*").filter(F.col("kind") == DUE).drop("kind")
