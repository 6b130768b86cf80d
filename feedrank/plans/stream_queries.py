"""Streaming queries, run to the end of what has landed."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules as R
from ..session import scratch_path
from ..state import load_state, save_state
from ..streaming import incremental as S
from ..streaming import processors as P
from . import fixture as X
from . import oracle as O

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


def _landed(spark, frame, label):
    """Write the frame as landing files and open them as a stream."""
    path = scratch_path(spark, label)
    frame.write.parquet(path)
    return S.read_stream(spark, path, frame.schema, files_per_batch=4)


def _runs(spark, frame, run, path):
    """Land the frame run by run; after each, the landing folder as a stream. The frame is computed once and dealt to its runs."""
    dealt, folder = frame.withColumn("_run", F.col(run)), scratch_path(spark, "runs")
    dealt.write.partitionBy("_run").parquet(folder)
    runs = spark.read.schema(dealt.schema).parquet(folder)
    for r in runs.select("_run").distinct().orderBy("_run").collect():
        runs.filter(F.col("_run") == r[0]).drop("_run").write.mode("append").parquet(path)
        yield S.read_stream(spark, path, frame.schema)


# All keys of one event-time span are remembered, so the kept keys are those of the batch job.
@query("q_stream_dedup", O.with_([O.POSTINGS, O.PREFILTERED, O.DEDUPED], "SELECT dedup_key FROM deduped"))
def stream_dedup_keys(spark, sf):
    rows = X.postings(spark, sf).withColumn("captured_at", F.lit("2024-01-01").cast("timestamp"))
    out, checkpoint = scratch_path(spark, "seen"), scratch_path(spark, "seen-log")
    S.append_available(S.first_seen_stream(_landed(spark, rows, "landing")), out, checkpoint)
    return spark.read.parquet(out).select("dedup_key")


@query("q_stream_join", O.with_([O.POSTINGS, O.CUSTOMERS, O.STATE], f"""SELECT job_id, coalesce(s.numeric, 0.0) AS rating_score,
 CASE WHEN s.platform IS NOT NULL THEN concat('★ ', s.score, ' (', s.platform, ')') END AS company_score
 FROM postings p LEFT JOIN state s ON s.company_key = {O.ckey('p.company')}"""))
def stream_join(spark, sf):
    root, out, checkpoint = (scratch_path(spark, n) for n in ("state", "rated", "rated-log"))
    save_state(X.rating_state(spark, sf), root)
    rows = X.postings(spark, sf).withColumn("dedup_key", F.col("job_id"))
    S.rate_batches(_landed(spark, rows, "landing"), root, out, checkpoint)
    return spark.read.parquet(out).select("job_id", "rating_score", "company_score")


_NOW = 1_706_659_200  # 2024-01-31


@query("q_stream_ttl", f"""SELECT company_key, checked_at FROM (
 SELECT concat(event_type, user_id) AS company_key, max(CAST(floor(epoch(ts)) AS BIGINT)) AS checked_at FROM events GROUP BY 1)
 WHERE {_NOW} - checked_at >= {R.RECHECK_SECONDS}""")
def stream_ttl(spark, sf):
    """Three runs land their checks; the companies that are due after the last one."""
    checks = X.table(spark, sf, "events").select(
        F.concat("event_type", F.col("user_id").cast("string")).alias("company_key"), F.unix_timestamp("ts").alias("checked_at"))
    clocks = [_NOW - 20 * 86_400, _NOW - 10 * 86_400, _NOW]
    landed_at = F.coalesce(*[F.when(F.col("checked_at") < c, F.lit(c)) for c in clocks])
    landing, out, checkpoint = (scratch_path(spark, n) for n in ("checks-landing", "rechecks", "rechecks-log"))
    for part in _runs(spark, checks.withColumn("landed_at", F.timestamp_seconds(landed_at)), "landed_at", landing):
        S.append_available(P.recheck_changes(part), out, checkpoint)
    return P.due_now(spark.read.schema(P.CHANGES).parquet(out))


_CUTS = ("1997-04-01", "1999-06-01")


@query("q_stream_late", "WITH RECURSIVE " + ",".join([O.POSTINGS, O.PREFILTERED]) + f""",
timed AS (
 SELECT *, {O.DEDUP_KEY} AS dedup_key, CAST(captured_at AS TIMESTAMP) AS came,
  CASE WHEN captured_at < DATE '{_CUTS[0]}' THEN 0 WHEN captured_at < DATE '{_CUTS[1]}' THEN 1 ELSE 2 END
   + CASE WHEN item_ordinal % 50 = 7 THEN 1 ELSE 0 END AS run FROM prefiltered),
marks AS (SELECT r.run, max(t.came) - INTERVAL 7 DAY AS mark FROM (SELECT DISTINCT run FROM timed) r JOIN timed t ON t.run < r.run GROUP BY r.run),
judged AS (SELECT t.*, coalesce(t.came < m.mark, false) AS late FROM timed t LEFT JOIN marks m USING (run)),
turns AS (
 SELECT dedup_key, job_id, came, row_number() OVER (PARTITION BY dedup_key ORDER BY run, came, query_ordinal, item_ordinal) AS n
 FROM judged WHERE NOT late),
walk AS (
 SELECT dedup_key, job_id, n, came AS began, true AS kept FROM turns WHERE n = 1
 UNION ALL
 SELECT t.dedup_key, t.job_id, t.n, CASE WHEN t.came >= w.began + INTERVAL 7 DAY THEN t.came ELSE w.began END, t.came >= w.began + INTERVAL 7 DAY
 FROM walk w JOIN turns t ON t.dedup_key = w.dedup_key AND t.n = w.n + 1)
SELECT job_id, 'first' AS outcome FROM walk WHERE kept UNION ALL SELECT job_id, 'late' AS outcome FROM judged WHERE late""")
def stream_late(spark, sf):
    """Postings of several years in four runs, one in fifty a run late."""
    at = F.col("captured_at").cast("timestamp")
    run = F.lit(0) + sum(F.when(at >= F.lit(c).cast("timestamp"), 1).otherwise(0) for c in _CUTS)
    rows = X.postings(spark, sf).withColumn("captured_at", at).withColumn(
        "run", run + F.when(F.col("item_ordinal") % 50 == 7, 1).otherwise(0))
    landing, out, checkpoint = (scratch_path(spark, n) for n in ("postings-landing", "outcomes", "outcomes-log"))
    for part in _runs(spark, rows, "run", landing):
        P.append_by_outcome(P.first_seen_or_late(part), out, checkpoint)
    return spark.read.parquet(out).select("job_id", "outcome")


@query("q_state_versions", O.with_([O.POSTINGS.split("postings AS")[0].rstrip().rstrip(","), O.CUSTOMERS, O.EVERY_STATE], f"""
SELECT company_key, platform, score, CASE WHEN platform = {O.q(R.FALLBACK_PLATFORM)} THEN {X.RUN_EPOCH} ELSE checked_at END AS checked_at FROM state"""))
def state_versions(spark, sf):
    """Save, change and save again; the reader sees the last complete snapshot."""
    root = scratch_path(spark, "state")
    save_state(X.rating_state(spark, sf, gaps=False), root)
    state = load_state(spark, root)
    stamped = F.when(F.col("platform") == R.FALLBACK_PLATFORM, F.lit(X.RUN_EPOCH)).otherwise(F.col("checked_at"))
    save_state(state.withColumn("checked_at", stamped.cast("bigint")), root)
    return load_state(spark, root).select("company_key", "platform", "score", "checked_at")
