from pyspark.sql import functions as F

from feedrank.plans import daily, fixture as X
from feedrank.state import load_state
from feedrank.streaming import incremental as S
from feedrank.streaming import processors as P


def test_stream_in_file_order_equals_batch(spark, sf, tmp_path):
    """One file per request, one file per batch, in feed order: same survivors as the batch run."""
    rows = X.postings(spark, sf).withColumn("captured_at", F.lit("2024-01-01").cast("timestamp"))
    first = rows.filter("item_ordinal % 3 = 0")  # one copy of each URL per file
    landing = str(tmp_path / "landing")
    for part in (first, rows.filter("item_ordinal % 3 <> 0")):
        part.coalesce(1).write.mode("append").parquet(landing)
    stream = S.first_seen_stream(S.read_stream(spark, landing, rows.schema, files_per_batch=1))
    S.append_available(stream, str(tmp_path / "out"), str(tmp_path / "log"))
    got = {r.dedup_key for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.dedup_key for r in daily.candidates(rows).collect()}
    # nothing new has landed: a second run adds nothing
    S.append_available(stream, str(tmp_path / "out"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(got)


def test_late_copy_enters_again_after_expiry(spark, tmp_path):
    """Day 20 moves the watermark; the key is dropped with the next batch, so day 22 is new."""
    def row(day, i):
        return (0, i, "s", str(i), "Junior AI Engineer", "C", "L", "M", "https://a/1", [], f"2024-01-{day:02d}")

    schema = ("query_ordinal int, item_ordinal long, source string, job_id string, title string, company string, location string, "
              "modality string, job_url string, tags array<string>, day string")
    landing = str(tmp_path / "in")
    for day in (1, 2, 20, 21, 22):
        spark.createDataFrame([row(day, day)], schema).withColumn("captured_at", F.to_timestamp("day")).coalesce(1).write.mode(
            "append").parquet(landing)
    frame = spark.read.parquet(landing)
    stream = S.first_seen_stream(S.read_stream(spark, landing, frame.schema, files_per_batch=1), "7 days")
    S.append_available(stream, str(tmp_path / "out"), str(tmp_path / "log"))
    assert sorted(r.job_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "22"]


def test_checks(spark, tmp_path):
    landing, root = str(tmp_path / "in"), str(tmp_path / "state")
    for rows in ([("a", 100), ("b", 200)], [("a", 100_000)]):
        spark.createDataFrame(rows, S.CHECKS).coalesce(1).write.mode("append").parquet(landing)
    S.track_checks(S.read_stream(spark, landing, S.CHECKS, files_per_batch=1), root, str(tmp_path / "log"))
    state = load_state(spark, root, S.CHECKS)
    assert sorted(map(tuple, state.collect())) == [("a", 100_000), ("b", 200)]
    assert [r.company_key for r in S.recheck_due(state, 100_500).collect()] == ["b"]


def test_new_checkpoint_keeps_the_state(spark, tmp_path):
    from feedrank.state import load_state, versions
    from feedrank.streaming import incremental as S

    root = str(tmp_path / "state")
    for turn, rows in enumerate(([("a", 5), ("b", 7)], [("a", 9)])):
        spark.createDataFrame(rows, S.CHECKS).write.parquet(str(tmp_path / f"in{turn}"))
        S.track_checks(S.read_stream(spark, str(tmp_path / f"in{turn}"), S.CHECKS), root, str(tmp_path / f"check{turn}"))
    assert sorted(map(tuple, load_state(spark, root, S.CHECKS).collect())) == [("a", 9), ("b", 7)]
    assert versions(spark, root) == [1, 2]


POSTING = ("query_ordinal int, item_ordinal long, source string, job_id string, title string, company string, location string, "
           "modality string, job_url string, tags array<string>, day string")


def test_late_postings_are_set_aside(spark, tmp_path):
    """Copies go, comebacks after the span enter again, and rows behind the watermark land in their own folder."""
    def row(day, i, url):
        return (0, i, "s", str(i), "Junior AI Engineer", "C", "L", "M", f"https://a/{url}", [], day and f"2024-01-{day:02d}")

    landing, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    runs = [[row(1, 1, "a"), row(2, 2, "a"), row(3, 3, "b")], [row(20, 4, "a"), row(19, 5, "a"), row(9, 6, "c")],
            [row(5, 7, "late"), row(4, 8, "a"), row(14, 9, "d"), row(None, 10, "e"), row(21, 11, "a")], [row(18, 12, "e"), row(12, 13, "d")]]
    for rows in runs:
        spark.createDataFrame(rows, POSTING).withColumn("captured_at", F.to_timestamp("day")).coalesce(1).write.mode("append").parquet(landing)
        schema = spark.read.parquet(landing).schema
        P.append_by_outcome(P.first_seen_or_late(S.read_stream(spark, landing, schema)), out, log)
    got = {(r.outcome, r.job_id) for r in spark.read.parquet(out).collect()}
    assert got == {("first", j) for j in ("1", "3", "5", "6", "9", "10")} | {("late", j) for j in ("7", "8", "13")}


def test_rechecks_fall_due(spark, tmp_path):
    landing, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    seen = []
    for clock, rows in ((100, [("a", 50), ("b", 95), ("n", None)]), (150, [("b", 94), ("c", 149), ("a", 30)]), (160, [("a", 155)]), (250, [("b", 240)])):
        frame = spark.createDataFrame(rows, "company_key string, checked_at long").withColumn("landed_at", F.timestamp_seconds(F.lit(clock)))
        frame.coalesce(1).write.mode("append").parquet(landing)
        P_stream = P.recheck_changes(S.read_stream(spark, landing, frame.schema), ttl=60)
        S.append_available(P_stream, out, log)
        seen.append({(r.company_key, r.checked_at) for r in P.due_now(spark.read.schema(P.CHANGES).parquet(out)).collect()})
    assert seen == [{("n", 0)}, {("n", 0), ("a", 50)}, {("n", 0), ("b", 95)}, {("n", 0), ("c", 149), ("a", 155)}]
    kinds = [(r.company_key, r.checked_at, r.kind) for r in spark.read.schema(P.CHANGES).parquet(out).collect()]
    assert sorted(k for k in kinds if k[0] == "a") == [("a", 50, "due"), ("a", 155, "due"), ("a", 155, "renewed")]


def test_state_is_asked_once_a_key():
    """Every question to the store is a call to another process."""
    from pyspark.sql import Row

    from feedrank.streaming.processors import DAY_MS, FirstSeen, Recheck

    class Store:
        def __init__(self):
            self.value, self.calls = None, []

        def exists(self):
            self.calls.append("exists")
            return self.value is not None

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

    class Handle:
        def registerTimer(self, at):
            pass

        def deleteTimer(self, at):
            pass

    class Clock:
        def getCurrentWatermarkInMs(self):
            return 0

    seen = FirstSeen(7 * DAY_MS, ("n",))
    seen.seen = Store()
    rows = [list(seen.handleInputRows(("k",), iter([Row(n=1, _ms=at)]), Clock())) for at in (5, 6, 7 * DAY_MS + 5)]
    assert [[r["outcome"] for r in out] for out in rows] == [["first"], [], ["first"]]
    assert seen.seen.calls == ["get", "update", "get", "get", "update"]
    check = Recheck(10)
    check.handle, check.last = Handle(), Store()
    for at in (5, 4, 6):
        assert list(check.handleInputRows(("k",), iter([Row(checked_at=at)]), Clock())) == []
    assert check.last.calls == ["get", "update", "get", "get", "update"] and check.last.value == (6, False)


def test_outcomes_of_whole_batches_equal_the_rule_row_by_row(spark, tmp_path):
    """No key passes through Python, and a snapshot holds what the next batches may still need, not all history."""
    import random

    from pyspark.sql import Row

    from feedrank.streaming.processors import DAY_MS, FirstSeen

    draw, days = random.Random(4), 86_400
    schema = ("query_ordinal int, item_ordinal long, source string, job_id string, title string, company string, location string, "
              "modality string, job_url string, tags array<string>, seconds long")
    landing, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    kept, latest, want = {}, 0, []
    for batch in range(4):
        rows = []
        for i in range(60):
            key = draw.choice(["hot", "hot", *[f"k{k}" for k in range(9)], f"only{batch}-{i}"])
            at = None if i % 13 == 5 else (batch * 15 + draw.randrange(-9, 25)) * days + draw.choice([0, 0, 7]) + 40 * days
            rows.append((draw.choice([None, 0, 1]), None if i % 11 == 3 else 100 * batch + i, "s", f"{batch}-{i}", "Junior AI Engineer",
                         "C", "L", "M", f"https://a/{key}", [], at))
        spark.createDataFrame(rows, schema).withColumn("captured_at", F.timestamp_seconds("seconds")).coalesce(1).write.mode(
            "append").parquet(landing)
        P.append_by_outcome(P.first_seen_or_late(S.read_stream(spark, landing, spark.read.parquet(landing).schema)), out, log)

        class Store:
            def __init__(self, key):
                self.key = key

            def get(self):
                return kept.get(self.key)

            def update(self, value):
                kept[self.key] = value

        class Clock:
            def getCurrentWatermarkInMs(self):
                return max(0, latest - 7 * DAY_MS)

        rule = FirstSeen(7 * DAY_MS, ("query_ordinal", "item_ordinal"))
        for url in sorted({r[8] for r in rows}):
            rule.seen = Store(url)
            mine = [Row(query_ordinal=r[0], item_ordinal=r[1], job_id=r[3], _ms=r[10] and r[10] * 1000) for r in rows if r[8] == url]
            want += [(r["outcome"], r["job_id"]) for r in rule.handleInputRows((url,), iter(mine), Clock())]
        latest = max(latest, *[r[10] * 1000 for r in rows if r[10] is not None])
        state = load_state(spark, f"{log}/seen", P.SEEN)
        assert {r.dedup_key.removeprefix("url:"): r.at for r in state.filter("dedup_key is not null").collect()} == {
            k: v[0] for k, v in kept.items() if v[0] > latest - 14 * DAY_MS}
    got = spark.read.parquet(out)
    assert sorted((r.outcome, r.job_id) for r in got.collect()) == sorted(want)
    assert {o for o, _ in want} == {"first", "late"} and len(want) < 240
    rows = spark.read.parquet(landing).withColumn("dedup_key", F.col("job_url"))
    begun = P.spans_begun(rows, state, 0, 7 * DAY_MS)
    plan = P.outcomes(rows, begun, 0)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Window" not in plan
