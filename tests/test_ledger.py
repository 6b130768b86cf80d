import io
import random
import re
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedrank.ledger import BASE, DELTA, Ledger

SCHEMA = T.StructType([T.StructField("company_key", T.StringType()), T.StructField("score", T.LongType()), T.StructField("note", T.StringType())])


@pytest.fixture()
def ledger(spark, tmp_path):
    return Ledger(spark, str(tmp_path / "state"), SCHEMA, buckets=8)


def changes(spark, rows):
    return spark.createDataFrame(rows, "company_key string, score long, note string, deleted boolean")


def content(df):
    rows = df.collect()
    found = {r.company_key: (r.score, r.note) for r in rows}
    assert len(found) == len(rows)
    return found


def test_random_changes(spark, ledger):
    """Inserts, updates to null, deletes and returns, with compactions between, against a dict."""
    rng = random.Random(4)
    assert ledger.newest() == 0 and ledger.load().count() == 0
    assert ledger.lookup(spark.createDataFrame([("k1",)], "company_key string")).first().entry is None
    want, history = {}, [{}]
    for turn in range(6):
        keys = rng.sample([f"k{i}" for i in range(12)], rng.randint(1, 6))
        rows = [(k, None, None, True) if rng.random() < 0.3 else (k, rng.choice([None, turn]), rng.choice([None, f"n{turn}"]), rng.choice([None, False])) for k in keys]
        assert ledger.append(changes(spark, rows)) == turn + 1
        for k, s, n, gone in rows:
            want.pop(k, None)
            if not gone:
                want[k] = (s, n)
        history.append(dict(want))
        if turn in (1, 3):
            before = ledger.load()  # a reader that has listed the folders already
            ledger.compact()
            assert content(before) == want
        assert content(ledger.load()) == want
    assert content(ledger.load(version=3)) == history[3] and content(ledger.load(version=5)) == history[5]
    asked = spark.createDataFrame([(f"k{i}", i) for i in range(14)], "company_key string, i int")
    got = {r.company_key: r.entry and (r.entry.score, r.entry.note) for r in ledger.lookup(asked).collect()}
    assert got == {f"k{i}": want.get(f"k{i}") for i in range(14)}
    ledger.compact()
    ledger.forget(keep=1)
    assert ledger.versions(BASE) == [6] and ledger.versions(DELTA) == [] and content(ledger.load()) == want


def test_a_changed_key_writes_a_small_delta_and_dead_writers_are_not_seen(spark, ledger, tmp_path):
    ledger.append(changes(spark, [(f"k{i}", i, "x" * 50, None) for i in range(5_000)]))
    ledger.compact()
    number = ledger.append(changes(spark, [("k7", -7, None, None)]))
    size = lambda v: sum(f.stat().st_size for f in (tmp_path / "state" / DELTA / f"v={v}").glob("*.parquet"))
    assert number == 2 and size(2) * 10 < size(1)
    dead = tmp_path / "state" / DELTA / "v=3"
    dead.mkdir()
    (dead / "part-0.parquet").write_bytes(b"half")
    assert ledger.newest() == 2 and content(ledger.load())["k7"] == (-7, None)
    assert ledger.append(changes(spark, [("k8", None, None, True)])) == 3
    assert len(content(ledger.load())) == 4_999


def test_the_state_is_not_moved(spark, ledger):
    """No exchange above the base's scan, in a lookup and in a merge."""
    ledger.append(changes(spark, [(f"k{i}", i, "x", None) for i in range(100)]))
    ledger.compact()
    ledger.append(changes(spark, [("k7", -7, None, None)]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = spark.range(40).select(F.concat(F.lit("k"), "id").alias("company_key"))
        for frame in (ledger.lookup(asked), ledger.load()):
            text = io.StringIO()
            with redirect_stdout(text):
                frame.explain()
            lines = text.getvalue().splitlines()
            scans = [i for i, line in enumerate(lines) if "ledger_" in line and "deleted" not in line]
            assert scans
            for i in scans:
                depth, above = re.search(r"\w", lines[i]).start(), []
                for line in reversed(lines[:i]):
                    if re.search(r"\w", line) and re.search(r"\w", line).start() < depth:
                        depth = re.search(r"\w", line).start()
                        above.append(line)
                assert above and not any("Exchange" in line for line in above), text.getvalue()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
