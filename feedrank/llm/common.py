"""Helpers that several corpus operators share."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of characters outside this class (ASCII white space).
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bucket_bits(rows: int) -> int:
    """Bits that name about sqrt(rows) buckets: buckets and rows in a bucket grow alike."""
    return max(1, math.ceil(math.log2(max(2, rows)) / 2))


def running_sum(
    df: DataFrame, value: Column, bucket: Column, order: Sequence[Column], out: str, groups: Sequence[str] = ()
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows before, in (bucket, order), inside each group.

    A window over a group would put a hot group into one task. Here rows meet
    only inside (group, bucket), and the sums of the buckets, one row each, are
    summed up apart. ``bucket`` must cut the order into ranges of similar size.
    ``df`` is read twice: give it a written table. Null groups are a group.
    """
    rows = df.withColumn("_b", bucket).withColumn("_v", value)
    safe = [F.struct(F.col(g)) for g in groups]  # a struct keeps null keys joinable
    sums = rows.groupBy(*groups, "_b").agg(F.sum("_v").alias("_sum"))
    before = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*groups, "_b", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*groups, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_in", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    keyed = starts.select(*[s.alias(f"_g{i}") for i, s in enumerate(safe)], F.col("_b").alias("_b2"), "_start")
    on = [F.col("_b") == F.col("_b2")] + [F.struct(placed[g]) == F.col(f"_g{i}") for i, g in enumerate(groups)]
    joined = placed.join(keyed, on, "inner")
    return joined.select(*[F.col(c) for c in df.columns], (F.col("_start") + F.col("_in")).alias(out))


def key_bucket(key: Column, bits: int) -> Column:
    """The leading bits of a hash."""
    return F.shiftrightunsigned(key, 64 - bits)


def text_check() -> Column:
    """A 64-bit hash of the text (null as empty); with the doc_id it names a row."""
    return F.xxhash64(whole_text()).alias("check")


def keep_rows(docs: DataFrame, wanted: DataFrame, times: str | None = None) -> DataFrame:
    """The documents named by (doc_id, check) in ``wanted``, each once or ``times`` times, with their own columns.

    Null ids meet null ids. Repeated rows of one name become one row first.
    """
    columns = docs.columns
    # Two non-null keys, so that one shuffle of the texts serves the join and the removal of repeats.
    own_id = F.coalesce("doc_id", F.lit(-1)).alias("_id")
    own = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_doc")  # names of theirs cannot clash with ours
    named = docs.select(own, own_id, F.xxhash64("doc_id", F.xxhash64(whole_text())).alias("_row"))
    name = [own_id, F.xxhash64("doc_id", "check").alias("_row")]
    if times is None:
        kept = named.join(wanted.select(*name).distinct(), ["_id", "_row"], "left_semi").dropDuplicates(["_id", "_row"])
    else:
        counted = wanted.select(*name, times).groupBy("_id", "_row").agg(F.sum(times).alias("_times"))
        kept = (
            named.join(counted.filter("_times > 0"), ["_id", "_row"])
            .dropDuplicates(["_id", "_row"])
            .withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_times"))))
        )
    return kept.select("_doc.*")
