"""Sharding: proportional stratified interleaving.

Every source is shuffled by a seeded hash, row r of a source of n rows gets the
fraction (2r - 1) / 2n, all rows are put in the order of their fractions, and
that order is cut into shards of equal row counts. A stretch of the order holds
each source in proportion to its size, so every shard matches the mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import common as C

SHARDS = 24
SEED = 20_311


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, fraction.

    Law ``rows``: shard sizes differ by one row at most. ``slot`` counts from 0
    in each shard. Only ids, sizes and hashes are shuffled, never texts. A null
    source is a source; a null text has size 8 and the crc of nothing; repeated
    rows get a slot each; of equal hashes and ids, equal rows are
    interchangeable. An empty table gives no rows.
    """
    text = C.whole_text()
    rows = materialize(
        docs.select(
            "doc_id",
            "source",
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(F.lit(seed), "doc_id", F.crc32(text.cast("binary"))).alias("_key"),
        ),
        "shard-rows",
    )
    total = rows.count()
    bits = C.bucket_bits(total)
    one = F.lit(1).cast("long")
    ranked = C.running_sum(
        rows, one, C.key_bucket(F.col("_key"), bits), ["_key", "doc_id", "text_crc32", "size"], "_rank", ["source"]
    )
    counts = rows.groupBy(F.struct("source").alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per source; the join is left to the optimizer's measured sizes.
    placed = materialize(
        ranked.join(counts, F.struct(ranked["source"]) == F.col("_s")).withColumn(
            "fraction", (2 * F.col("_rank") + 1) / (2 * F.col("_n"))
        ).drop("_s", "_n", "_rank"),
        "shard-fractions",
    )
    parts = 1 << bits
    at = F.least(F.floor(F.col("fraction") * parts), F.lit(parts - 1)).cast("long")
    order = ["fraction", F.col("source").asc_nulls_first(), "_key", "doc_id", "text_crc32", "size"]
    out = C.running_sum(placed, one, at, order, "_at")
    shard = F.expr(f"cast(_at * {shards} div {max(total, 1)} as int)")
    return out.withColumn("shard", shard).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.expr(f"_at - (shard * {max(total, 1)}L + {shards - 1}) div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "fraction",
    )


def op3_sharding(spark, sf_dir):
    return interleave(C.table(spark, sf_dir, "documents"))
