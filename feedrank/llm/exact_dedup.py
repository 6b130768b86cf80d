"""Exact dedup through an extendible-hash index on shared files.

Keys are 64-bit text hashes. A directory of 2**depth slots names the bucket of
a key by the key's leading bits; a bucket that holds more bytes of text than it
may is split in two, and the directory doubles when a split needs one more bit.
Index entries are made by grouping on (bucket, key, text): copies are combined
where they are read, and texts of one key are told apart by their bytes. Owner
tasks then take ranges of buckets, chain the entries of colliding keys, and
write the index. Every document finds its entry by key, and by digest too where
a key has a chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import common as C

BUCKET_BYTES = 64 << 20
#: 2**16 slots at most, so the directory that tasks get has a fixed bound. A
#: bucket that may not split further is only larger: grouping spills to disk.
MOST_BITS = 16
#: Texts with more than 1 / HOT_SHARE of all rows; there are fewer than this many.
HOT_SHARE = 1024


def build_directory(keys: DataFrame, bucket_bytes: int, most_bits: int = MOST_BITS) -> tuple[DataFrame, int]:
    """Rows (slot, bucket) for every slot of the directory, and its depth.

    ``keys`` has (key, bytes), one row per key or per copy map. The sums per
    slot at full depth are made once (2**most_bits rows at most); splitting
    starts from one bucket and works on these sums.
    """
    spark = keys.sparkSession
    slots = (
        keys.groupBy(C.key_bucket(F.col("key"), most_bits).alias("slot"))
        .agg(F.sum("bytes").alias("bytes"))
        .collect()  # at most 2**most_bits pairs of numbers
    )
    weight = {r.slot: r.bytes for r in slots}
    done, depth, level = [], 0, [(0, sorted(weight))]
    while level:
        split = []
        for name, own in level:
            if sum(weight[s] for s in own) <= bucket_bytes or depth == most_bits:
                done.append((name, depth))
                continue
            bit = most_bits - depth - 1
            split.append((name << 1, [s for s in own if not s >> bit & 1]))
            split.append((name << 1 | 1, [s for s in own if s >> bit & 1]))
        if not split:
            break
        level, depth = split, depth + 1  # the directory doubles
    rows = [(slot, name << (depth - own)) for name, own in done for slot in range(name << (depth - own), (name + 1) << (depth - own))]
    return spark.createDataFrame(rows, "slot long, bucket long"), depth


def find_copies(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, bucket, chain, check.

    Equal texts form a group; its largest doc_id stays (a null id is below all
    others). Null texts are empty texts, and empty texts are copies of each
    other. Rows that repeat a doc_id and its text count in group_size and share
    the verdict. An empty table gives no rows.
    """
    text = C.whole_text()
    entries = materialize(
        docs.select(
            "doc_id",
            F.xxhash64(text).alias("key"),
            F.sha2(text, 256).alias("text_sha256"),
            F.octet_length(text).cast("long").alias("bytes"),
            C.text_check(),
        ),
        "dedup-entries",
    )
    directory, depth = build_directory(
        entries.groupBy("key").agg(F.max("bytes").alias("bytes")), bucket_bytes
    )
    slot = C.key_bucket(F.col("key"), depth) if depth else F.lit(0).cast("long")
    texts = docs.select("doc_id", text.alias("_text"), F.xxhash64(text).alias("key")).withColumn("slot", slot)
    groups = (
        texts.join(F.broadcast(directory), "slot")  # 2**MOST_BITS rows at most
        .groupBy("bucket", "key", F.col("_text"))
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("bucket", "key", F.sha2("_text", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    chain = Window.partitionBy("bucket", "key").orderBy("text_sha256")
    index = materialize(
        groups.repartitionByRange("bucket", "key").withColumn("chain", F.row_number().over(chain) - 1),
        "dedup-index",
    )
    rows = entries.count()
    hot_rows = rows // HOT_SHARE + 1
    entry = ["key", "text_sha256"]
    hot = index.filter(F.col("group_size") > hot_rows)
    cold = index.filter(F.col("group_size") <= hot_rows)
    # Fewer than HOT_SHARE entries are hot; the rest have few rows for any key.
    marked = entries.join(F.broadcast(hot.select(*entry, F.lit(True).alias("_hot"))), entry, "left")
    found = marked.filter("_hot").join(F.broadcast(hot), entry).unionByName(
        marked.filter("_hot is null").join(cold, entry)
    )
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
        "bucket",
        "chain",
        "check",
    )


def op7_exact_dedup(spark, sf_dir):
    return find_copies(C.table(spark, sf_dir, "documents")).drop("bucket", "chain", "check")


OP7_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
