"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks.

A source's documents, in seeded order, are a line of tokens cut into blocks of
equal length. Blocks are allocated by the highest quotients target / (2k + 1).
The allocation runs while the highest quotient is at least half a block: for
that house size the divisor is the block length, so a source's seats are its
target over the block length, rounded. A quota is dealt over the shards in
proportion, and a seeded permutation of the source's blocks says which blocks
fill it, first all once, then all a second time, then a third. The blocks stand in
the order of the permutation, so each shard takes as many as its quota says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import common as C

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3
BLOCK_TOKENS = 16
SHARDS = 24
SEED = 40_993
_PRIMES = (1_000_000_007, 998_244_353)


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Rows (source, source_size) get ``target``: weighted shares of all tokens, at most ``most`` times the size.

    Capped sources keep their cap and the rest share the excess by weight, so
    every uncapped target is weight x level. The level is found in one pass over
    the sources sorted by cap / weight. The windows run over one row per source.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn(
        "_w", F.element_at(cycle, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ).withColumn("_cap", F.col("source_size").cast("double") * most)
    ratio = F.col("_cap") / F.col("_w")
    line = Window.orderBy(F.col("_ratio"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        weighed.withColumn("_ratio", ratio)
        .withColumn("_k", F.row_number().over(line))
        .withColumn(
            "_level",
            (F.sum("source_size").over(whole).cast("double") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
            / F.sum("_w").over(line.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        )
    )
    first = F.min(F.when(F.col("_level") <= F.col("_ratio") * (1 + 1e-12), F.struct("_k", "_level"))).over(whole)
    return (
        levels.withColumn("_at", first)
        .withColumn("target", F.least(F.col("_cap"), F.col("_w") * F.coalesce(F.col("_at._level"), F.lit(0.0))))
        .select("source", "source_size", "target")
    )


def apportion(sized: DataFrame, block: int, most: int = MOST_REPEATS) -> DataFrame:
    """Rows (source, source_size, target) get ``blocks`` (there are) and ``seats`` (to take)."""
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    seats = F.floor(F.col("target") / block + 0.5).cast("long")  # quotients of half a block and more
    return sized.withColumn("blocks", blocks).withColumn("seats", F.least(seats, blocks * most))


def shard_quotas(seats: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Rows (source, shard, quota): whole blocks, at most one apart, that sum to the source's seats."""
    return seats.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select(
        "source", "shard", F.expr(f"seats * (shard + 1) div {shards} - seats * shard div {shards}").alias("quota")
    )


def _place(block: Column, blocks: Column, shift: Column) -> Column:
    """The block's place in the seeded permutation of its source's blocks."""
    step = F.when(blocks % _PRIMES[0] != 0, F.lit(_PRIMES[0])).otherwise(F.lit(_PRIMES[1])).cast("long")
    wide = lambda c: c.cast("decimal(19,0)")
    # The same number both ways; products of more blocks than that leave 64 bits.
    return F.when(blocks < 1 << 32, F.pmod(block * step + shift, blocks)).otherwise(
        F.pmod(wide(block) * wide(step % blocks) + wide(shift), wide(blocks)).cast("long"))


def shard_of(seat: Column, seats: Column, shards: int = SHARDS) -> Column:
    """The shard whose quota a source's seat (from 0) belongs to, see ``shard_quotas``."""
    # The quotient of whole numbers, rounded down without a detour over doubles.
    top = (seat + 1) * shards - 1
    return ((top - F.pmod(top, seats)) / seats).cast("int")


def mix(docs: DataFrame, seed: int = SEED, block: int = BLOCK_TOKENS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, shards, check (a hash of the text).

    ``taken`` counts the document's words that lie in taken blocks, repeats
    included; ``shards`` lists the shards that those blocks fill. A null source is the
    last source, a null text has no words; repeated rows are rows of their own,
    and equal ones are interchangeable. Texts of any length are read whole.
    Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    text = C.whole_text()
    rows = materialize(
        docs.select(
            "doc_id", "source", C.n_words(text).alias("size"), C.text_check(), F.xxhash64(F.lit(seed), "doc_id", F.xxhash64(text)).alias("_key")
        ),
        "mix-rows",
    )
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("t")).first()
    seats = apportion(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), block)
    bits = C.bucket_bits(stats.n)
    placed = C.running_sum(
        rows, F.col("size"), C.key_bucket(F.col("_key"), bits), ["_key", "doc_id", "size", "check"], "_start", ["source"]
    )
    keyed = seats.withColumn("_s", F.struct("source")).drop("source")
    joined = placed.join(keyed, F.struct(placed["source"]) == F.col("_s")).withColumn(
        "_shift", F.pmod(F.xxhash64(F.lit(seed + 1), "source"), F.greatest(F.col("blocks"), F.lit(1)))
    )
    end = F.col("_start") + F.col("size")
    own = F.sequence(F.expr(f"_start div {block}"), F.expr(f"(_start + size - 1) div {block}"))

    def drawn(i: Column) -> Column:
        place = _place(i, F.col("blocks"), F.col("_shift"))
        words = F.least(end, (i + 1) * block) - F.greatest(F.col("_start"), i * block)
        times = F.when(
            place < F.col("seats"), F.floor((F.col("seats") - 1 - place) / F.col("blocks")).cast("long") + 1
        ).otherwise(F.lit(0).cast("long"))
        return F.struct(words.alias("words"), place.alias("place"), times.alias("times"))

    draws = F.when(F.col("size") > 0, F.transform(own, drawn)).otherwise(F.array().cast("array<struct<words:bigint,place:bigint,times:bigint>>"))
    return (
        joined.withColumn("_draws", draws)
        .withColumn(
            "taken",
            F.aggregate("_draws", F.lit(0).cast("long"), lambda a, d: a + d["words"] * d["times"]),
        )
        .withColumn(
            "shards",
            F.array_sort(F.array_distinct(F.flatten(F.transform(
                F.filter("_draws", lambda d: d["times"] > 0),
                lambda d: F.transform(
                    F.sequence(F.lit(0).cast("long"), d["times"] - 1),
                    lambda k: shard_of(d["place"] + k * F.col("blocks"), F.col("seats"))),
            )))),
        )
        .select("doc_id", "size", "source_size", "target", "taken", "shards", "check")
    )


def copies(mixed: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, check, times): whole documents in place of words.

    A document stands as often as its taken words fill it, and a seeded draw of
    the document decides about the rest, so sources keep their shares. Documents
    without words stay once.
    """
    draw = F.pmod(F.xxhash64(F.lit(seed + 2), "doc_id", "check"), F.lit(1 << 20)) / (1 << 20)
    whole = F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1)) + draw).cast("int")
    return mixed.select("doc_id", "check", F.when(F.col("size") > 0, whole).otherwise(1).alias("times"))


def op10_mixing(spark, sf_dir):
    return mix(C.table(spark, sf_dir, "documents")).drop("check")
