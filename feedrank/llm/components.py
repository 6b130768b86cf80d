"""Connected components of a large graph of narrow rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: A node with more than 1 / HOT_SHARE of all edges is hot; fewer than 2 * HOT_SHARE nodes can be.
HOT_SHARE = 1024


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def meet(rows: DataFrame, facts: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` (of a written table of ``total`` rows) with the one row of ``facts`` (key, m) of their key, or null.

    Keys that hold more than 1 / HOT_SHARE of the rows are fewer than HOT_SHARE:
    their facts are broadcast, and no task gathers the rows of such a key.
    """
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > total // HOT_SHARE + 16).select(key)
    # A hot key without facts stays, so that its rows leave the shuffled side.
    hot_facts = F.broadcast(hot.join(facts, key, "left").withColumn("_hot", F.lit(True)))
    marked = rows.join(hot_facts, key, "left")
    columns = [*rows.columns, "m"]
    cold = marked.filter("_hot is null").select(*rows.columns).join(facts, key, "left").select(*columns)
    return marked.filter("_hot").select(*columns).unionByName(cold)


def components(edges: DataFrame, label: str) -> DataFrame:
    """Rows (node, root) for all nodes of edges (a, b) with a > b; root is the component's least node.

    Alternates two steps until every edge leads to a root. Large star: the greater
    end of an edge moves on to the least neighbour of the lesser end. Small star:
    the lesser neighbours of a node are tied to the least of them. Paths shorten in
    every round, so the rounds end. Each step is written. A node's least neighbour is
    one row; the edges of a hub meet it by a broadcast of the few hubs (``meet``).
    Null ends and edges with a <= b are left out; an empty table gives no rows.
    """
    edges = materialize(edges.filter("a > b").distinct(), label)
    state = _state(edges)
    while True:
        down = edges.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
        jumped = meet(edges, down, "b", state[0]).select("a", F.coalesce("m", "b").alias("b"))
        large = materialize(jumped.distinct(), label)
        total = large.count()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = meet(large, least, "a", total).select(F.explode(tied).alias("e")).select("e.a", "e.b")
        edges = materialize(small.filter("a > b").distinct(), label)
        before, state = state, _state(edges)
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
