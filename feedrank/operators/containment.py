"""Set containment join: the word sets that hold every word of a sought set.

Sought sets are walked as a prefix trie. A set's path lists its words from the
rarest to the most frequent one; a node is a prefix of paths. A candidate stands
at a node if it holds the node's words, whatever else it holds. All sets that
end at a node are held by all candidates there, so they need the first few
candidates of the node only. The others are compared with the node's candidates
as long as that is cheap, else the node is taken apart by the next word of the
paths. A node that is compared is cut into cells of ``cell_rows`` sought sets by
``cell_rows`` candidates, so no task holds more than one cell of a frequent word,
on whichever side it is frequent. The walk ends with the longest path.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import SMALL_ROWS, materialize

CELL_ROWS = 2_000


def first_rows(df: DataFrame, per: str, k: int, *order) -> DataFrame:
    """The ``k`` first rows of each key, with their place ``_n``; tasks drop the rest before the shuffle."""
    w = Window.partitionBy(per).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k)


def _paths(sought: DataFrame, sets: DataFrame) -> DataFrame:
    """(name, path): words in the order of their frequency; sets with a word that no candidate holds are out."""
    frequency = sets.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("rows"))
    return (
        sought.select("name", F.explode("words").alias("word"))
        .join(frequency, "word", "left")
        .groupBy("name")
        .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("rows", F.lit(0)).alias("rows"), "word"))).alias("path"))
        .filter(F.col("path")[0]["rows"] > 0)
        .select("name", F.transform("path", lambda p: p["word"]).alias("path"))
    )


def _cells(node_rows: str, cell_rows: int) -> Column:
    return F.ceil(F.col(node_rows) / F.lit(cell_rows)).cast("int")


def _numbers(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1))


def compared(seeking: DataFrame, holding: DataFrame, nodes: DataFrame, cell_rows: int) -> tuple[DataFrame, DataFrame]:
    """The rows of both sides at ``nodes``, dealt to cells (node, i, j) that meet each other once."""
    cells = nodes.select("node", _cells("n_sought", cell_rows).alias("a"), _cells("n_holding", cell_rows).alias("b"))
    left = seeking.join(cells, "node").select(
        "node", F.pmod(F.xxhash64("name"), F.col("a")).cast("int").alias("i"), _numbers(F.col("b")).alias("j"), "name", "path")
    right = holding.join(cells, "node").select(
        "node", _numbers(F.col("a")).alias("i"), F.pmod(F.xxhash64("id"), F.col("b")).cast("int").alias("j"), "id", "words")
    return left, right


def holders(sought: DataFrame, sets: DataFrame, k: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(name, id): sets that hold all words of a sought set, at least the ``k`` with the least ids of each.

    ``sought``: (name, words), one row per name; ``sets``: (id, words). Words
    are arrays without repeats; an empty sought set finds nothing. Both sides
    are read several times: give written tables.
    """
    paths = _paths(sought, sets)
    seeking = materialize(paths.withColumn("node", F.col("path")[0]), "sought")
    words = sets.select("id", "words", F.explode("words").alias("node"))
    out: list[DataFrame] = []
    depth = 1
    while True:
        nodes = seeking.groupBy("node").agg(
            F.count_if(F.size("path") > depth).alias("n_sought"), F.count_if(F.size("path") == depth).alias("n_ending"))
        small = nodes.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS

        def at(df: DataFrame, small: bool = small) -> DataFrame:
            return F.broadcast(df) if small else df  # a row for each node: counted above

        holding = materialize(words.join(at(nodes.select("node")), "node", "left_semi"), "holding")
        met = materialize(
            nodes.join(holding.groupBy("node").agg(F.count(F.lit(1)).alias("n_holding")), "node")
            .withColumn("deep", F.col("n_sought") * F.col("n_holding") > F.lit(cell_rows) * F.lit(cell_rows)), "nodes")

        ended = first_rows(holding.join(at(met.filter("n_ending > 0").select("node")), "node", "left_semi"), "node", k, F.col("id"))
        out.append(seeking.filter(F.size("path") == depth).join(ended, "node").select("name", "id"))
        longer = seeking.filter(F.size("path") > depth)
        flat = met.filter("n_sought > 0 and not deep")
        left, right = compared(longer, holding, at(flat), cell_rows)
        out.append(
            left.join(right, ["node", "i", "j"]).filter(F.size(F.array_except("path", "words")) == 0).select("name", "id"))

        if met.filter("n_sought > 0 and deep").isEmpty():
            return reduce(DataFrame.unionByName, out)
        deep = at(met.filter("n_sought > 0 and deep").select("node"))
        below = lambda word: F.concat_ws(" ", "node", word).alias("node")
        words = holding.join(deep, "node", "left_semi").select("id", "words", "node", F.explode("words").alias("word")).select(
            "id", "words", below(F.col("word")))
        seeking = materialize(
            longer.join(deep, "node", "left_semi").select("name", "path", below(F.col("path")[depth])), "sought")
        depth += 1
