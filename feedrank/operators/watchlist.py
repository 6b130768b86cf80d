"""Watch-list matches on published postings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..session import broadcast_if_small, materialize
from .containment import CELL_ROWS, compared

#: Letters of a gram; a shorter target is a gram as a whole.
GRAM = 3


def target_matches(postings: DataFrame, targets: Sequence[str] | DataFrame = R.WATCH_TARGETS) -> DataFrame:
    """One row per (target, posting) whose company or title contains the target.

    A short list is tested inside the scan; there is no join, and a target that
    matches a third of the table stays spread over all tasks. A table
    (``target``) of any size goes through an index, see ``containing``.
    """
    company, title = F.lower(F.col("company")), F.lower(F.col("title"))
    if isinstance(targets, DataFrame):
        return _matches_of_table(postings, targets, company, title)
    hits = F.array_compact(
        F.array(*[
            F.when(F.contains(company, F.lit(t)) | F.contains(title, F.lit(t)), F.lit(t)) for t in targets
        ])
    )
    return postings.withColumn("target", F.explode(hits))


def target_counts(postings: DataFrame, targets: Sequence[str] | DataFrame = R.WATCH_TARGETS) -> DataFrame:
    """Matches per target; targets without a match count 0."""
    if isinstance(targets, DataFrame):
        all_targets = targets.select("target").filter(F.col("target").isNotNull()).distinct()
    else:
        all_targets = postings.sparkSession.createDataFrame([(t,) for t in targets], "target string")
    counts = target_matches(postings, targets).groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    return all_targets.join(counts, "target", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _grams(text: Column, size: Column) -> Column:
    """The distinct runs of ``size`` characters."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, size)))


def containing(texts: DataFrame, needles: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(text, needle): the texts that contain a needle, from an inverted index of grams.

    ``texts``: (text), ``needles``: (needle), both distinct and not null, needles not
    empty. A text that contains a needle holds the needle's rarest gram, so they
    meet on it alone and are then tested. Frequent grams are cut into cells.
    """
    size = F.least(F.length("needle"), F.lit(GRAM))
    seeking = materialize(needles.select("needle", size.alias("size"), F.explode(_grams(F.col("needle"), size)).alias("gram")), "needle-grams")
    sizes = [r[0] for r in seeking.select("size").distinct().collect()]  # GRAM rows at most
    grams = F.flatten(F.array(*[_grams(F.col("text"), F.lit(n)) for n in sizes])) if sizes else F.array().cast("array<string>")
    wanted = broadcast_if_small(seeking.select("gram").distinct())
    holding = materialize(
        texts.select("text", F.explode(grams).alias("gram")).join(wanted, "gram", "left_semi"), "text-grams")
    rows = holding.groupBy("gram").agg(F.count(F.lit(1)).alias("n_holding"))
    rarest = materialize(
        seeking.join(rows, "gram", "left").groupBy("needle").agg(
            F.min(F.struct(F.coalesce("n_holding", F.lit(0)).alias("n"), "gram")).alias("g"))
        .filter("g.n > 0").select(F.col("g.gram").alias("node"), "needle"), "rarest-grams")
    nodes = rarest.groupBy("node").agg(F.count(F.lit(1)).alias("n_sought")).join(rows.withColumnRenamed("gram", "node"), "node")
    left, right = compared(
        rarest.select("node", F.col("needle").alias("name"), F.lit(None).alias("path")),
        holding.select(F.col("gram").alias("node"), F.col("text").alias("id"), F.lit(None).alias("words")),
        broadcast_if_small(nodes), cell_rows)
    met = left.join(right, ["node", "i", "j"]).filter(F.contains(F.col("id"), F.col("name")))
    return met.select(F.col("id").alias("text"), F.col("name").alias("needle"))


def _matches_of_table(postings: DataFrame, targets: DataFrame, company: Column, title: Column) -> DataFrame:
    """Distinct companies and titles are matched once; postings look theirs up."""
    needles = materialize(targets.select(F.col("target").alias("needle")).filter(F.col("needle").isNotNull()).distinct(), "needles")
    texts = postings.select(F.explode(F.array(company, title)).alias("text")).filter(F.col("text").isNotNull()).distinct()
    found = containing(materialize(texts, "texts"), needles.filter("needle <> ''"))
    by_text = materialize(found.groupBy("text").agg(F.collect_list("needle").alias("_targets")), "matches")  # a text's own parts
    none = F.array().cast("array<string>")
    everywhere = none if needles.filter("needle = ''").isEmpty() else F.when(
        company.isNotNull() | title.isNotNull(), F.array(F.lit(""))).otherwise(none)
    looked = postings.withColumns({"_company": company, "_title": title})
    for side in ("_company", "_title"):
        looked = looked.join(by_text.select(F.col("text").alias(side), F.col("_targets").alias(f"{side}_targets")), side, "left")
    hits = F.array_distinct(F.concat(F.coalesce("_company_targets", none), F.coalesce("_title_targets", none), everywhere))
    return looked.withColumn("target", F.explode(hits)).select(*postings.columns, "target")
