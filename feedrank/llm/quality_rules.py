"""Quality rules: a decision list learned by sequential covering.

Each rule is a conjunction of thresholds on text statistics that says "low
quality". A rule is grown on two thirds of the labelled rows, one condition at
a time by information gain, then pruned on the other third by dropping its last
conditions; it is kept if it is precise enough there. Rows that it covers leave,
and the next rule is grown on the rest. Every step reads counts per statistic
and threshold that Spark adds up over all labelled rows. The list becomes one
ordered conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import common as C

SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\x0b\x0c\r"
RUN = 8
LEAST_WORDS = 20
MOST_REPEATED = (30, 100)
#: Statistics that rules may use, as ratios so that they do not depend on length.
FEATURES = ("symbols", "word_length", "stops", "capitals", "digits", "dup_lines", "repeats", "lines")
CUTS = 32
MOST_RULES = 12
MOST_CONDITIONS = 4
#: A rule must be this precise on the pruning rows, so that clean documents stay.
LEAST_PRECISION = 0.9
#: Low-quality rows that a rule must cover, growing and pruning rows together.
LEAST_COVERED = 5


def _without(text: Column, characters: str) -> Column:
    """Code points of the text that are not among the characters."""
    return F.length(F.translate(text, characters, ""))


def _repeated_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """Words that lie in runs of RUN words found twice or more in the same text.

    Fingerprints of runs of 2, 4 and 8 words are made from each other. Only
    texts in which a fingerprint repeats sort theirs to find where.
    """
    n = F.size(words)
    df = df.withColumn("_h", F.transform(words, lambda w: F.xxhash64(w)))
    width = 1
    while width < RUN:
        keep = F.greatest(n - (2 * width - 1), F.lit(0))
        df = df.withColumn(
            "_h",
            F.zip_with(
                F.slice("_h", 1, keep), F.slice("_h", F.lit(width + 1), keep), lambda a, b: F.xxhash64(a, b)
            ),
        )
        width *= 2
    runs = F.size("_h")
    ordered = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(i: Column) -> Column:
        here = F.get("_t", i)["h"]
        return F.coalesce(here == F.get("_t", i - 1)["h"], F.lit(False)) | F.coalesce(
            here == F.get("_t", i + 1)["h"], F.lit(False)
        )

    df = df.withColumn("_t", F.when(F.size(F.array_distinct("_h")) < runs, ordered))
    spots = F.sort_array(
        F.transform(F.filter(F.sequence(F.lit(0), F.size("_t") - 1), repeated), lambda i: F.get("_t", i)["i"])
    )
    covered = F.aggregate(
        spots,
        F.struct(F.lit(-RUN).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(RUN), i - a["last"])).alias("n")),
    )["n"]
    return df.withColumn(out, F.when(F.col("_t").isNotNull(), covered).otherwise(F.lit(0).cast("long"))).drop("_h", "_t")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, and the rule statistics of every whole text (null as empty)."""
    df = docs.select("doc_id", C.whole_text().alias("_text"), C.text_check()).withColumn(
        "_words", F.regexp_extract_all("_text", F.lit(C.WORD), F.lit(0))
    )
    df = _repeated_words(df, "_words", "n_repeat_words")
    text = F.col("_text")
    df = df.withColumn("n_words", F.size("_words").cast("long")).withColumn(
        "_lines", F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, _BLANKS, "")) > 0)
    )
    df = df.select(
        "doc_id",
        "check",
        "n_words",
        _without(text, _BLANKS).cast("long").alias("word_chars"),
        (F.length(text) - _without(text, SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("_lines").alias("_n_lines"),
        (F.length(text) - _without(text, ".!?,;")).alias("_stops"),
        (F.length(text) - _without(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("_capitals"),
        (F.length(text) - _without(text, "0123456789")).alias("_digits"),
    )
    words = F.greatest(F.col("n_words"), F.lit(1))
    part, whole = MOST_REPEATED
    return df.select(
        "doc_id", "check", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < LEAST_WORDS) | (whole * F.col("n_repeat_words") > part * F.col("n_words"))).alias("base_failed"),
        (F.col("n_symbols") / words).alias("symbols"),
        (F.col("word_chars") / words).alias("word_length"),
        (F.col("_stops") / words).alias("stops"),
        (F.col("_capitals") / words).alias("capitals"),
        (F.col("_digits") / words).alias("digits"),
        (F.col("n_dup_lines") / F.greatest(F.col("_n_lines"), F.lit(1))).alias("dup_lines"),
        (F.col("n_repeat_words") / words).alias("repeats"),
        (F.col("_n_lines") / words).alias("lines"),
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        value, cut = F.col(self.feature), F.lit(self.threshold)
        return value >= cut if self.at_least else value < cut

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _matches(rule: Rule) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & condition.column()
    return out


def verdict(rules: list[Rule]) -> Column:
    """Number (from 1) of the first rule that matches, 0 for none: an ordered conditional expression."""
    out = None
    for number, rule in enumerate(rules, 1):
        out = F.when(_matches(rule), number) if out is None else out.when(_matches(rule), number)
    return F.lit(0) if out is None else out.otherwise(0)


def _cut_points(rows: DataFrame) -> dict[str, list[float]]:
    """Thresholds of each statistic: quantiles over all rows, and over the low-quality rows."""
    at = [(i + 1) / (CUTS + 1) for i in range(CUTS)]
    low = [F.percentile_approx(F.when(F.col("low"), F.col(f)), at).alias(f"low_{f}") for f in FEATURES]
    every = [F.percentile_approx(f, at).alias(f"all_{f}") for f in FEATURES]
    found = rows.agg(*low, *every).first()
    return {f: sorted({*(found[f"low_{f}"] or []), *(found[f"all_{f}"] or [])}) for f in FEATURES}


def _histogram(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[str, list[list[int]]]:
    """Per statistic and bin (cuts at or below the value): rows of low and of good quality."""


    def bin_of(feature: str) -> Column:
        points = F.lit(cuts[feature]).cast("array<double>")
        return F.size(F.filter(points, lambda c: c <= F.col(feature)))

    bins = [F.struct(F.lit(k).alias("f"), bin_of(f).alias("bin")) for k, f in enumerate(FEATURES)]
    counts = (
        rows.select("low", F.explode(F.array(*bins)).alias("b"))
        .groupBy("b.f", "b.bin")
        .agg(F.sum(F.col("low").cast("long")).alias("low"), F.sum((~F.col("low")).cast("long")).alias("good"))
        .collect()  # at most a few hundred rows of counts
    )
    out = {f: [[0, 0] for _ in range(len(cuts[f]) + 1)] for f in FEATURES}
    for r in counts:
        out[FEATURES[r.f]][r.bin] = [r.low, r.good]
    return out


def _best_condition(hist: dict[str, list[list[int]]], cuts: dict[str, list[float]]) -> tuple[float, int, Condition | None]:
    """The condition of most information gain, its gain, and the good rows it leaves; ties to the first."""
    best: tuple[float, int, Condition | None] = (0.0, 0, None)
    for f in FEATURES:
        low = sum(b[0] for b in hist[f])
        good = sum(b[1] for b in hist[f])
        if not low:
            return best
        before = math.log2(low / (low + good))
        under = [0, 0]
        for k, cut in enumerate(cuts[f]):
            under = [under[0] + hist[f][k][0], under[1] + hist[f][k][1]]
            over = [low - under[0], good - under[1]]
            for (p, n), at_least in ((over, True), (under, False)):
                if p:
                    gain = p * (math.log2(p / (p + n)) - before)
                    if gain > best[0] + 1e-9:
                        best = (gain, n, Condition(f, at_least, cut))
    return best


def learn(labelled: DataFrame, least_precision: float = LEAST_PRECISION) -> list[Rule]:
    """Learn the rules from rows with the statistics and ``low`` (boolean).

    The counts of each step cover every labelled row that no earlier rule
    covers. No rows, or rows of one quality only, give no rules.
    """
    rows = materialize(
        labelled.select("low", *FEATURES, (F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0).alias("grow")), "rule-rows"
    )
    cuts = _cut_points(rows)
    rules: list[Rule] = []
    while len(rules) < MOST_RULES:
        left = rows.filter(verdict(rules) == 0)
        rule: Rule = ()
        while len(rule) < MOST_CONDITIONS:
            gain, good, condition = _best_condition(
                _histogram(left.filter("grow").filter(_matches(rule)), cuts), cuts
            )
            if condition is None:
                break
            rule = (*rule, condition)
            if not good:
                break
        if not rule:
            break
        prefixes = [rule[:n] for n in range(1, len(rule) + 1)]
        sums = []
        for k, prefix in enumerate(prefixes):
            for name, label in (("low", F.col("low")), ("good", ~F.col("low"))):
                hit = _matches(prefix) & label
                sums.append(F.count_if(hit & ~F.col("grow")).alias(f"{name}_{k}"))
                sums.append(F.count_if(hit).alias(f"all_{name}_{k}"))
        found = left.agg(*sums).first()
        scored = [
            ((p - n) / max(p + n, 1), p / max(p + n, 1), found[f"all_low_{k}"], prefix)
            for k, prefix in enumerate(prefixes)
            for p, n in [(found[f"low_{k}"], found[f"good_{k}"])]
        ]
        _, precision, covered, pruned = max(scored, key=lambda s: s[0])
        if covered < LEAST_COVERED or precision < least_precision:
            break
        rules.append(pruned)
    return rules


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: the base counts, base_failed, rule (0: none), kept, and a hash of the text.

    Labels with a null doc_id or another quality than 0 and 1 are ignored; of
    several labels of a document the lower counts. Null and empty texts have no
    words, so they fail the base rule. Repeated rows are judged alike. An empty
    table gives no rows.
    """
    rows = materialize(statistics(docs), "rule-statistics")
    quality = (
        labels.filter("quality in (0, 1) and doc_id is not null")
        .groupBy("doc_id")
        .agg((F.min("quality") == 0).alias("low"))
    )
    rules = learn(rows.filter("not base_failed").join(quality, "doc_id"))
    number = verdict(rules)
    return rows.withColumn("rule", number.cast("int")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule", "check",
    )


def op1_quality_rules(spark, sf_dir):
    return judge(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels")).drop("check")
