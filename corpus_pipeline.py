"""The corpus pipeline: documents to token ids, in five stages.

Each stage takes (session, documents, folder with the tables) and works on all
documents that the one before kept. A row is named by its doc_id and a hash of
its text, so ids that are null or stand twice keep their own texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedrank.llm import common, exact_dedup, jaccard_join, mixing, quality_rules, sp_codec
from feedrank.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned rules keep."""
    verdicts = quality_rules.judge(docs, common.table(spark, sf_dir, "labels"))
    return common.keep_rows(docs, verdicts.filter("kept"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return common.keep_rows(docs, exact_dedup.find_copies(docs).filter("kept"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    found = jaccard_join.near_duplicates(docs)
    return common.keep_rows(docs, jaccard_join.survivors(found))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them: some not at all, none more than three times."""
    return common.keep_rows(docs, mixing.copies(mixing.mix(docs)), "times")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and decoded texts of the documents, as digests."""
    return sp_codec.digests(sp_codec.encode_decode(docs))


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("mixing to target weights", mixture),
    ("SentencePiece encoding", encoded),
]

#: Learned rules, seeded hashes and the tokenizer have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table, each one's rows written and read again by the next."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
