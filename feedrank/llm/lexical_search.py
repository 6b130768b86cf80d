"""Ranked lexical search by bag deduplication.

Documents are restricted to the vocabulary of the items: what is left of one is
a vector of term counts and its length norm m. Documents with equal vectors and
m have equal scores for every item, so they form a class, which is scored once;
only the classes that reach an item's best are expanded to their members, in
ascending doc_id.

Items are a query set: it is taken in blocks of bounded size, and each block
meets all documents. Documents are never paired with each other. Per item and
task only the best classes leave the task.

Defined results: a null or empty text has no terms and is found by no item. Each
row is a document: repeated rows, and rows that share a doc_id, have a rank
each; a null doc_id ranks after all others of its score. Equal rows
of the items are one item; an item without terms, or without a match, returns
nothing. Texts of any length are read whole, in pieces. Extra columns are
ignored, whatever their names. Empty tables give an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialize
from . import common as C
from .arrow import list_array, slices
from .tokens import LOWER, pieces

#: Documents that an item returns: the report's length.
TOP = 20
#: Bytes of item texts in one block (one larger item is a block of its own size).
BLOCK_BYTES = 4 << 20
#: Scores that a task adds up at once.
CELLS = 1 << 20
_TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_CLASS = ["hash", "m", "terms", "tfs"]


def terms(text: bytes) -> list[bytes]:
    return _TERM.findall(text.translate(LOWER))


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """The distinct (item_id, text) rows that have terms, block after block."""
    rows = items.select("item_id", C.whole_text().alias("text")).distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for k in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        block = [(r.item_id, Counter(terms(r.text.encode()))) for r in part.toLocalIterator()]
        block = [x for x in block if x[1]]
        if block:
            yield block


def _bags(vocabulary: dict[bytes, int]):
    """(doc_id, terms with repeats, vocabulary terms, their counts) of each document."""

    def run(batches):
        get = vocabulary.get
        for batch, texts in slices(batches, "text"):
            n, found, counts = [], [], []
            for text in texts:
                bag: Counter = Counter()
                own = 0
                for piece in pieces(text):
                    words = terms(piece)
                    own += len(words)
                    bag.update(map(get, words))
                bag.pop(None, None)
                order = sorted(bag)
                n.append(own)
                found.append(np.array(order, np.int32))
                counts.append(np.array([bag[t] for t in order], np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), list_array(found, pa.int32()), list_array(counts, pa.int64())],
                ["doc_id", "n", "terms", "tfs"],
            )

    return run


class Postings:
    """The items of each vocabulary term with the term's occurrences in the item."""

    def __init__(self, block: list[tuple], vocabulary: dict[bytes, int]) -> None:
        pairs = sorted((vocabulary[t], i, c) for i, (_, bag) in enumerate(block) for t, c in bag.items())
        term, self.item, self.count = (np.array(x, np.int64) for x in zip(*pairs))
        self.start = np.searchsorted(term, np.arange(len(vocabulary) + 1))
        self.size = np.diff(self.start)
        self.n_items = len(block)

    def scores(self, row: np.ndarray, term: np.ndarray, part: np.ndarray, n_rows: int) -> np.ndarray:
        """Sums per (row, item) of the parts of the rows' terms."""
        out = np.zeros(n_rows * self.n_items, np.int64)
        size = self.size[term]
        edges = np.concatenate([[0], np.cumsum(size)])
        low = 0
        while low < len(term):
            high = max(low + 1, int(np.searchsorted(edges, edges[low] + CELLS, "right")) - 1)
            own = size[low:high]
            at = np.repeat(self.start[term[low:high]] - (edges[low:high] - edges[low]), own) + np.arange(edges[high] - edges[low])
            np.add.at(out, np.repeat(row[low:high], own) * self.n_items + self.item[at], np.repeat(part[low:high], own) * self.count[at])
            low = high
        return out.reshape(n_rows, self.n_items)


def _best(found: np.ndarray, top: int) -> np.ndarray:
    """Of rows (item, score, missing, id, hash), each item's first ``top``."""
    found = found[np.lexsort((found[:, 4], found[:, 3], found[:, 2], -found[:, 1], found[:, 0]))]
    place = np.arange(len(found)) - np.searchsorted(found[:, 0], found[:, 0])
    return found[place < top]


def _score(postings: Postings, weights: np.ndarray, top: int):
    """Each item's ``top`` classes of a task."""

    def run(batches):
        kept = np.zeros((0, 5), np.int64)
        least = np.ones(postings.n_items, np.int64)
        step = max(1, CELLS // postings.n_items)
        for whole in batches:
            for low in range(0, len(whole), step):
                batch = whole.slice(low, step)
                m, missing, first, name = (np.asarray(batch.column(k)) for k in range(4))
                sizes = np.asarray(batch.column(4).value_lengths())
                term, tf = batch.column(4).flatten().to_numpy(), batch.column(5).flatten().to_numpy()
                row = np.repeat(np.arange(len(batch)), sizes)
                part = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[row]))
                table = postings.scores(row, term, part, len(batch))
                rows, item = np.nonzero(table >= least)
                new = np.stack([item, table[rows, item], missing[rows], first[rows], name[rows]], axis=1).astype(np.int64)
                kept = np.concatenate([kept, new])
                if len(kept) > 4 * top * postings.n_items:
                    kept = _best(kept, top)
                    full = np.bincount(kept[:, 0], minlength=postings.n_items) >= top
                    lows = np.full(postings.n_items, np.iinfo(np.int64).max)
                    np.minimum.at(lows, kept[:, 0], kept[:, 1])
                    least = np.where(full, lows, 1)  # equal scores may still win by doc_id
        kept = _best(kept, top)
        if len(kept):
            yield pa.RecordBatch.from_arrays(
                [pa.array(kept[:, k].astype(np.int32 if k in (0, 2) else np.int64)) for k in range(5)],
                ["item", "score", "missing", "first", "hash"],
            )

    return run


def _search_block(documents: DataFrame, block: list[tuple], top: int) -> DataFrame:
    spark = documents.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, bag in block for t in bag}))}
    postings = Postings(block, vocabulary)
    bags = materialize(
        documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
            _bags(vocabulary), "doc_id long, n long, terms array<int>, tfs array<long>"),
        "search-bags",
    )
    total = bags.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("words")).first()
    n_docs, n_words = total.docs, max(1, total.words or 0)
    df = np.zeros(len(vocabulary), np.int64)
    for r in bags.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row for each vocabulary term
        df[r.term] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)

    rows = (
        bags.filter(F.size("terms") > 0)
        .withColumn("m", F.expr(f"75L + ((25L * n * {n_docs}L) div {n_words}L)"))
        .select(
            F.xxhash64("m", "terms", "tfs").alias("hash"), "m", "terms", "tfs",
            F.col("doc_id").isNull().cast("int").alias("missing"), F.coalesce("doc_id", F.lit(0)).alias("id"))
    )
    # Grouped by the hash and all that it stands for: equal hashes alone make no class.
    classes = materialize(
        rows.groupBy(*_CLASS).agg(F.min(F.struct("missing", "id")).alias("f")).select(*_CLASS, F.col("f.missing").alias("missing"), F.col("f.id").alias("first")),
        "search-classes",
    )
    scored = classes.select("m", "missing", "first", "hash", "terms", "tfs").mapInArrow(
        _score(postings, weights, top), "item int, score long, missing int, first long, hash long")

    def first_of(df: DataFrame, per: list[str], *order) -> DataFrame:
        w = Window.partitionBy(*per).orderBy(*order)
        return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top)

    # A document of an item's best lies in one of its first classes by (score, least doc_id).
    best = materialize(first_of(scored, ["item"], F.desc("score"), "missing", "first", "hash").drop("place"), "search-best")
    name = ["hash", "missing", "first"]
    wanted = best.select(*name).distinct()
    chosen = classes.join(broadcast_if_small(wanted), name, "left_semi")
    hashes = broadcast_if_small(best.select("hash").distinct())
    members = first_of(rows.join(hashes, "hash", "left_semi"), _CLASS, "missing", "id").select(
        *_CLASS, F.col("missing").alias("id_missing"), "id")
    members = chosen.join(members, _CLASS).select(*name, "id_missing", "id")
    ranked = first_of(best.join(members, name), ["item"], F.desc("score"), "id_missing", "id")
    ids = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], "item int, item_id long")
    return ranked.join(F.broadcast(ids), "item").select(  # a row for each item of the block
        "item_id", F.col("place").cast("int").alias("rank"),
        F.when(F.col("id_missing") == 0, F.col("id")).alias("doc_id"), "score")


def search(documents: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of each item, see the module's text."""
    out = None
    for block in item_blocks(items, block_bytes):
        found = _search_block(documents, block, top)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return documents.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out


def op13_lexical_search(spark, sf_dir):
    return search(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
item_term AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM (SELECT DISTINCT item_id, text FROM benchmark))
  GROUP BY ALL),
total AS (SELECT count(*) FILTER (len(words) > 0) AS n_docs, greatest(1, sum(len(words)))::BIGINT AS n_words FROM doc),
tf AS (
  SELECT r, term, count(*) AS tf
  FROM (SELECT r, unnest(words) AS term FROM doc) WHERE term IN (SELECT term FROM item_term)
  GROUP BY ALL),
weight AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tf, total GROUP BY term, n_docs),
norm AS (SELECT r, doc_id, 75 + (25 * len(words)::BIGINT * n_docs) // n_words AS m FROM doc, total),
scored AS (
  SELECT item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM tf JOIN weight USING (term) JOIN norm USING (r) JOIN item_term USING (term)
  GROUP BY ALL)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank
      FROM scored WHERE score > 0)
WHERE rank <= 20
"""
