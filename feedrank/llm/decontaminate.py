"""Benchmark decontamination with a generalised suffix automaton of the test items.

The normalised items become one automaton over word numbers. Each document's
words are streamed through it: the state and the length of the longest match
that ends at a word tell whether the last WINDOW words stand in some item, and
whether a whole shorter item ends there. Words inside such matches are hit; runs
of hit words are removed where they reach a length, and whole documents where
hit words reach a share.

A match is a chain of neighbouring item words. Stretches of a document whose
neighbours are neighbours in some item are found first, by an exact lookup of
word pairs; the automaton reads those that are long enough for a match, since
it would be back at its root everywhere else.

The items are a query set, taken in blocks of at most BLOCK_WORDS words or one
item; each block's automaton passes over all documents and adds to the
hits of the blocks before it, in the same task, without a shuffle.

Defined results: null and empty texts have no words and no hits; null and empty
items have no windows. Repeated rows are rows of their own. Equal item_ids are
one item; the name of a null item_id is empty. Texts of any length are read
whole, in pieces. Extra columns are ignored, whatever their names. Empty tables
give no rows, or no hits.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import common as C
from .arrow import list_array, slices
from .tokens import LOWER, pieces

#: Consecutive item words that make a hit (a shorter item as a whole).
WINDOW = 10
#: Words of the items in one automaton.
BLOCK_WORDS = 1 << 17
#: Automata that one stage passes.
PASSES = 4
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_SCHEMA = "doc_id long, text string, n_words long, starts array<long>, ends array<long>, items array<string>"


def words(text: bytes) -> list[bytes]:
    return _WORD.findall(text.translate(LOWER))


class Automaton:
    """Suffix automaton of several word sequences; matches come as word spans and item names."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.number: dict[bytes, int] = {}
        sequences = [(name, [self.number.setdefault(w, len(self.number)) for w in own]) for name, own in items if own]
        self.length, self.link, self.next = [0], [-1], [{}]
        for _, own in sequences:
            last = 0
            for word in own:
                last = self._extend(last, word)
        self.shortest = min([window, *[len(own) for _, own in sequences]])
        self.size = max(1, len(self.number))
        self.pairs = np.unique(np.array([a * self.size + b for _, own in sequences for a, b in zip(own, own[1:])], np.int64))
        #: State that holds the last ``window`` words of a state's strings.
        self.holder = [0] * len(self.length)
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            up = self.link[state]
            self.holder[state] = state if self.length[up] < window else self.holder[up]
        #: Items that hold a window state's words: one entry for each place in an item at most.
        self.owners: dict[int, set[str]] = defaultdict(set)
        #: Shorter items by the state that holds all their words.
        self.whole: dict[int, dict[int, set[str]]] = defaultdict(lambda: defaultdict(set))
        for name, own in sequences:
            state = 0
            for i, word in enumerate(own):
                state = self.next[state][word]
                if i + 1 >= window:
                    self.owners[self.holder[state]].add(name)
            if len(own) < window:
                while self.length[self.link[state]] >= len(own):
                    state = self.link[state]
                self.whole[state][len(own)].add(name)
        #: Nearest state on the way to the root, itself included, that ends a shorter item.
        self.ending = [-1] * len(self.length)
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            self.ending[state] = state if state in self.whole else self.ending[self.link[state]]
        self.owners, self.whole = dict(self.owners), {k: dict(v) for k, v in self.whole.items()}

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(moves)
        return len(self.length) - 1

    def _split(self, state: int, word: int) -> int:
        """The state of exactly the strings of ``state`` followed by ``word``."""
        goal = self.next[state][word]
        if self.length[goal] == self.length[state] + 1:
            return goal
        copy = self._state(self.length[state] + 1, self.link[goal], dict(self.next[goal]))
        self.link[goal] = copy
        while state >= 0 and self.next[state].get(word) == goal:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new = self._state(self.length[last] + 1, 0, {})
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, word)
        return new

    def stretches(self, numbers: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of words, each the neighbour of the next in some item, long enough for a match."""
        known = numbers >= 0
        joined = np.zeros(len(numbers), bool)  # with the word before
        if len(self.pairs):
            at = np.flatnonzero(known[1:] & known[:-1])
            keys = numbers[at].astype(np.int64) * self.size + numbers[at + 1]
            place = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
            joined[at[self.pairs[place] == keys] + 1] = True
        starts = np.flatnonzero(known & ~joined)
        ends = np.flatnonzero(known & ~np.concatenate([joined[1:], [False]])) + 1
        fit = ends - starts >= self.shortest
        return list(zip(starts[fit].tolist(), ends[fit].tolist()))

    def stream(self, numbers: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word spans of all matches, and the items that match."""
        length, link, moves, window = self.length, self.link, self.next, self.window
        state = matched = 0
        spans: list[tuple[int, int]] = []
        states, names = set(), set()
        for end, word in enumerate(numbers, 1):
            while state and word not in moves[state]:
                state = link[state]
                matched = length[state]
            goal = moves[state].get(word)
            if goal is None:
                continue
            state, matched = goal, matched + 1
            if matched >= window:
                spans.append((end - window, end))
                states.add(self.holder[state])
            short = self.ending[state]
            while short > 0:
                for size, own in self.whole[short].items():
                    if size <= matched:
                        spans.append((end - size, end))
                        names |= own
                short = self.ending[link[short]] if link[short] > 0 else -1
        for s in states:
            names |= self.owners[s]
        return spans, names

    def match(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, hit spans of words and items of a text."""
        get = self.number.get
        parts = [np.fromiter((get(w, -1) for w in words(p)), np.int32) for p in pieces(text)]
        numbers = np.concatenate(parts)
        spans, names = [], set()
        for low, high in self.stretches(numbers):
            found, own = self.stream(numbers[low:high].tolist())
            spans += [(low + a, low + b) for a, b in found]
            names |= own
        return len(numbers), spans, names


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans in ascending order that cover the same places; touching ones are one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _batch(ids, texts, counts, spans, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            ids, texts, pa.array(counts, pa.int64()),
            list_array([np.array([s for s, _ in own], np.int64) for own in spans], pa.int64()),
            list_array([np.array([e for _, e in own], np.int64) for own in spans], pa.int64()),
            pa.array(names, pa.list_(pa.string())),
        ],
        ["doc_id", "text", "n_words", "starts", "ends", "items"],
    )


def _match(automaton, keep_text: bool):
    """``automaton``: a broadcast one."""

    def run(batches):
        own = automaton.value
        for batch, texts in slices(batches, "text"):
            held = [batch.column(k).to_pylist() for k in (3, 4, 5)]
            counts, spans, names = [], [], []
            for text, starts, ends, items in zip(texts, *held):
                n, found, new = own.match(text)
                counts.append(n)
                spans.append(merged([*zip(starts, ends), *found]))
                names.append(sorted({*items, *new}))
            texts_out = batch.column(1) if keep_text else pa.nulls(len(batch), pa.string())
            yield _batch(batch.column(0), texts_out, counts, spans, names)

    return run


def item_blocks(items: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The distinct items as (name, words), in blocks of at most ``block_words`` words (or one item)."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), C.whole_text().alias("text")).distinct()
    block, total = [], 0
    for r in rows.toLocalIterator():
        own = words(r.text.encode())
        if block and total + len(own) > block_words:
            yield block
            block, total = [], 0
        block.append((r.name, own))
        total += len(own)
    yield block


def matches(
    documents: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, keep_text: bool = True
) -> DataFrame:
    """Per document: doc_id, text (null if not kept), n_words, hit spans of words (starts, ends) and matching items."""
    spark = documents.sparkSession
    none = F.array().cast("array<long>")
    found = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("n_words"),
        none.alias("starts"), none.alias("ends"), F.array().cast("array<string>").alias("items"))
    blocks, k = item_blocks(items, block_words), 0
    block = next(blocks)
    while block is not None:
        after = next(blocks, None)
        automaton = spark.sparkContext.broadcast(Automaton(block, window))
        found = found.mapInArrow(_match(automaton, keep_text or after is not None), _SCHEMA)
        k += 1
        if k % PASSES == 0 and after is not None:
            found = materialize(found, "decontaminate-blocks")
        block = after
    return found


def _clean(least_words: int, most_hit: float):
    def run(batches):
        for batch, texts in slices(batches, "text"):
            counts, starts, ends = (batch.column(k).to_pylist() for k in (2, 3, 4))
            kept, lows, highs, whole = [], [], [], []
            for text, n, a, b in zip(texts, counts, starts, ends):
                hit = sum(b) - sum(a)
                spans = [(x, y) for x, y in zip(a, b) if y - x >= least_words]
                places: list[tuple[int, int]] = []
                if spans:
                    todo, k = iter(spans), 0
                    low, high = next(todo)
                    for k, word in enumerate(_WORD.finditer(text.translate(LOWER))):
                        if k == low:
                            places.append((word.start(), 0))
                        if k == high - 1:
                            places[-1] = (places[-1][0], word.end())
                            low, high = next(todo, (n, n + 1))
                left, at = [], 0
                for x, y in places:
                    left.append(text[at:x])
                    at = y
                kept.append(b"".join([*left, text[at:]]).decode())
                lows.append(np.array([x for x, _ in places], np.int64))
                highs.append(np.array([y for _, y in places], np.int64))
                whole.append(bool(n) and hit > most_hit * n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.string()), list_array(lows, pa.int64()), list_array(highs, pa.int64()), pa.array(whole), batch.column(5)],
                ["doc_id", "kept_text", "removed_from", "removed_to", "dropped", "items"],
            )

    return run


def decontaminate(
    documents: DataFrame, items: DataFrame, window: int = WINDOW, least_words: int = WINDOW, most_hit: float = 0.5,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Texts without the hit stretches of ``least_words`` words or more.

    Per document: doc_id, kept_text, the removed byte ranges (removed_from,
    removed_to), dropped (more than ``most_hit`` of its words are hit) and items.
    """
    found = matches(documents, items, window, block_words)
    return found.mapInArrow(
        _clean(least_words, most_hit),
        "doc_id long, kept_text string, removed_from array<long>, removed_to array<long>, dropped boolean, items array<string>")


def digests(found: DataFrame) -> DataFrame:
    total = lambda name: F.aggregate(name, F.lit(0).cast("long"), lambda a, x: a + x)
    hit: Column = total("ends") - total("starts")
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op11_decontaminate(spark, sf_dir):
    found = matches(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"), keep_text=False)
    return digests(found)


OP11_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT coalesce(item_id::VARCHAR, '') AS name,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT name, size, array_to_string(w[i : i + size - 1], ' ') AS words
  FROM (SELECT name, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)),
size AS (SELECT DISTINCT size FROM win),
gram AS (
  SELECT r, size, i, array_to_string(w[i : i + size - 1], ' ') AS words
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc, size)),
found AS (SELECT r, size, i, name FROM gram JOIN win USING (size, words)),
hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS k FROM found) GROUP BY r),
own AS (
  SELECT r, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT r, name FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN own USING (r)
"""
