"""Periodic runs of words by block convolution.

A run is a maximal stretch of words with a smallest period q and a length of at
least LEAST words and REPEATS * q. At each dyadic scale the words are cut into
blocks of B. A run with a period from B to 2B holds a whole block whose copy,
one period later, lies in the run too, so the block occurs without mismatch at
that distance in the window after it. Where it does, the sum of squared
differences of word numbers is zero; the sums at all distances come from a
convolution, computed exactly with number-theoretic transforms. Each zero is a
seed (block, distance): it is extended word by word in both directions, which
also verifies it, and the stretch is kept if no divisor of the distance is a
period of it.

Two exact tests keep blocks out of the transforms: a block that has a match at
distance d < 2B holds only words that occur again within 2B words; and a block
whose window lies inside a known run of a smaller period can only seed that run
again.

Documents are cut into slices of bounded size that are worked on as one
sequence; a number of its own between neighbours keeps runs apart.

Defined results: a null or empty text has no words and no runs. A row with a
null doc_id is not rewritten by the query. Repeated rows are rows of their own.
Texts of any length are read whole (a long one is a slice of its own). Extra
columns are ignored, whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .arrow import slices
from .tokens import pieces

#: Shortest run, in words, and in periods.
LEAST = 24
REPEATS = 3
#: Blocks of the first scale; it also covers all smaller periods.
FIRST = 8
#: A prime of the form k * 2^27 + 1, with a generator of its units: residues multiply inside 64 bits.
PRIME = 2013265921
GENERATOR = 31
#: Residues that are transformed at once (one block of a very long text may need more).
CELLS = 1 << 18
_P = np.uint64(PRIME)


@functools.lru_cache(maxsize=None)
def _roots(size: int, inverse: bool) -> list[np.ndarray]:
    """Powers of the roots of unity for each level of a transform, from the largest."""
    out = []
    while size > 1:
        root = pow(GENERATOR, (PRIME - 1) // size, PRIME)
        root = pow(root, -1, PRIME) if inverse else root
        powers = np.ones(1, np.uint64)
        while len(powers) < size // 2:
            powers = np.concatenate([powers, powers * np.uint64(pow(root, len(powers), PRIME)) % _P])
        out.append(powers[: size // 2])
        size //= 2
    return out


def transform(rows: np.ndarray) -> np.ndarray:
    """Transforms of the rows, in bit-reversed order."""
    n, size = rows.shape
    for powers in _roots(size, False):
        half = len(powers)
        pair = rows.reshape(n, -1, 2, half)
        a, b = pair[:, :, 0], pair[:, :, 1]
        rows = np.stack([(a + b) % _P, (a + _P - b) % _P * powers % _P], axis=2).reshape(n, size)
    return rows


def restore(rows: np.ndarray) -> np.ndarray:
    """Rows whose transforms, in bit-reversed order, are given."""
    n, size = rows.shape
    for powers in reversed(_roots(size, True)):
        half = len(powers)
        pair = rows.reshape(n, -1, 2, half)
        a, b = pair[:, :, 0], pair[:, :, 1] * powers % _P
        rows = np.stack([(a + b) % _P, (a + _P - b) % _P], axis=2).reshape(n, size)
    return rows * np.uint64(pow(size, -1, PRIME)) % _P


def zero_distances(blocks: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) where a block (B words) equals its window (2B words) from place on, for places below B.

    The sum of squared differences modulo a prime is zero there. Where a sum
    is a multiple of the prime without being zero, the seed does not verify.
    """
    n, size = blocks.shape
    blocks, windows = blocks.astype(np.uint64) % _P, windows.astype(np.uint64) % _P
    squares = np.zeros((n, 2 * size + 1), np.uint64)
    np.cumsum(windows * windows % _P, axis=1, out=squares[:, 1:])
    turned = np.zeros((n, 2 * size), np.uint64)
    turned[:, 0] = blocks[:, 0]
    turned[:, size + 1 :] = blocks[:, :0:-1]
    product = restore(transform(turned) * transform(windows) % _P)[:, :size]
    total = (blocks * blocks % _P).sum(axis=1)[:, None] + squares[:, size : 2 * size] - squares[:, :size]
    return np.nonzero((total + 2 * (_P - product)) % _P == 0)


def _grow(x: np.ndarray, low: int, high: int, d: int) -> tuple[int, int]:
    """The longest range around [low, high) in which x[i] == x[i + d]; empty if the range itself has a mismatch."""
    if not np.array_equal(x[low:high], x[low + d : high + d]):
        return low, low
    step = 64
    while high + d < len(x):
        end = min(high + step, len(x) - d)
        differ = np.flatnonzero(x[high:end] != x[high + d : end + d])
        if len(differ):
            high += int(differ[0])
            break
        high, step = end, 2 * step
    step = 64
    while low > 0:
        start = max(0, low - step)
        differ = np.flatnonzero(x[start:low] != x[start + d : low + d])
        if len(differ):
            low = start + int(differ[-1]) + 1
            break
        low, step = start, 2 * step
    return low, high


def _primes(n: int) -> list[int]:
    out, f = [], 2
    while f * f <= n:
        if n % f == 0:
            out.append(f)
            while n % f == 0:
                n //= f
        f += 1
    return [*out, n] if n > 1 else out


def _again(x: np.ndarray) -> np.ndarray:
    """Distance to the next equal number (very large where there is none)."""
    order = np.argsort(x, kind="stable")
    out = np.full(len(x), np.iinfo(np.int64).max)
    same = x[order[1:]] == x[order[:-1]]
    out[order[:-1][same]] = order[1:][same] - order[:-1][same]
    return out


def runs(x: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in a sequence of numbers; no run is longer than ``longest``."""
    again = _again(x)
    found: list[tuple[int, int, int]] = []
    size = FIRST
    while size * REPEATS <= longest or size == FIRST:
        if size > FIRST and size * REPEATS > longest:
            break
        usable = len(x) // size
        starts = np.flatnonzero(again[: usable * size].reshape(usable, size).max(axis=1) < 2 * size) * size if usable else np.zeros(0, np.int64)
        # Stretches of known runs are at least three periods long, so that few overlap; the widest reach decides.
        if len(starts) and found:
            known = np.array(sorted(r for r in found if r[2] <= size), np.int64).reshape(-1, 3)
            if len(known):
                reach = np.maximum.accumulate(known[:, 0] + known[:, 1])
                last = np.searchsorted(known[:, 0], starts, "right") - 1
                starts = starts[(last < 0) | (reach[last] < starts + 3 * size)]
        offsets = (0, size) if size == FIRST else (size,)
        extended: dict[int, int] = {}  # distance -> end of its last stretch
        new: set[tuple[int, int, int]] = set()
        step = max(1, CELLS // (2 * size))
        for low in range(0, len(starts), step):
            own = starts[low : low + step]
            seeds = []
            for offset in offsets:
                at = own[:, None] + offset + np.arange(2 * size)
                windows = np.where(at < len(x), x[np.minimum(at, len(x) - 1)], len(x) + 1)
                row, place = zero_distances(x[own[:, None] + np.arange(size)], windows)
                seeds += list(zip(own[row].tolist(), (place + offset).tolist()))
            for start, d in sorted(seeds):
                if d == 0 or start < extended.get(d, 0) or start + size + d > len(x):
                    continue
                a, b = _grow(x, start, start + size, d)
                extended[d] = max(extended.get(d, 0), b)
                length = b - a + d
                if b == a or length < max(LEAST, REPEATS * d):
                    continue
                if any(np.array_equal(x[a : b + d - d // f], x[a + d // f : b + d]) for f in _primes(d)):
                    continue
                new.add((a, length, d))
        found += new
        size *= 2
    return sorted(set(found))


class Words:
    """Word numbers of texts; equal words have equal numbers."""

    def __init__(self) -> None:
        self.table: dict[bytes, int] = {}

    def number(self, text: bytes) -> np.ndarray:
        out, table = array("q"), self.table
        for piece in pieces(text):
            own = piece.split()  # at ASCII white space
            for w in own:
                if w not in table:
                    table[w] = len(table)
            out.extend(map(table.__getitem__, own))
        return np.frombuffer(out, np.int64) if len(out) else np.zeros(0, np.int64)


def rewritten(doc_id: int | None, x: np.ndarray) -> np.ndarray:
    """The query's words: every tenth document (by hash of its id) repeats a part of itself to its end."""
    n = len(x)
    if doc_id is None or n == 0:
        return x
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return x
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    return x[np.where(place < a, place, a + (place - a) % p)]


def dropped(n: int, own: list[tuple[int, int, int]]) -> np.ndarray:
    """Words that a run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in own:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) > 0


def slice_runs(sequences: list[np.ndarray], n_numbers: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each sequence; numbers are below ``n_numbers``."""
    lengths = [len(s) for s in sequences]
    firsts = np.concatenate([[0], np.cumsum(np.array(lengths, np.int64) + 1)])
    x = np.concatenate([np.append(s, n_numbers + k) for k, s in enumerate(sequences)]) if sequences else np.zeros(0, np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in sequences]
    if max(lengths, default=0) >= LEAST:
        # Numbers in the order of first use are small, whatever the slice holds.
        for start, length, period in runs(np.unique(x, return_inverse=True)[1].astype(np.int64), max(lengths)):
            k = int(np.searchsorted(firsts, start, "right")) - 1
            out[k].append((start - int(firsts[k]), length, period))
    return out


_SCHEMA = (
    "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
)


def _find(rewrite: bool):
    def run(batches):
        for batch, texts in slices(batches, "text"):
            ids, words = batch.column(0).to_pylist(), Words()
            sequences = [words.number(t) for t in texts]
            if rewrite:
                sequences = [rewritten(i, s) for i, s in zip(ids, sequences)]
            spelled = list(words.table)
            found = slice_runs(sequences, len(spelled))
            collapsed = []
            for own, s in zip(found, sequences):
                kept = s[~dropped(len(s), own)] if own else s
                collapsed.append(b" ".join(map(spelled.__getitem__, kept.tolist())).decode())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([len(s) for s in sequences], pa.int64()),
                    pa.array([[dict(zip(("start", "length", "period"), r)) for r in sorted(own, key=lambda r: (r[0], r[2]))] for own in found],
                             pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                    pa.array(collapsed, pa.string()),
                ],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    return run


def find_runs(documents: DataFrame, rewrite: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, its runs by (start, period), and the text with each run cut to one period.

    ``rewrite`` first plants a repeated stretch in every tenth document.
    """
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_find(rewrite), _SCHEMA)


def digests(found: DataFrame) -> DataFrame:
    # Longest in periods, compared exactly: length * other period, then start, then period.
    better = lambda a, b: F.when(
        b.isNull() | (a["length"] * b["period"] > b["length"] * a["period"]), a).otherwise(b)
    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda b, a: better(a, b))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return (
        found.withColumn("best", best)
        .select(
            "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
            F.col("best.length").alias("length"), F.col("best.period").alias("period"),
            F.expr("(1000L * best.length) div best.period").alias("exponent_milli"),
            F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    )


def op12_period_runs(spark, sf_dir):
    return digests(find_runs(C.table(spark, sf_dir, "documents"), rewrite=True))
