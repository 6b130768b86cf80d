"""Language-model scoring: a small causal self-attention model over subword ids.

Words are split into subwords by a public vocabulary. The frequent subwords are
classes of their own, the others share classes of about equal mass; the model
predicts the next class from the last subwords, first its group and then its
place in it, and a class gives each of its
subwords its share of the training counts, plus one. A word's probability is a
fixed mixture of the model's and of the word's share of the training words; the
counts of frequent words are sent to the tasks, those of others are joined. As in
the base model, a word that training lacks is one event: its share is that of the
words that training met once, the usual estimate of what is still to come. A text is cut into blocks
of STEP targets; each block is scored once, in a window that also holds the STEP
subwords before it, many windows at a time, under a causal mask.

Counts cover all training words. The weights are trained in numpy where the
data is: in every round each task steps once through all targets of its training
documents, slice by slice, and the tasks' weights are averaged after the round.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import common as C
from . import hashing as H
from .arrow import SLICE_BYTES, keep_freed, slices
from .sp_codec import model_path

HELD_OUT, FOLDS = 2, 7
STEP = 16
SPAN = 2 * STEP
WIDTH, HIDDEN = 16, 32
CLASSES = 192
PAD, START, END, FIRST = 0, 1, 2, 3
SHARED = 40  # classes that subwords share
GROUPS = 16  # classes are predicted in two steps: their group, then their place in it
MEMBERS = CLASSES // GROUPS
ROUNDS = 1
LEAST_STEPS = 400
BATCH = 128
#: Windows scored at once; their numbers stay in a core's cache.
WINDOWS = 128
RATE = 0.01
#: Counts of so many words go to every task; those of all others are joined.
HOT_WORDS = 1 << 16
#: Words whose subwords a worker process keeps, some 40 bytes each.
CACHED_WORDS = 1 << 20
#: Share of the attention model in a word's probability; the rest goes to the training words by their counts.
ATTENTION = 0.4
_SHAPES = {
    "embed": (CLASSES, WIDTH), "query": (WIDTH, WIDTH), "key": (WIDTH, WIDTH), "value": (WIDTH, WIDTH),
    "out": (WIDTH, WIDTH), "near": (SPAN,), "up": (WIDTH, HIDDEN), "bias": (HIDDEN,), "down": (HIDDEN, WIDTH),
    "groups": (WIDTH, GROUPS), "group_prior": (GROUPS,), "turn": (GROUPS, WIDTH), "members": (WIDTH, MEMBERS), "prior": (CLASSES,),
}
#: Place i of the targets sees window places up to STEP + i; distances for the learned nearness.
_DISTANCE = STEP + np.arange(STEP)[:, None] - np.arange(SPAN)[None, :]
_CAUSAL = np.where(_DISTANCE >= 0, 0, -1e9).astype(np.float32)
_SEEN = np.maximum(_DISTANCE, 0)


def _row_of_ones(n: int) -> np.ndarray:
    return np.ones(n, np.float32)


def _sums(classes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of the rows of each class: eight rows of a class at a time, then these sums. The last row is nobody's, and 0."""
    ids = classes.astype(np.uint8).ravel()
    order, counts = np.argsort(ids, kind="stable"), np.bincount(ids, minlength=CLASSES)
    blocks = (counts + 7) >> 3
    ends = np.cumsum(blocks)
    before, all_ = ends - blocks, int(ends[-1])
    at = np.arange(len(ids)) + np.repeat(8 * before - (np.cumsum(counts) - counts), counts)
    spread = np.full((8, all_), len(ids))
    spread.ravel()[(at & 7) * all_ + (at >> 3)] = order
    eights = (_ONES[:8] @ rows.take(spread, axis=0, mode="clip").reshape(8, -1)).reshape(all_, -1)
    out, some = np.zeros((CLASSES, rows.shape[1]), np.float32), np.flatnonzero(blocks)
    out[some] = np.add.reduceat(eights, before[some], axis=0)
    return out


_ONES = np.ones(max(SPAN, GROUPS, MEMBERS), np.float32)
_EYE = np.eye(GROUPS, dtype=np.float32)


def _usual(total: np.ndarray) -> bool:
    """Sums of plain exponentials that are neither too large nor too small to divide by."""
    return bool(total.min() > 1e-30 and total.max() < 1e30)


def _softmax(logits: np.ndarray) -> np.ndarray:
    """Shares along the last axis; shifted only where the plain exponentials are too large or small."""
    n = logits.shape[-1]
    with np.errstate(over="ignore"):
        shares = np.exp(logits)
        total = shares @ _ONES[:n]
    if not (np.isfinite(total).all() and total.min() > 1e-30):
        shares = np.exp(logits - logits.max(axis=-1, keepdims=True))
        total = shares @ _ONES[:n]
    shares *= (1 / total)[..., None]
    return shares


def _shares_less(logits: np.ndarray, goals: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The softmax of each row, less one at its goal, times a number for the row."""
    n = logits.shape[1]
    with np.errstate(over="ignore"):
        shares = np.exp(logits)
        total = shares @ _ONES[:n]
    if not _usual(total):
        shares = _softmax(logits)
        total = _ONES[:1]
    shares *= (times / total)[:, None]
    shares.ravel()[np.arange(len(goals)) * n + goals] -= times
    return shares


class Model:
    """Weights, forward pass and gradients."""

    def __init__(self, flat: np.ndarray) -> None:
        self.w, at = {}, 0
        for name, shape in _SHAPES.items():
            size = math.prod(shape)
            self.w[name] = flat[at : at + size].reshape(shape)
            at += size
        self.tables()

    @staticmethod
    def fresh(prior: np.ndarray, seed: int = 5) -> np.ndarray:
        rng = np.random.default_rng(seed)
        whole = np.log(np.exp(prior).reshape(GROUPS, MEMBERS).sum(axis=1))
        fixed = {"prior": prior, "group_prior": whole, "turn": np.ones(GROUPS * WIDTH)}
        parts = []
        for name, shape in _SHAPES.items():
            scale = {"embed": 0.5, "near": 0, "bias": 0, "groups": 0.1, "members": 0.1}.get(name, 0.25)
            parts.append(fixed[name] if name in fixed else rng.normal(0, 1, shape).ravel() * scale)
        return np.concatenate(parts).astype(np.float32)

    def tables(self) -> None:
        """Query of every class; key, value and a one side by side; biases as often as a window has targets."""
        w = self.w
        self.queries = w["embed"] @ w["query"] / np.float32(math.sqrt(WIDTH))
        self.seen = np.ones((CLASSES, 2 * WIDTH + 1), np.float32)
        np.matmul(w["embed"], w["key"], out=self.seen[:, :WIDTH])
        np.matmul(w["embed"], w["value"], out=self.seen[:, WIDTH:-1])
        self.keys, self.values = self.seen[:, :WIDTH], self.seen[:, WIDTH:-1]
        self.mask = w["near"].take(_SEEN) + _CAUSAL
        self.bias, self.group_prior = (np.concatenate([w[b]] * STEP) for b in ("bias", "group_prior"))
        self.within = w["prior"].reshape(GROUPS, MEMBERS)

    def attend(self, inputs: np.ndarray):
        """Rows of ``seen`` and queries of the windows, weights before their division, their sums, and what the targets read."""
        seen, query = self.seen.take(inputs, axis=0, mode="clip"), self.queries.take(inputs[:, STEP:], axis=0, mode="clip")
        weight = query @ seen[:, :, :WIDTH].transpose(0, 2, 1)
        weight += self.mask
        np.exp(weight, out=weight)
        pads = inputs == PAD
        some = np.flatnonzero(pads.any(axis=1))
        weight[some] *= ~pads[some, None]
        mass = weight.reshape(-1, SPAN) @ _ONES[:SPAN]
        if not _usual(mass):
            weight = self.read(inputs)[1][3]
            mass = _row_of_ones(len(mass))
        read = (weight @ seen[:, :, WIDTH:-1]).reshape(-1, WIDTH)
        read /= mass[:, None]
        return seen, query, weight, mass, read

    def layers(self, inputs: np.ndarray, read: np.ndarray):
        w = self.w
        own = w["embed"].take(inputs[:, STEP:].ravel(), axis=0, mode="clip")
        mid = read @ w["out"]
        mid += own
        hidden = mid @ w["up"]
        flat = hidden.reshape(-1, STEP * HIDDEN)
        flat += self.bias
        np.maximum(flat, 0, out=flat)
        top = hidden @ w["down"]
        top += mid
        outer = top @ w["groups"]
        flat = outer.reshape(-1, STEP * GROUPS)
        flat += self.group_prior
        return own, mid, hidden, top, outer

    def read(self, inputs: np.ndarray):
        """Last layer of the STEP targets of each window of SPAN inputs, with the layers below."""
        w, late = self.w, inputs[:, STEP:]
        key, value, query, own = self.keys[inputs], self.values[inputs], self.queries[late], w["embed"][late]
        raw = query @ key.transpose(0, 2, 1)
        raw += self.mask
        if (pads := inputs == PAD).any():
            raw += np.where(pads, np.float32(-1e9), np.float32(0))[:, None, :]
        weight = _softmax(raw)
        read = (weight @ value).reshape(-1, WIDTH)
        mid = own.reshape(-1, WIDTH) + read @ w["out"]
        hidden = np.maximum(mid @ w["up"] + w["bias"], 0)
        return mid + hidden @ w["down"], (key, value, query, weight, read, mid, hidden)

    def forward(self, inputs: np.ndarray) -> np.ndarray:
        """Natural log probabilities of all classes for the STEP targets of each window."""
        top, _ = self.read(inputs)
        outer = np.log(_softmax(top @ self.w["groups"] + self.w["group_prior"]))
        inner = np.log(_softmax((top[:, None, :] * self.w["turn"]) @ self.w["members"] + self.within))
        return (outer[:, :, None] + inner).reshape(-1, CLASSES)

    def log_probs(self, inputs: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log probabilities of the targets: ``forward`` with fewer passes over the numbers."""
        w, goals = self.w, targets.ravel()
        group, at = goals // MEMBERS, np.arange(len(goals))
        with np.errstate(over="ignore", invalid="ignore"):
            _, _, _, top, outer = self.layers(inputs, self.attend(inputs)[4])
            top *= w["turn"].take(group, axis=0, mode="clip")
            inner = top @ w["members"]
            inner += self.within.take(group, axis=0, mode="clip")
            told = outer.ravel().take(at * GROUPS + group) + inner.ravel().take(at * MEMBERS + (goals - group * MEMBERS))
            outer_total = np.exp(outer, out=outer) @ _ONES[:GROUPS]
            inner_total = np.exp(inner, out=inner) @ _ONES[:MEMBERS]
        if not (_usual(outer_total) and _usual(inner_total)):  # too large or small without a shift
            return self.forward(inputs)[at, goals]
        return told - np.log(outer_total) - np.log(inner_total)

    def gradient(self, inputs: np.ndarray, targets: np.ndarray, counted: np.ndarray) -> np.ndarray:
        w, goals, late = self.w, targets.ravel(), inputs[:, STEP:]
        n, group = len(goals), goals // MEMBERS
        share = counted.ravel() * np.float32(1 / max(1, counted.sum()))
        with np.errstate(over="ignore", invalid="ignore"):
            seen, query, weight, mass, read = self.attend(inputs)
        own, mid, hidden, top, outer = self.layers(inputs, read)
        outer = _shares_less(outer, group, share)
        turn = w["turn"].take(group, axis=0, mode="clip")
        turned = top * turn
        inner = turned @ w["members"]
        inner += self.within.take(group, axis=0, mode="clip")
        inner = _shares_less(inner, goals - group * MEMBERS, share)
        d_turned = inner @ w["members"].T
        mark, ones = _EYE.take(group, axis=0, mode="clip").T, _row_of_ones(n)
        g = {"groups": top.T @ outer, "group_prior": ones @ outer, "members": turned.T @ inner, "prior": mark @ inner}
        top *= d_turned
        g["turn"] = mark @ top
        d_turned *= turn
        d_top = outer @ w["groups"].T
        d_top += d_turned
        g["down"] = hidden.T @ d_top
        d_hidden = d_top @ w["down"].T
        d_hidden *= hidden > 0
        g["up"], g["bias"] = mid.T @ d_hidden, ones @ d_hidden
        d_mid = d_hidden @ w["up"].T
        d_mid += d_top
        g["out"] = read.T @ d_mid
        d_read, by_read, part = np.empty((n, WIDTH + 1), np.float32), d_mid @ w["out"].T, 1 / mass
        np.multiply(by_read, part[:, None], out=d_read[:, :WIDTH])
        by_read *= read
        np.multiply(by_read @ -_ONES[:WIDTH], part, out=d_read[:, WIDTH])  # of the weights' sum
        d_read = d_read.reshape(-1, STEP, WIDTH + 1)
        d_raw = d_read @ seen[:, :, WIDTH:].transpose(0, 2, 1)
        d_raw *= weight
        g["near"] = np.bincount(_SEEN.ravel(), (_row_of_ones(len(d_raw)) @ d_raw.reshape(len(d_raw), -1)), SPAN)
        d_query = (d_raw @ seen[:, :, :WIDTH]).reshape(-1, WIDTH)
        d_query *= np.float32(1 / math.sqrt(WIDTH))
        g["query"] = own.T @ d_query
        d_mid += d_query @ w["query"].T
        # Keys and values per class first: the sums of its places, then once through the weights.
        rows = np.empty((inputs.size + 1, 2 * WIDTH), np.float32)
        rows[-1] = 0
        of_all = rows[:-1].reshape(-1, SPAN, 2 * WIDTH)
        np.matmul(d_raw.transpose(0, 2, 1), query, out=of_all[:, :, :WIDTH])
        np.matmul(weight.transpose(0, 2, 1), d_read[:, :, :WIDTH], out=of_all[:, :, WIDTH:])
        of_all, of_late = _sums(inputs, rows), _sums(late, np.concatenate([d_mid, rows[-1:, :WIDTH]]))
        d_key, d_value = of_all[:, :WIDTH], of_all[:, WIDTH:]
        g["key"], g["value"] = w["embed"].T @ d_key, w["embed"].T @ d_value
        g["embed"] = of_late + d_key @ w["key"].T + d_value @ w["value"].T
        return np.concatenate([np.asarray(g[n], np.float32).ravel() for n in _SHAPES])


def train(flat: np.ndarray, windows: np.ndarray | Iterable[np.ndarray], seed: int, rate: float = RATE) -> np.ndarray:
    """Adam over windows (rows of SPAN + 1 classes, -1 past the end), shuffled inside each array.

    Every window once; fewer windows than LEAST_STEPS steps need are stepped
    through again. Only as many as that are held; the others are met once.
    """
    flat = flat.copy()
    model, rng = Model(flat), np.random.default_rng(seed)
    first, second, step = np.zeros_like(flat), np.zeros_like(flat), 0
    held, room = [], LEAST_STEPS * BATCH

    def passed(part: np.ndarray, most: float = math.inf) -> None:
        nonlocal step, first, second, flat
        order = rng.permutation(len(part))
        for start in range(0, len(part), BATCH):
            if step >= most:
                break
            rows = part[order[start : start + BATCH]].astype(np.int64)
            inputs, targets = np.maximum(rows[:, :SPAN], PAD), rows[:, STEP + 1 :]
            grad = model.gradient(inputs, np.maximum(targets, PAD), targets >= FIRST - 1)
            step += 1
            first *= 0.9
            first += 0.1 * grad
            grad *= grad
            grad *= 0.01
            second *= 0.99
            second += grad
            lift = math.sqrt(1 - 0.99**step) / (1 - 0.9**step)
            # The number of steps is not known before the end: the rate falls as 1 / step, to a tenth.
            scale = np.sqrt(second)
            scale += 1e-8
            np.divide(first, scale, out=scale)
            scale *= rate * max(0.1, 1 / (1 + 2 * step / LEAST_STEPS)) * lift
            flat -= scale
            model.tables()

    for part in [windows] if isinstance(windows, np.ndarray) else windows:
        if room > 0:
            held.append(part[:room])
            room -= len(held[-1])
        passed(part)
    few = np.concatenate(held) if held else np.zeros((0, SPAN + 1), np.int16)
    while len(few) and step < LEAST_STEPS:
        passed(few, LEAST_STEPS)
    return flat


class Vocabulary:
    """Subword -> class, and the log10 share of the subword in its class."""

    def __init__(self, counts: np.ndarray) -> None:
        """``counts``: training count of each subword id, 0 for those never seen."""
        order = np.argsort(-counts, kind="stable")
        own = CLASSES - FIRST - SHARED
        kind = np.empty(len(counts), np.int64)
        kind[order[:own]] = FIRST + np.arange(own)
        rest = order[own:]
        mass = np.cumsum(counts[rest] + 1.0)
        kind[rest] = FIRST + own + np.minimum((mass / mass[-1] * SHARED).astype(np.int64), SHARED - 1) if len(rest) else 0
        self.kind = kind.astype(np.uint8)
        total = np.bincount(kind, counts + 1.0, CLASSES)
        self.share = np.log10((counts + 1.0) / total[kind])

    def prior(self, counts: np.ndarray, ends: int) -> np.ndarray:
        mass = np.bincount(self.kind, counts + 1.0, CLASSES)
        mass[END] = ends + 1.0
        return np.log(np.maximum(mass, 1e-4) / mass.sum())


@lru_cache(maxsize=2)
def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Coded:
    """Subword ids of the words met so far, by the words' hashes: sorted arrays, emptied when they hold CACHED_WORDS."""

    def __init__(self, pieces) -> None:
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        self.hashes, self.starts, self.sizes, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def get(self, words: pa.Array, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words one after the other, and the number of each word's ids."""
        order = np.argsort(hashes)
        spots, new = self._missing(hashes[order])
        if len(new) and len(self.hashes) + len(new) > CACHED_WORDS:
            self.clear()
            spots, new = self._missing(hashes[order])
        if len(new):
            coded = self.pieces.encode(words.take(pa.array(order[new])).to_pylist(), num_threads=1)
            sizes = np.fromiter(map(len, coded), np.int32, len(coded))
            starts = len(self.ids) + np.cumsum(sizes) - sizes
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(coded), np.int32, int(sizes.sum()))])
            at = spots[new]
            self.hashes = np.insert(self.hashes, at, hashes[order[new]])
            self.starts, self.sizes = np.insert(self.starts, at, starts), np.insert(self.sizes, at, sizes)
        spots[order] = np.searchsorted(self.hashes, hashes[order])
        return self.ids[_ranges(self.starts[spots], sizes := self.sizes[spots])], sizes

    def _missing(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the sorted hashes stand or belong, and the places of those that are not there."""
        spots = np.searchsorted(self.hashes, hashes)
        there = np.append(self.hashes, np.uint64(0))[spots] == hashes
        there &= spots < len(self.hashes)
        there[1:] |= hashes[1:] == hashes[:-1]
        return spots, np.flatnonzero(~there)


@lru_cache(maxsize=1)
def _coded(path: str) -> Coded:
    """One store of words for all tasks of a worker process."""
    return Coded(_pieces(path))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def held_out(doc_id: Column | str = "doc_id") -> Column:
    name = F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit(""))
    return F.pmod(F.crc32(name.cast("binary")), F.lit(FOLDS)) == HELD_OUT


def _word_table(texts: list[bytes]):
    """Distinct lowered words with their hashes, the place of each word of the texts among them, each text's first word."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.binary()).cast(pa.string())))
    coded = lists.values.dictionary_encode()
    place, words = coded.indices.to_numpy(), coded.dictionary
    firsts = lists.offsets.to_numpy().astype(np.int64)
    if (none := pc.index(words, "").as_py()) >= 0:  # before leading and after trailing space
        solid = place != none
        firsts = np.concatenate([np.zeros(1, np.int64), np.cumsum(solid)])[firsts]
        place = place[solid]
        place = place - (place > none)
        words = pa.concat_arrays([words.slice(0, none), words.slice(none + 1)])
    edges = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[: edges[-1]] if len(words) else np.zeros(0, np.uint8)
    return words, H.spans(H.prefix_sums(data), edges[:-1], edges[1:]), place, firsts


def _count(batches):
    for _, texts in slices(batches, "text", 2 * SLICE_BYTES):
        words, hashes, place, _ = _word_table(texts)
        n = np.bincount(place, minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), words, pa.array(n)], ["hash", "word", "n"])


def word_counts(training: DataFrame) -> DataFrame:
    """hash, word, n: the count of every word of the training texts."""
    slice_counts = training.select("text").mapInArrow(_count, "hash long, word string, n long")
    return slice_counts.groupBy("hash", "word").agg(F.sum("n").alias("n"))


def _subword_rows(path: str | None):
    def run(batches):
        pieces = _pieces(path or model_path())
        for batch in batches:
            coded = pieces.encode(batch.column(0).to_pylist(), num_threads=1)
            lengths = np.array([len(c) for c in coded])
            ids = np.array([i for c in coded for i in c], np.int64)
            counts = np.repeat(batch.column(1).to_numpy(), lengths)
            distinct, place = np.unique(ids, return_inverse=True)
            sums = np.zeros(len(distinct), np.int64)
            np.add.at(sums, place, counts)
            yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(sums)], ["id", "n"])

    return run


def _lines(table, vocabulary: Vocabulary, coded: Coded):
    """Classes of all subwords of a word table, their number in each of its words, and the words' log10 shares in them."""
    words, hashes, place, _ = table
    ids, sizes = coded.get(words, hashes)
    ends = np.cumsum(sizes)
    sums = np.concatenate([np.zeros(1), np.cumsum(vocabulary.share[ids])])
    counts = sizes[place]
    kinds = vocabulary.kind[ids][_ranges((ends - sizes)[place], counts)]
    return kinds, counts, (sums[ends] - sums[ends - sizes])[place]


def _windows(texts: list[bytes], vocabulary: Vocabulary, pieces, coded: Coded | None = None) -> np.ndarray:
    """Windows STEP apart over each whole text, so that each class is a target once: SPAN + 1 classes, -1 past the end."""
    table = _word_table(texts)
    kinds, counts, _ = _lines(table, vocabulary, coded or Coded(pieces))
    cut = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])[table[3]]
    kinds = np.insert(kinds, cut[1:], END)
    lengths = np.diff(cut) + 1
    blocks = -(-lengths // STEP)
    room = STEP * (blocks + 1) + 1  # STEP pads, the start, the classes
    base = np.cumsum(room) - room
    line = np.full(room.sum(), -1, np.int16)
    line[(base[:, None] + np.arange(STEP)).ravel()] = PAD
    line[base + STEP] = START
    line[np.repeat(base + STEP + 1 - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(kinds))] = kinds
    begin = np.repeat(base - STEP * (np.cumsum(blocks) - blocks), blocks) + STEP * np.arange(blocks.sum())
    return sliding_window_view(line, SPAN + 1)[begin]


def _train_rows(flat: np.ndarray, vocabulary: Vocabulary, path: str | None, round_: int):
    def run(batches):
        keep_freed()
        coded, met = _coded(path or model_path()), 0

        def parts():
            nonlocal met
            for _, texts in slices(batches, "text"):
                windows = _windows(texts, vocabulary, coded.pieces, coded)
                met += len(windows)
                yield windows

        weights = train(flat, parts(), round_, RATE / (1 + round_))
        if met:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(weights))), pa.array(weights.astype(np.float64)), pa.array(np.full(len(weights), met))],
                ["at", "weight", "windows"],
            )

    return run


def fit(training: DataFrame, counts: DataFrame, documents: int, path: str | None = None) -> tuple[np.ndarray, Vocabulary]:
    """Weights and vocabulary. The driver gets sums per subword and per weight, whatever the input's size."""
    subwords = (
        counts.select("word", "n").mapInArrow(_subword_rows(path), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    )
    seen = np.zeros(_pieces(path or model_path()).get_piece_size())
    for r in subwords:
        seen[r.id] = r.n
    vocabulary = Vocabulary(seen)
    flat = Model.fresh(vocabulary.prior(seen, documents))
    for round_ in range(ROUNDS):
        tasks = training.select("text").mapInArrow(
            _train_rows(flat, vocabulary, path, round_), "at long, weight double, windows long"
        )
        means = tasks.groupBy("at").agg(
            # Rounded, so that the order of the sum does not show.
            F.round(F.sum(F.col("weight") * F.col("windows")) / F.sum("windows"), 6).alias("weight")
        ).collect()
        for r in means:
            flat[r.at] = r.weight
    return flat, vocabulary


def _score(
    flat: np.ndarray, vocabulary: Vocabulary, hot: tuple[np.ndarray, np.ndarray], documents: int, all_tokens: int, novel: float,
    path: str | None,
):
    """Per text: words, sums over hot words, and cold words with the model's share in each occurrence's log probability.

    The score counts a cold word as one that training lacks.
    """
    hot_hashes, hot_counts = hot

    def class_logs(model: Model, kinds: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Natural log probability of each class of the lines (which end with END)."""
        blocks = -(-lengths // STEP)
        room = STEP * (blocks + 1)
        base = np.cumsum(room) - room
        first = np.cumsum(lengths) - lengths
        spots = np.repeat(base + STEP - first, lengths) + np.arange(len(kinds))
        targets = np.zeros(room.sum() + 1, np.int64)
        targets[spots] = kinds
        inputs = np.zeros(room.sum() + 1, np.int64)
        inputs[spots + 1] = kinds
        inputs[base + room] = PAD  # the last class of a full line is no input
        inputs[base + STEP] = START
        first = np.repeat(base // STEP - (np.cumsum(blocks) - blocks), blocks) + np.arange(blocks.sum())
        spans, goals = sliding_window_view(inputs, SPAN)[::STEP], targets[:-1].reshape(-1, STEP)
        out = np.zeros(len(targets))
        logs = out[:-1].reshape(-1, STEP)
        for a in range(0, len(first), WINDOWS):
            at = first[a : a + WINDOWS]
            logs[at + 1] = model.log_probs(spans[at], goals[at + 1]).reshape(-1, STEP)
        return out[spots]

    def run(batches):
        keep_freed()
        model, coded = Model(flat), _coded(path or model_path())
        for batch, texts in slices(batches, "text"):
            table = _word_table(texts)
            _, distinct, place, firsts = table
            kinds, counts, shares = _lines(table, vocabulary, coded)
            reach = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
            cut = reach[firsts]
            text_ends = firsts[1:] + np.arange(len(texts))
            kinds = np.insert(kinds, cut[1:], END)
            logs_of = np.concatenate([np.zeros(1), np.cumsum(class_logs(model, kinds, np.diff(cut) + 1))])
            owner = np.repeat(np.arange(len(texts)), np.diff(firsts))
            by_model = np.empty(len(place) + len(texts))  # words and the texts' ends
            own_place = np.arange(len(place)) + owner
            by_model[own_place] = logs_of[reach[1:] + owner] - logs_of[reach[:-1] + owner] + shares * math.log(10)
            by_model[text_ends] = np.diff(logs_of)[cut[1:] + np.arange(len(texts))]
            near = np.minimum(np.searchsorted(hot_hashes, distinct), max(len(hot_hashes) - 1, 0))
            known = (hot_hashes[near] == distinct) if len(hot_hashes) else np.zeros(len(distinct), bool)
            hot_n = np.where(known, hot_counts[near], 0.0) if len(hot_hashes) else np.zeros(len(distinct))
            count_log = lambda seen: np.log(np.where(seen > 0, seen * ((1 - novel) / max(all_tokens, 1)), novel))
            by_count = np.full(len(by_model), float(count_log(np.float64(documents))))
            by_count[own_place] = count_log(hot_n)[place]
            mixed = np.logaddexp(math.log(ATTENTION) + by_model, math.log(1 - ATTENTION) + by_count) / math.log(10)
            tokens = np.concatenate([np.zeros(1), np.cumsum(mixed)])
            scores = np.diff(tokens[firsts + np.arange(len(firsts))])
            total = lambda v: np.diff(np.concatenate([np.zeros(1), np.cumsum(v)])[firsts])
            logs = np.log10(hot_n + 1.0)
            cold = np.flatnonzero(~known[place])
            key = owner[cold] * len(distinct) + place[cold]
            order = np.argsort(key, kind="stable")
            cold, key = cold[order], key[order]
            at = np.flatnonzero(np.diff(key, prepend=-1))
            offsets = np.searchsorted(owner[cold[at]], np.arange(len(texts) + 1)).astype(np.int32)
            cold_hash = pa.ListArray.from_arrays(pa.array(offsets), pa.array(distinct[place[cold[at]]].view(np.int64)))
            own = math.log(ATTENTION) + by_model[own_place[cold]]
            times = pa.ListArray.from_arrays(pa.array(np.append(at, len(cold)).astype(np.int32)), pa.array(own))
            cold_model = pa.ListArray.from_arrays(pa.array(offsets), times)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(np.diff(firsts) + 1),
                    pa.array(total(known[place].astype(np.float64)).astype(np.int64)), pa.array(total(logs[place])),
                    pa.array(scores), cold_hash, cold_model,
                ],
                ["doc_id", "held_out", "n_tokens", "n_hot", "hot_logs", "score", "cold", "cold_model"],
            )

    return run


def _hot_words(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of the most frequent words, HOT_WORDS at most.

    The number of words per step of the count's logarithm, a few hundred rows,
    says from which step on they are few enough.
    """
    step = F.floor(F.log2("n") * 16)
    left, lowest = HOT_WORDS, None
    for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("step")).collect():
        if r.words > left:
            break
        left, lowest = left - r.words, r.step
    rows = [] if lowest is None else counts.filter(step >= lowest).select("hash", "n").collect()
    top = sorted((r.hash & (1 << 64) - 1, r.n) for r in rows)
    return np.array([h for h, _ in top], np.uint64), np.array([n for _, n in top], np.float64)


def score(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words of the text, ASCII letters lowered, and one end. A null
    or empty text has the end alone; a null doc_id counts as the empty id.
    Repeated rows are learned and scored each. Without training documents all
    counts are 0 and the model is as it starts. An empty table gives no rows.
    """
    marked = docs.select("doc_id", held_out().alias("held_out"), C.whole_text().alias("text"))
    training = marked.filter("not held_out")
    counts = materialize(word_counts(training), "lm-words")
    documents = training.count()
    stats = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.count_if(F.col("n") == 1).alias("once")).first()
    all_tokens, kinds = stats.n + documents, stats.v + (documents > 0)
    hot = _hot_words(counts)
    flat, vocabulary = fit(training, counts, documents, path)
    novel = (stats.once + 1) / (all_tokens + 2)
    rows = materialize(
        marked.mapInArrow(
            _score(flat, vocabulary, hot, documents, all_tokens, novel, path),
            "doc_id long, held_out boolean, n_tokens long, n_hot long, hot_logs double, score double, "
            "cold array<long>, cold_model array<array<double>>",
        ).withColumn("row", F.monotonically_increasing_id()),
        "lm-rows",
    )
    cold = rows.select("row", F.explode(F.arrays_zip("cold", "cold_model")).alias("c")).select(
        "row", F.col("c.cold").alias("hash"), F.col("c.cold_model").alias("model")
    )
    by_count = F.log(F.col("n") * ((1 - ATTENTION) * (1 - novel) / max(all_tokens, 1)))
    as_novel = F.lit(math.log((1 - ATTENTION) * novel))

    def gain(own: Column) -> Column:
        """What the word's count adds to the log probability of an occurrence that was taken for a novel word's."""
        both = lambda other: F.greatest(own, other) + F.log1p(F.exp(-F.abs(other - own)))
        return both(by_count) - both(as_novel)

    times = F.size("model")
    looked_up = (
        cold.join(counts.select("hash", "n"), "hash")  # words that training lacks add log10(1) = 0, and no share
        .groupBy("row")
        .agg(
            F.sum(times).alias("n_cold"), F.sum(times * F.log10(F.col("n") + 1)).alias("cold_logs"),
            F.sum(F.aggregate("model", F.lit(0.0), lambda a, own: a + gain(own))).alias("gains"),
        )
    )
    end_known, end_log = int(documents > 0), math.log10(documents + 1)
    return rows.join(looked_up, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_hot") + F.coalesce("n_cold", F.lit(0)) + end_known).cast("long").alias("n_known"),
        F.lit(all_tokens).cast("long").alias("train_tokens"),
        (
            F.col("hot_logs") + F.coalesce("cold_logs", F.lit(0.0)) + end_log
            - F.col("n_tokens") * math.log10(all_tokens + kinds + 1)
        ).alias("base_score"),
        (F.col("score") + F.coalesce("gains", F.lit(0.0)) / math.log(10)).alias("score"),
    )


def op2_lm_scoring(spark, sf_dir):
    return score(C.table(spark, sf_dir, "documents"))
