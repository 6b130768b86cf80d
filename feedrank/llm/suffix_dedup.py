"""Suffix-array dedup by bucket-pointer refinement: cut every byte that a repeated string covers.

A text offset starts a suffix; two suffixes share a bucket as long as they are
not told apart. Offsets first fall into q-gram buckets: the bucket of an offset
is the least q-gram hash in its string of LENGTH bytes, so equal strings share a
bucket, and neighbouring offsets share it too and travel as one run. A bucket
with one run is done: nothing else starts there. The others are refined by the
identifiers of their runs, then blocks of offsets whose common bytes occur twice
by those of the blocks, then single offsets by their own.
An identifier of 2d bytes is made from those of d bytes at an offset and d
later, from 25 up to 200 bytes, and reused for the next; an identifier that
occurs once is done at every step. Rows are runs, blocks or offsets that are
still open, never pairs; identical runs send one row on.

Identifiers are 64-bit fingerprints of the bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import common as C
from . import hashing as H
from .arrow import list_array, parts, slices

LENGTH = 200
GRAM = 32
BLOCK = 16
#: Rows that a task works on at once.
ROWS = 1024
_BASE = 25  # doubled to LENGTH
_DOCUMENT = ["doc", "check"]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, from running minima within blocks, forward and backward."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    grid = padded.reshape(-1, width)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def runs(data: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(bucket, run identifier, start, offsets, periodic) of a text's runs.

    ``periodic`` marks runs in which the least q-gram stands twice, so that
    offsets of one run may start equal strings.
    """
    width = length - gram + 1
    sums = H.prefix_sums(data)
    grams = H.windows(sums, gram)
    least = sliding_min(grams, width)
    start = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    count = np.diff(np.append(start, len(least)))
    bucket = least[start]
    run = H.mix(H.spans(sums, start, start + count - 1 + length) + count.astype(np.uint64))
    # Places that are least for some window; equal ones that a window holds are neighbours among them.
    top = ~sliding_min(~np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)]), width)
    places = np.flatnonzero(grams == top)
    twice = np.flatnonzero((grams[places[1:]] == grams[places[:-1]]) & (np.diff(places) <= width))
    periodic = np.zeros(len(start), bool)
    for k in twice.tolist():
        a, b = places[k], places[k + 1]
        near = slice(np.searchsorted(start, a - width, "left"), np.searchsorted(start, b, "right"))
        periodic[near] |= bucket[near] == grams[a]
    return bucket, run, start, count, periodic


def _key(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _runs(batches):
    for batch, texts in slices(batches, "text"):
        found: list[list] = [[] for _ in range(6)]
        for i, text in enumerate(texts):
            if len(text) >= LENGTH:
                bucket, run, start, count, periodic = runs(np.frombuffer(text, np.uint8))
                for part, values in zip(found, (np.full(len(start), i), bucket.view(np.int64), run.view(np.int64), start.astype(np.int64), count.astype(np.int64), periodic)):
                    part.append(values)
        if found[0]:
            rows, *values = (np.concatenate(p) for p in found)
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [_key(batch, "doc").take(at), _key(batch, "check").take(at), *map(pa.array, values)],
                ["doc", "check", "bucket", "run", "start", "count", "flat"],
            )


def identifiers(data: np.ndarray) -> dict[int, np.ndarray]:
    """Identifiers of all strings of 25, 50, 100 and 200 bytes; each depth is made from the one before."""
    depth = _BASE
    out = {depth: H.windows(H.prefix_sums(data), depth)}
    while depth < LENGTH:
        ids = out[depth]
        out[2 * depth] = H.mix(ids[:-depth] * H._WEIGHTS[0] + ids[depth:] * H._WEIGHTS[1])
        depth *= 2
    return out


def _cut_runs(batches):
    """The bytes of open runs, and where the bucket's q-gram stands in them."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for batch in parts(batches, ROWS):
        names = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        rows, spans = [], []
        for doc, check, packed, open_runs in zip(names["doc"], names["check"], names["packed"], names["runs"]):
            text = unpack.decompress(packed)
            for r in open_runs:
                rows.append({"doc": doc, "check": check, **r})
                spans.append(text[r["start"] : r["start"] + r["count"] - 1 + LENGTH])
        if rows:
            table = pa.RecordBatch.from_pylist(rows, schema=_RUN)
            sizes = np.fromiter(map(len, spans), np.int64, len(spans))
            base = np.cumsum(sizes) - sizes
            grams = H.windows(H.prefix_sums(np.frombuffer(b"".join(spans), np.uint8)), GRAM).view(np.int64)
            hits = np.flatnonzero(grams == np.repeat(table.column("bucket").to_numpy(), sizes)[: len(grams)])
            place = hits[np.searchsorted(hits, base)] - base
            yield pa.RecordBatch.from_arrays(
                [*table.columns, pa.array(place), pa.array(spans, pa.binary())], [*table.schema.names, "place", "bytes"]
            )


_RUN = pa.schema(
    [(n, pa.int64()) for n in ("doc", "check", "bucket", "start", "count")] + [("flat", pa.bool_())]
)


def _buffer(spans: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All spans in one array of bytes, and where each begins."""
    own = spans.to_pylist()
    sizes = np.fromiter(map(len, own), np.int64, len(own))
    return np.frombuffer(b"".join(own), np.uint8), np.cumsum(sizes) - sizes


def _block_rows(batches):
    """Blocks of BLOCK offsets, counted back from the q-gram's place.

    A block's core is the bytes that all strings from its offsets share; its
    identifier covers all their bytes.
    """
    for batch in parts(batches, ROWS):
        row, count, place, _, bucket = (batch.column(i) for i in range(5))
        row, count, place = row.to_numpy(), count.to_numpy(), place.to_numpy()
        bucket = bucket.to_numpy().view(np.uint64)
        data, base = _buffer(batch.column(3))
        ids = identifiers(data)
        owner = np.repeat(np.arange(len(row)), count)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        back = (place[owner] - offset) // BLOCK
        first = np.flatnonzero(np.concatenate([[True], (back[1:] != back[:-1]) | (owner[1:] != owner[:-1])]))
        number = np.diff(np.append(first, len(owner)))
        owner, back, start = owner[first], back[first], offset[first]
        side = H.mix(bucket[owner] + back.astype(np.uint64) * H._WEIGHTS[2])
        core = base[owner] + place[owner] - BLOCK * back
        half, later = ids[LENGTH // 2], LENGTH // 2 - BLOCK + 1
        core = H.mix(half[core] * H._WEIGHTS[3] + half[core + later] * H._WEIGHTS[4] + side)
        at, whole = base[owner] + start, ids[LENGTH]
        cover = H.mix(whole[at] * H._WEIGHTS[3] + whole[at + number - 1] * H._WEIGHTS[4] + number.astype(np.uint64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(core.view(np.int64)), pa.array(cover.view(np.int64)), pa.array(row[owner]), pa.array(start), pa.array(number)],
            ["bucket", "run", "row", "start", "count"],
        )


def _offset_rows(batches):
    """Single offsets of the blocks that are open still."""
    for batch in parts(batches, ROWS):
        data, base = _buffer(batch.column(1))
        whole = identifiers(data)[LENGTH]
        rows, offsets, at = [], [], []
        for k, pieces in enumerate(batch.column(2).to_pylist()):
            for p in pieces:
                own = np.arange(p["start"], p["start"] + p["count"])
                offsets.append(own)
                at.append(own + base[k])
                rows.append(k)
        if rows:
            sizes = [len(o) for o in offsets]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(whole[np.concatenate(at)].view(np.int64)),
                    pa.array(np.repeat(batch.column(0).to_numpy()[rows], sizes)),
                    pa.array(np.concatenate(offsets)),
                ],
                ["id", "row", "start"],
            )


def _pack(batches):
    import zstandard

    pack = zstandard.ZstdCompressor(level=1)
    for batch, texts in slices(batches, "text"):
        yield pa.RecordBatch.from_arrays(
            [_key(batch, "doc_id"), _key(batch, "doc"), _key(batch, "check"), pa.array([pack.compress(t) for t in texts], pa.binary())],
            ["doc_id", "doc", "check", "packed"],
        )


def _cut(batches):
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for batch in parts(batches, ROWS):
        names = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        start = 0
        kept, firsts, ends, sizes, held = [], [], [], [], 0
        for i, (packed, found) in enumerate(zip(names["packed"], names["found"])):
            text = unpack.decompress(packed)
            sizes.append(len(text))
            spans = np.array([(s["start"], s["end"]) for s in found or ()], np.int64).reshape(-1, 2)
            spans = spans[np.argsort(spans[:, 0], kind="stable")]
            reach = np.maximum.accumulate(spans[:, 1]) if len(spans) else spans[:, 1]
            new = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > reach[:-1]])) if len(spans) else np.zeros(0, np.int64)
            a = spans[new, 0]
            b = reach[np.append(new[1:], len(spans)) - 1] if len(spans) else a
            cuts = [0, *np.stack([a, b], axis=1).ravel().tolist(), len(text)]
            kept.append(b"".join(text[x:y] for x, y in zip(cuts[::2], cuts[1::2])))
            firsts.append(a)
            ends.append(b)
            held += len(text)
            if held > 16 << 20 or i == len(batch) - 1:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names["doc_id"][start : i + 1], pa.int64()),
                        pa.array(sizes, pa.int64()),
                        list_array(firsts, pa.int64()),
                        list_array(ends, pa.int64()),
                        pa.array(kept, pa.binary()),
                    ],
                    ["doc_id", "n_bytes", "removed_from", "removed_to", "kept"],
                )
                start, kept, firsts, ends, sizes, held = i + 1, [], [], [], [], 0


def refine(found: DataFrame, place: list[str], label: str) -> tuple[DataFrame, DataFrame]:
    """Refine buckets by the identifiers of their runs.

    ``found`` has bucket, run, start, count, flat and the columns ``place`` that
    say where a run stands. A bucket of one run is done. Runs that occur twice
    or more are returned first: all their offsets start repeated strings. Second
    come the runs that are open still, where the bucket has some: those that
    occur once, and the first of each that repeats, since open runs may share
    offsets with it. Flat buckets may hide repeats inside one run and stay open.
    """
    spot = [*place, "start", "count"]
    buckets = (
        found.groupBy("bucket")
        .agg(
            F.count(F.lit(1)).alias("n"), F.min("run").alias("least"), F.max("run").alias("most"),
            F.max("flat").alias("_flat"),
        )
        .filter("n > 1 or _flat")
    )
    shared = materialize(found.drop("flat").join(buckets, "bucket").withColumnRenamed("_flat", "flat"), f"{label}-shared")
    mixed = shared.filter("least != most or flat")
    same = mixed.groupBy("bucket", "run").agg(F.count(F.lit(1)).alias("same"), F.min(F.struct(*spot)).alias("first"))
    told = mixed.join(same, ["bucket", "run"])
    done = shared.filter("least = most and not flat").select(*spot).unionByName(told.filter("same > 1").select(*spot))
    left = told.filter((F.col("same") == 1) | (F.col("first") == F.struct(*spot)))
    return done, left.select("bucket", "flat", *spot).distinct()


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, removed_from, removed_to, kept.

    ``removed_from`` and ``removed_to`` are the borders of the maximal removed
    runs of bytes, ``kept`` the bytes that remain. A null text is empty. Rows
    that repeat a doc_id and its text count as two texts, so each removes the
    other's bytes. An empty table gives no rows.
    """
    text = C.whole_text()
    check = F.xxhash64(text)
    named = docs.select(
        "doc_id", F.coalesce("doc_id", check).alias("doc"), check.alias("check"), text.alias("text")
    )
    found = materialize(
        named.mapInArrow(_runs, "doc long, check long, bucket long, run long, start long, count long, flat boolean"),
        "suffix-runs",
    )
    done, left = refine(found, _DOCUMENT, "suffix-runs")
    packed = named.mapInArrow(_pack, "doc_id long, doc long, check long, packed binary")
    asked = left.groupBy(*_DOCUMENT).agg(  # the runs of one text
        F.collect_list(F.struct("bucket", "start", "count", "flat")).alias("runs")
    )
    open_runs = materialize(
        packed.join(asked, _DOCUMENT)
        .select(*_DOCUMENT, "packed", "runs")
        .mapInArrow(
            _cut_runs, "doc long, check long, bucket long, start long, count long, flat boolean, place long, bytes binary"
        )
        .withColumn("row", F.monotonically_increasing_id()),
        "suffix-open",
    )
    blocks = materialize(
        open_runs.filter("not flat").select("row", "count", "place", "bytes", "bucket").mapInArrow(
            _block_rows, "bucket long, run long, row long, start long, count long"
        ),
        "suffix-blocks",
    )
    done_blocks, open_blocks = refine(blocks.withColumn("flat", F.lit(False)), ["row"], "suffix-blocks")
    pieces = open_blocks.select("row", "start", "count").unionByName(
        open_runs.filter("flat").select("row", F.lit(0).cast("long").alias("start"), "count")
    )
    offsets = materialize(
        open_runs.select("row", "bytes")
        .join(pieces.groupBy("row").agg(F.collect_list(F.struct("start", "count")).alias("pieces")), "row")
        .mapInArrow(_offset_rows, "id long, row long, start long"),
        "suffix-offsets",
    )
    twice = offsets.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id")
    spots = offsets.join(twice, "id").select("row", "start", F.lit(1).cast("long").alias("count"))
    at = open_runs.select("row", *_DOCUMENT, F.col("start").alias("base"))
    refined = done_blocks.unionByName(spots).join(at, "row").select(
        *_DOCUMENT, (F.col("base") + F.col("start")).alias("start"), "count"
    )
    end = (F.col("start") + F.col("count") - 1 + LENGTH).alias("end")
    intervals = done.unionByName(refined).groupBy(*_DOCUMENT).agg(
        F.collect_list(F.struct("start", end)).alias("found")  # of one text
    )
    return packed.join(intervals, _DOCUMENT, "left").select("doc_id", "packed", "found").mapInArrow(
        _cut, "doc_id long, n_bytes long, removed_from array<long>, removed_to array<long>, kept binary"
    )


def digests(cut: DataFrame) -> DataFrame:
    return cut.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("removed_from").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op8_suffix_dedup(spark, sf_dir):
    return digests(remove_repeats(C.table(spark, sf_dir, "documents")))
