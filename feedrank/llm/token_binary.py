"""Token ids in word-aligned binary files (Simple-8b).

A 64-bit word holds a selector in its 4 high bits and, in the other 60, as many
ids of equal width as the selector says. Selector 0 is an escape: the word's low
bits hold the number (always 1) of raw 64-bit words that follow, for an id of
more than 60 bits. Ids are coded in blocks of BLOCK ids; the file holds each
block's first word, so any block can be decoded by itself, and all words of a
file are decoded together: they are sorted out by selector, and each kind is
unpacked by one shift and mask for each of its places.

File: the header (magic, documents, ids, blocks, words; little-endian 64-bit),
doc ids (0 where null, with a byte for each that says so), documents' lengths,
blocks' first words (and the number of all words), the words.
"""

from __future__ import annotations

import os
import re
import uuid
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, scratch_path
from . import common as C
from . import hashing as H
from .arrow import Cache, slices

MODEL = "word_bpe_49k.json"
END_ID = 2
BLOCK = 256
FILE_IDS = 1 << 21
MAGIC = 0x4C42_3853_4E4B_4F54
CACHED_CHUNKS = 300_000
#: Fixed values of the format: selector -> (ids in a word, bits of an id).
SELECTORS = (
    (1, 64), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7),
    (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60),
)


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the first word of each block (and the end).

    For every id the densest selector that could start there is found first;
    then all blocks step from word to word together.
    """
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    grid = np.zeros((blocks, BLOCK + 60), np.uint64)  # a block's last word may hold zeros past its end
    padded = np.zeros(blocks * BLOCK, np.uint64)
    padded[:n] = values
    grid[:, :BLOCK] = padded.reshape(blocks, BLOCK)
    best = np.zeros((blocks, BLOCK), np.uint8)
    wide = np.zeros((blocks, BLOCK + 61), np.int16)
    top = int(values.max())
    narrow = grid.astype(np.uint16) if top < 1 << 16 else grid
    for selector in range(len(SELECTORS) - 1, 0, -1):
        count, bits = SELECTORS[selector]
        if top >> bits == 0:
            best[:] = selector
            continue
        np.cumsum(narrow >= 1 << bits, axis=1, dtype=np.int16, out=wide[:, 1:])
        np.copyto(best, selector, where=wide[:, count : count + BLOCK] == wide[:, :BLOCK])
    length = np.full(blocks, BLOCK)
    length[-1] = n - BLOCK * (blocks - 1)
    jump = np.array([c for c, _ in SELECTORS])
    owner, place = [], []
    live, at = np.arange(blocks), np.zeros(blocks, np.int64)
    while len(live):
        owner.append(live)
        place.append(at)
        at = at + jump[best[live, at]]
        more = at < length[live]
        live, at = live[more], at[more]
    owner_all, place_all = np.concatenate(owner), np.concatenate(place)
    sort = np.argsort(owner_all * BLOCK + place_all)
    owner_all, place_all = owner_all[sort], place_all[sort]
    chosen = best[owner_all, place_all]
    words = np.zeros(len(chosen), np.uint64)
    flat, spot = grid.ravel(), owner_all * grid.shape[1] + place_all
    for selector, (count, bits) in enumerate(SELECTORS[1:], 1):
        own = np.flatnonzero(chosen == selector)
        word = np.full(len(own), selector << 60, np.uint64)
        for k in range(count):
            word |= flat[spot[own] + k] << np.uint64(k * bits)
        words[own] = word
    escaped = np.flatnonzero(chosen == 0)
    words[escaped] = 1
    words = np.insert(words, escaped + 1, flat[spot[escaped]])  # the raw word follows
    firsts = np.zeros(blocks + 1, np.int64)
    sizes = np.bincount(owner_all, minlength=blocks) + np.bincount(owner_all[escaped], minlength=blocks)
    np.cumsum(sizes, out=firsts[1:])
    return words, firsts


def unpack(words: np.ndarray, firsts: np.ndarray, n: int) -> np.ndarray:
    """The ids of whole blocks; ``n`` is the number of all ids."""
    if not n:
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    if (selector == 0).any() or (selector == 15).any():
        raw = _raw_words(selector)
    counts = np.array([c for c, _ in SELECTORS] + [0])[selector]
    counts[raw] = 1
    counts[(selector == 0) & ~raw] = 0  # the escape itself
    # A block's last word may claim places past its end.
    blocks = len(firsts) - 1
    block_of = np.repeat(np.arange(blocks), np.diff(firsts))
    before = np.cumsum(counts) - counts
    start = before - before[firsts[:-1]][block_of] + BLOCK * block_of
    out = np.zeros(BLOCK * blocks + 64, np.uint64)
    for kind, (count, bits) in enumerate(SELECTORS[1:], 1):
        own = np.flatnonzero((selector == kind) & ~raw)
        if not len(own):
            continue
        mask = np.uint64((1 << bits) - 1)
        limit = np.minimum(BLOCK * (block_of[own] + 1), n)
        for place in range(count):
            spots = start[own] + place
            inside = spots < limit
            out[spots[inside]] = words[own[inside]] >> np.uint64(place * bits) & mask
    out[start[raw]] = words[raw]
    return out[:n]


def _raw_words(selector: np.ndarray) -> np.ndarray:
    """Words that follow an escape; a raw word may look like an escape itself."""
    raw = np.zeros(len(selector), bool)
    suspects = np.flatnonzero(selector == 0).tolist()
    for i in suspects:
        if not raw[i]:
            raw[i + 1] = True
    return raw


def file_bytes(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    words, firsts = pack(ids)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    named = np.array([d or 0 for d in doc_ids], np.int64)
    head = np.array([MAGIC, len(doc_ids), len(ids), len(firsts) - 1, len(words)], np.uint64)
    return b"".join(
        [head.tobytes(), named.tobytes(), known.tobytes(), lengths.astype(np.int64).tobytes(),
         firsts.tobytes(), words.tobytes()]
    )


def read_file(content: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Doc ids, lengths and all ids of a file."""
    magic, docs, n, blocks, words = (int(x) for x in np.frombuffer(content, np.uint64, 5))
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = 40

    def take(count: int, kind) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(content, kind, count, at)
        at += out.nbytes
        return out

    named, known, lengths = take(docs, np.int64), take(docs, np.uint8), take(docs, np.int64)
    firsts = take(blocks + 1, np.int64)
    coded = np.frombuffer(content[at : at + 8 * words], np.uint64)
    return [d if k else None for d, k in zip(named.tolist(), known)], lengths, unpack(coded, firsts, n)


#: Words whose lower case is plain, and that the tokenizer keeps in one piece.
_PLAIN = re.compile(r"[a-z\u00DF-\u00F6\u00F8-\u00FF]+").fullmatch


def _printable_bytes() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 signs stand for themselves, other bytes for the signs from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or (161 <= b <= 255 and b != 173)]
    rest = [b for b in range(256) if b not in set(own)]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class WordEncoder:
    """Ids of texts by the tokenizers library, kept for the chunks between white space seen lately.

    No part of the tokenizer looks across ASCII white space: its pattern drops
    it, normal forms do not compose over it, and no special token holds any. To
    meet the same chunk more often, ASCII letters are lowered and a stop or
    comma after a letter or digit is set apart first, where that is safe.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.alphabet = _printable_bytes()
        self.cache = Cache(None, CACHED_CHUNKS)

    def _make(self, chunks: list[bytes]) -> list[bytes]:
        texts = [c.decode() for c in chunks]
        alphabet, tokenize = self.alphabet, self.model.tokenize
        coded: list = [
            [t.id for t in tokenize(c.decode() if t.isascii() else "".join([alphabet[b] for b in c]))] if _PLAIN(t) else None
            for c, t in zip(chunks, texts)
        ]
        others = [i for i, ids in enumerate(coded) if ids is None]
        for i, e in zip(others, self.tokenizer.encode_batch_fast([texts[i] for i in others], add_special_tokens=False)):
            coded[i] = e.ids
        blob, at, made = np.fromiter(chain.from_iterable(coded), np.uint32).tobytes(), 0, []
        for ids in coded:
            end = at + 4 * len(ids)
            made.append(blob[at:end])
            at = end
        return made

    def _joined(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of texts that may be lowered: their chunks are found, hashed and looked up together."""
        if not texts:
            return []
        low = b" ".join([b"", *texts, b""]).lower()
        data = np.frombuffer(low, np.uint8)
        solid = (data != 32) & ((data < 9) | (data > 13))
        before, lead = data[1:-1], data[:-2]
        letter = ((before >= 97) & (before <= 122)) | ((before >= 48) & (before <= 57))
        letter |= (lead == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)
        stop = np.zeros(len(data), bool)
        stop[2:] = letter & ((data[2:] == 44) | (data[2:] == 46))
        stop[:-1] &= ~solid[1:]
        starts = np.flatnonzero(solid[1:] & (~solid[:-1] | stop[1:])) + 1
        ends = np.flatnonzero(solid[:-1] & (~solid[1:] | stop[1:])) + 1
        hashes = H.spans(H.prefix_sums(data), starts, ends)
        distinct, at, place = np.unique(hashes, return_index=True, return_inverse=True)
        spot = dict(zip(distinct.tolist(), at.tolist()))
        values = self.cache.get(
            distinct.tolist(), lambda new: self._make([low[starts[k] : ends[k]] for k in map(spot.__getitem__, new)])
        )
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        blob, firsts = np.frombuffer(b"".join(values), np.uint32), np.cumsum(sizes) - sizes
        counts = sizes[place]
        reach = np.cumsum(counts)
        ids = blob[np.arange(reach[-1] if len(reach) else 0) + np.repeat(firsts[place] - (reach - counts), counts)]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        chunk = np.searchsorted(starts, np.concatenate([np.ones(1, np.int64), 1 + np.cumsum(lengths)]))
        cut = np.concatenate([np.zeros(1, np.int64), reach])[chunk]
        return [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Chunks are named by 64-bit hashes of their bytes."""
        # A special token's letters have a case; marks may compose with capitals. Such texts go to the library.
        safe = [not (b"<|" in t or b"\xcc" in t or b"\xcd" in t) for t in texts]
        plain = iter(self._joined([t for t, ok in zip(texts, safe) if ok]))
        others = [t.decode() for t, ok in zip(texts, safe) if not ok]
        whole = iter(self.tokenizer.encode_batch_fast(others, add_special_tokens=False))
        return [next(plain) if ok else np.array(next(whole).ids, np.uint32) for ok in safe]


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode the texts and write them as token files in ascending doc_id order (null ids first).

    Returns the manifest, one row per file: file, part, seq, n_docs, n_ids. A
    task that runs again writes files of other names; the manifest, itself a
    written table, names those of the task that counted.
    """

    def run(batches):
        import pyarrow.fs as pafs
        from pyspark import TaskContext

        own = encoder(path or model_path())
        target, base = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
        target.create_dir(base, recursive=True)
        part, seq = TaskContext.get().partitionId(), 0
        end = np.array([end_id], np.uint32)
        names: list = []
        held: list[np.ndarray] = []
        size = 0

        def flush():
            nonlocal seq, names, held, size
            lengths = np.array([len(x) + 1 for x in held], np.int64)
            ids = np.concatenate([x for own in held for x in (own, end)])
            name = f"tokens-{part:06d}-{seq:05d}-{uuid.uuid4().hex}.s8b"
            with target.open_output_stream(f"{base}/{name}") as out:
                out.write(file_bytes(names, lengths, ids))
            row = pa.RecordBatch.from_pylist(
                [{"file": name, "part": part, "seq": seq, "n_docs": len(names), "n_ids": len(ids)}], schema=MANIFEST
            )
            seq, names, held, size = seq + 1, [], [], 0
            return row

        for batch, texts in slices(batches, "text"):
            for doc_id, coded in zip(batch.column(0).to_pylist(), own.encode(texts)):
                names.append(doc_id)
                held.append(coded)
                size += len(coded) + 1
                if size >= FILE_IDS:
                    yield flush()
        if names:
            yield flush()

    ordered = (
        docs.select("doc_id", "text")
        .repartitionByRange(F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.crc32(C.whole_text().cast("binary")))
    )
    made = ordered.mapInArrow(run, "file string, part long, seq long, n_docs long, n_ids long")
    return materialize(made, "token-manifest")


MANIFEST = pa.schema(
    [("file", pa.string()), ("part", pa.int64()), ("seq", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]
)


def read_files(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document in the files: doc_id, start, n_tokens, ids_crc32, ids (array of long).

    ``start`` counts the ids of all documents before it. The files' totals, one
    row per file, are summed up in file order.
    """
    spark = manifest.sparkSession
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("file_start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))
    if not manifest.take(1):
        return spark.createDataFrame([], READ)
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").load(folder)
    files = content.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").join(
        F.broadcast(placed.select("file", "file_start")), "file"  # a row per file of FILE_IDS ids and more
    )

    def run(batches):
        import zlib

        for batch in batches:
            for file_start, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc_ids, lengths, ids = read_file(content.as_py())
                ends = np.cumsum(lengths)
                small = ids.astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, pa.int64()),
                        pa.array(file_start + ends - lengths, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array([zlib.crc32(small[e - k : e]) for e, k in zip(ends.tolist(), lengths.tolist())], pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return files.select("file_start", "content").mapInArrow(run, READ)


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def round_trip(docs: DataFrame, folder: str | None = None, path: str | None = None) -> DataFrame:
    """Write the documents' ids as files and read them back, a row per document.

    A null or empty text has the end id alone. Repeated rows are documents of
    their own; rows of one doc_id stand in the order of their texts' crc. An
    empty table writes no file and gives no rows. Other columns are not read.
    """
    folder = folder or scratch_path(docs.sparkSession, "tokens")
    return read_files(write_files(docs, folder, path), folder)


def op6_token_binary(spark, sf_dir):
    return round_trip(C.table(spark, sf_dir, "documents"))
