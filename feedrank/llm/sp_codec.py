"""SentencePiece encoding and decoding with byte offsets.

A text is normalised by the longest-prefix rule over the model's compiled
character map; every byte of the normalised text remembers the source byte it
came from. The normalised text is cut where no piece of the vocabulary can
cross, the library segments the cut chunks (a chunk seen lately is not
segmented again), and every piece is projected back to a span of source bytes.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .arrow import Cache, give_back, list_array, slices

MODEL = "piece_bpe_32k.model"
META = "▁"
CACHED_CHUNKS = 150_000
_CUT = b"\x00"


def character_map(blob: bytes) -> dict[str, str]:
    """All (source, replacement) pairs of a compiled character map.

    The map is a double-array trie over UTF-8 bytes whose leaves point into a
    block of zero-ended replacements.
    """
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units = np.frombuffer(blob[4 : 4 + size], np.uint32)
    texts = blob[4 + size :]
    pairs: dict[str, str] = {}

    def base(at: int) -> int:
        unit = int(units[at])
        return at ^ ((unit >> 10) << ((unit & 512) >> 6))

    stack = [(0, b"")]
    labels = np.arange(1, 256)
    while stack:
        at, path = stack.pop()
        first = base(at)
        if path and int(units[at]) >> 8 & 1:
            start = int(units[first]) & 0x7FFFFFFF
            pairs[path.decode()] = texts[start : texts.index(b"\0", start)].decode()
        spots = first ^ labels
        spots, names = spots[spots < len(units)], labels[spots < len(units)]
        for label in names[(units[spots] & 0x800000FF) == names].tolist():
            stack.append((first ^ label, path + bytes([label])))
    return pairs


class Normalizer:
    """Longest-prefix normalisation that records where each byte came from."""

    def __init__(self, blob: bytes, dummy_prefix: bool, trim: bool) -> None:
        self.pairs = character_map(blob)
        self.dummy, self.trim = dummy_prefix, trim
        self.longest: dict[str, int] = {}
        for source in self.pairs:
            self.longest[source[0]] = max(len(source), self.longest.get(source[0], 0))

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them and for the end the source byte."""
        if not text:
            return b"", np.zeros(1, np.int32)
        if self.trim or (self.longest and not self.longest.keys().isdisjoint(text.decode())):
            return self._slow(text.decode())
        prefix = META.encode() if self.dummy else b""
        source = np.frombuffer(text, np.uint8)
        at = np.repeat(np.arange(len(text), dtype=np.int32), np.where(source == 32, 3, 1))
        align = np.concatenate([np.zeros(len(prefix), np.int32), at, np.array([len(text)], np.int32)])
        return prefix + text.replace(b" ", META.encode()), align

    def _slow(self, text: str) -> tuple[bytes, np.ndarray]:
        parts: list[tuple[str, int, int]] = []  # normalised, source start, source end in bytes
        i = at = 0
        while i < len(text):
            for n in range(min(self.longest.get(text[i], 0), len(text) - i), 0, -1):
                if (source := text[i : i + n]) in self.pairs:
                    new = self.pairs[source]
                    break
            else:
                source = new = text[i]
            end = at + len(source.encode())
            parts.append((new, at, end))
            i, at = i + len(source), end
        if self.trim:
            # Spaces at the start go, runs of spaces become one, then those at the end go.
            kept, space = [], True
            for new, start, end in parts:
                if space:
                    new = new.lstrip(" ")
                if new:
                    kept.append((new, start, end))
                    space = new.endswith(" ")
            ends = (" ", META)  # at the end a literal mark counts as a space
            while kept and kept[-1][0].endswith(ends):
                new, start, end = kept.pop()
                if stripped := new.rstrip("".join(ends)):
                    kept.append((stripped, start, end))
            parts = kept
        if not parts:
            return b"", np.zeros(1, np.int32)
        out = [META.encode()] if self.dummy else []
        align = [parts[0][1]] * (3 if self.dummy else 0)
        for new, start, _ in parts:
            coded = new.replace(" ", META).encode()
            out.append(coded)
            align += [start] * len(coded)
        return b"".join(out), np.array([*align, parts[-1][2]], np.int32)


class Codec:
    """Encodes to ids and source byte spans, and decodes."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        spec = model.normalizer_spec
        if not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models that do not escape white space, or carry it as a suffix, are not supported")
        self.dummy = spec.add_dummy_prefix
        self.normalize = Normalizer(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces)
        # The same pieces without a normaliser segment text that is normalised already.
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces = b"", False, False
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        kinds = pb.ModelProto.SentencePiece
        names = [p.piece for p in model.pieces]
        self.bytes = [bytes([int(p.piece[3:-1], 16)]) if p.type == kinds.BYTE else p.piece.encode() for p in model.pieces]
        self.plain = all(p.type not in (kinds.USER_DEFINED,) for p in model.pieces)
        self.unknown_ids = np.array([p.type in (kinds.UNKNOWN, kinds.CONTROL) for p in model.pieces])
        self.lengths = np.array([len(b) for b in self.bytes], np.int32)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(self.bytes), np.uint8)
        # No piece crosses from a non-space to a space, so texts may be cut there; the same for line ends.
        self.cut_spaces = self.plain and not any(META in n.lstrip(META) for n in names)
        self.cut_lines = self.plain and not any("\n" in n for n in names)
        self.cache = Cache(self._segment, CACHED_CHUNKS)

    def _segment(self, chunks: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Ids and byte lengths of the pieces of each chunk, as int32 bytes."""
        coded = self.pieces.encode([c.decode() for c in chunks], num_threads=1)
        flat = np.fromiter(chain.from_iterable(coded), np.int32)
        sizes = self.lengths[flat]
        ids_blob, sizes_blob, made, at = flat.tobytes(), sizes.tobytes(), [], 0
        for ids in coded:
            end = at + 4 * len(ids)
            made.append((ids_blob[at:end], sizes_blob[at:end]))
            at = end
        if self.unknown_ids[flat].any():  # their length is that of the text they stand for
            for i, ids in enumerate(coded):
                if self.unknown_ids[ids].any():
                    proto = self.pieces.encode(chunks[i].decode(), return_type="proto")
                    own = np.array([len(p.surface.encode()) for p in proto.pieces], np.int32)
                    made[i] = (made[i][0], own.tobytes())
        return made

    def _chunks(self, norm: bytes) -> list[bytes]:
        if not self.cut_spaces or _CUT in norm:
            return [norm] if norm else []
        meta = META.encode()
        cut = norm.replace(meta, _CUT + meta)
        if _CUT + meta + _CUT + meta in cut:  # a run of spaces stays together
            cut = cut.replace(meta + _CUT + meta, meta + meta)
            while meta + _CUT + meta in cut:
                cut = cut.replace(meta + _CUT + meta, meta + meta)
        if self.cut_lines:
            cut = cut.replace(b"\n", _CUT + b"\n" + _CUT)
        return [c for c in cut.split(_CUT) if c]

    def encode(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, first source bytes, source bytes after the last) for each text."""
        normal = [self.normalize(t) for t in texts]
        cut = [self._chunks(n) for n, _ in normal]
        values = self.cache.get([c for chunks in cut for c in chunks])
        out, at = [], 0
        for (_, align), chunks in zip(normal, cut):
            own = values[at : at + len(chunks)]
            at += len(chunks)
            ids = np.frombuffer(b"".join([v[0] for v in own]), np.int32)
            ends = np.cumsum(np.frombuffer(b"".join([v[1] for v in own]), np.int32))
            begins = np.concatenate([np.zeros(1, ends.dtype), ends[:-1]]) if len(ends) else ends
            out.append((ids, align[begins], align[ends]))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids, as the library decodes them."""
        if len(ids) == 0:
            return ""
        if self.unknown_ids[ids].any():
            return self.whole.decode(ids.tolist())
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        spots = np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - sizes), sizes)
        try:
            text = self.blob[spots].tobytes().decode()
        except UnicodeDecodeError:
            return self.whole.decode(ids.tolist())
        if self.dummy and text.startswith(META):
            text = text[1:]
        return text.replace(META, " ")


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One codec for each worker process and model."""
    return Codec(path)


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids, begins, ends, decoded.

    Piece i covers source bytes begins[i] to ends[i] of the UTF-8 text; pieces
    that only hold the added leading space, or a later byte of one character's
    expansion, cover none. A null text is empty and has no ids. Other columns
    are not read; repeated rows give repeated rows; an empty table none.
    ``path`` names the model on every machine (default: the public one there).
    """

    def run(batches):
        own = codec(path or model_path())
        for batch, texts in slices(batches, "text"):
            coded = own.encode(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *[list_array([c[k] for c in coded], pa.int32()) for k in range(3)],
                    pa.array([own.decode(c[0]) for c in coded], pa.string()),
                ],
                ["doc_id", "ids", "begins", "ends", "decoded"],
            )
            del coded
        own.cache.clear()
        give_back()

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, ids array<int>, begins array<int>, ends array<int>, decoded string"
    )


def digests(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and the source bytes that pieces cover."""
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).alias("n_covered"),
    )


def op4_sentencepiece(spark, sf_dir):
    return digests(encode_decode(C.table(spark, sf_dir, "documents")))
