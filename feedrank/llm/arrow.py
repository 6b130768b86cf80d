"""Arrow batches inside tasks: slices of bounded size, and a bounded two-generation cache."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that a task works on at once (one longer text is a slice of its own).
SLICE_BYTES = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut batches so that no slice holds more than ``limit`` bytes of text; null texts are empty."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
        sizes = np.diff(np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]) if len(column) else np.zeros(0, np.int64)
        start = total = 0
        for i, size in enumerate(sizes.tolist()):
            if i > start and total + size > limit:
                yield batch.slice(start, i - start), [x or b"" for x in column.slice(start, i - start).to_pylist()]
                start, total = i, 0
            total += size
        if start < len(batch):
            yield batch.slice(start), [x or b"" for x in column.slice(start).to_pylist()]


def give_back() -> None:
    """Return freed memory to the machine: a worker process that has done its task waits beside the next stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def keep_freed(most: int = 16 << 20) -> None:
    """Keep up to ``most`` freed bytes in this process: work in many short arrays else gets every page anew."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-1, most)  # M_TRIM_THRESHOLD
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD: longer arrays go back at once
    except (OSError, AttributeError):  # another C library
        pass


def parts(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for batch in batches:
        for start in range(0, len(batch), rows):
            yield batch.slice(start, rows)


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """One list per numpy array."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


class Cache:
    """Chunk -> value, for the most recent ``size`` to 2 * ``size`` chunks."""

    def __init__(self, make: Callable[[list], list] | None, size: int) -> None:
        self.make, self.size, self.young, self.old = make, size, {}, {}

    def get(self, chunks: list, make: Callable[[list], list] | None = None) -> list:
        """Values of the chunks; those that are in no generation are made together."""
        young, make = self.young, make or self.make
        values = [young.get(c) for c in chunks]
        if None in values:
            missing = dict.fromkeys(c for c, v in zip(chunks, values) if v is None)
            old = self.old
            found = {c: old[c] for c in missing if c in old}
            new = [c for c in missing if c not in found]
            found.update(zip(new, make(new)))
            values = [found[c] if v is None else v for c, v in zip(chunks, values)]
            if len(young) + len(found) > self.size:
                self.old, self.young = young, found
            else:
                young.update(found)
        return values

    def clear(self) -> None:
        self.young, self.old = {}, {}


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal (integer) keys, over the borders of batches. Rows must come sorted by key."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        columns = [np.asarray(batch.column(batch.schema.get_field_index(k))) for k in keys]
        change = np.zeros(len(batch), bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), len(batch)]
        for start, end in zip(cuts, cuts[1:]):
            key = tuple(int(c[start]) for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = key
    if held:
        yield pa.Table.from_batches(held)
