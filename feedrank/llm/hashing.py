"""Vectorised hashes of bytes, words and word runs, in numpy inside tasks."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(7_919)
_BYTES = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E37_79B9_7F4A_7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_WEIGHTS = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _scales(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = -(-n // (1 << 20)) << 20
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _BASE)]), dtype=np.uint64)
        _inverses = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _INVERSE)]), dtype=np.uint64)
    return _powers, _inverses


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58_476D_1CE4_E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D0_49BB_1331_11EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of random byte values times powers of a base; n + 1 values."""
    powers, _ = _scales(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * powers[: len(data)], out=out[1:])
    return out


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans: equal spans have equal hashes, wherever they stand."""
    _, inverses = _scales(len(sums))
    return mix((sums[ends] - sums[starts]) * inverses[starts])


def windows(sums: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all spans of ``size`` bytes."""
    n = len(sums) - size
    if n <= 0:
        return np.zeros(0, np.uint64)
    _, inverses = _scales(len(sums))
    return mix((sums[size:] - sums[:n]) * inverses[:n])


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs without ASCII white space), and each text's first word (and the end)."""
    joined = b" ".join(texts) + b" "
    data = np.frombuffer(joined, np.uint8)
    solid = np.concatenate([np.zeros(1, bool), (data != 32) & ((data < 9) | (data > 13))])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edges[::2], edges[1::2]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    firsts = np.searchsorted(starts, np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths + 1)]))
    return spans(prefix_sums(data), starts, ends), firsts


def word_runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; of a shorter text, one of all its words."""
    size = min(size, len(hashes))
    if not size:
        return np.zeros(0, np.uint64)
    n = len(hashes) - size + 1
    total = hashes[:n] * _WEIGHTS[0]
    for k in range(1, size):
        total += hashes[k : k + n] * _WEIGHTS[k]
    return mix(total)
