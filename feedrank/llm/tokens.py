"""Words of whole texts inside tasks, as bytes, a bounded piece of the text at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Maps A-Z to a-z and leaves all other bytes, so that positions stay.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
PIECE_BYTES = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def pieces(text: bytes, size: int = PIECE_BYTES) -> Iterator[bytes]:
    """The text in pieces of about ``size`` bytes, cut at white space: no word is cut by it."""
    start = 0
    while len(text) - start > size:
        cut = _SPACE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text
