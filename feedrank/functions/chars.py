"""Character folding as JVM expressions.

Spark has no NFKD and no casefold function, but it ships the Unicode tables that
its collations use. They are reached with ``reflect``, so no plan carries
a character table and nothing runs in Python workers. Pure ASCII text, the
common case, skips the call.

Spark takes ``reflect`` for non-deterministic: it does not push filters below a
projection that folds, nor copy the expression into others. Fold a name once, in
a column of its own, after the filters.
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

_KEY_SEP, _PAIR_SEP = "\x1f", "\x1e"


def literal_map(pairs: dict[str, str]) -> Column:
    """A constant map column, built with one call whatever its size."""
    text = _PAIR_SEP.join(f"{k}{_KEY_SEP}{v}" for k, v in pairs.items())
    return F.str_to_map(F.lit(text), F.lit(_PAIR_SEP), F.lit(_KEY_SEP))


_NOT_ASCII = r"[^\x00-\x7F]"
NORMALIZER = ("com.ibm.icu.text.Normalizer", "decompose")
FOLDER = ("com.ibm.icu.lang.UCharacter", "foldCase")


@functools.lru_cache(maxsize=None)
def marks() -> str:
    """Regex class of the combining marks: characters with a combining class."""
    spans: list[list[int]] = []
    for cp in range(0x80, 0x110000):
        if unicodedata.combining(chr(cp)):
            if spans and cp == spans[-1][1] + 1:
                spans[-1][1] = cp
            else:
                spans.append([cp, cp])
    return "[" + "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in spans) + "]"


def _unicode(method: tuple[str, str], col: Column) -> Column:
    return F.reflect(F.lit(method[0]), F.lit(method[1]), col, F.lit(True))


def strip_accents(col: Column) -> Column:
    """NFKD with combining marks dropped."""
    plain = F.regexp_replace(_unicode(NORMALIZER, col), marks(), "")
    return F.when(col.rlike(_NOT_ASCII), plain).otherwise(col)


def casefold(col: Column) -> Column:
    """Unicode case folding ("Straße" -> "strasse")."""
    return F.when(col.rlike(_NOT_ASCII), _unicode(FOLDER, col)).otherwise(F.lower(col))
