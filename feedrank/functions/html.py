"""Markup expressions: text, attributes and elements by regular expression.

All of it is JVM-side. Elements are found by tag, class token, class part or
attribute; the element ends at its first closing tag, or at the balanced one
with ``balanced``. Whole documents are processed, whatever their length.
"""

from __future__ import annotations

import functools
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import literal_map
from .text import let

_ATTRS = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
TAG = rf"<[a-zA-Z/!?]{_ATTRS}>"
_NBSP = "\u00a0"


@functools.lru_cache(maxsize=None)
def _named_entities() -> dict[str, str]:
    # Single-character names of the HTML standard, from the Python library.
    return {f"&{n}": c for n, c in html5.items() if n.endswith(";") and len(c) == 1 and c != "&"
            and c not in "\x1e\x1f"}


def drop_hidden(html: Column) -> Column:
    """Remove comments, scripts and styles."""
    return F.regexp_replace(
        html, r"(?is)<(?:!--.*?-->|script\b.*?</script\s*>|style\b.*?</style\s*>)", "")


def _code_point(ref: Column) -> Column:
    digits = F.regexp_extract(ref, r"(?i)^&#x?([0-9a-f]+);$", 1)
    base16 = F.lower(F.substring(ref, 3, 1)) == "x"
    number = F.when(base16, F.conv(digits, 16, 10)).otherwise(digits).try_cast("bigint")
    known = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
    return F.when(known, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))


def _decode(text: Column) -> Column:
    names = literal_map(_named_entities())
    found = F.array_distinct(F.regexp_extract_all(
        text, F.lit(r"(&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);)")))
    others = F.filter(found, lambda e: ~e.rlike("^&(?:amp|AMP|#38|#[xX]26);$"))
    plain = F.aggregate(
        others,
        text,
        lambda acc, e: F.replace(
            acc, e, F.coalesce(F.when(F.startswith(e, F.lit("&#")), _code_point(e))
                               .otherwise(F.try_element_at(names, e)), e)),
    )
    return F.when(~F.contains(text, F.lit("&")), text).otherwise(
        F.regexp_replace(plain, r"&(?:amp|AMP|#38|#[xX]26);", "&"))


def decode_entities(text: Column) -> Column:
    """Character references to characters; "&amp;" last, so nothing decodes twice."""
    return let(text, _decode)


def _joined(fragment: Column, sep: str) -> Column:
    marked = F.regexp_replace(fragment, r"&(?:nbsp|#160);", _NBSP)
    return F.regexp_replace(marked, rf"(?U)\s*(?:{TAG}\s*)+", sep)


def _finished(text: Column) -> Column:
    return F.replace(
        F.regexp_replace(_decode(text), r"(?U)^\s+|\s+$", ""), F.lit(_NBSP), F.lit(" "))


def text_of(fragment: Column, sep: str = " ") -> Column:
    """Text of a fragment: its text nodes stripped, empty ones dropped, joined."""
    return let(_joined(fragment, sep), _finished)


def texts_of(*fragments: tuple[Column, str | None]) -> Column:
    """Array of the texts of several (fragment, separator) pairs.

    The same as ``text_of`` for each, with the entity table once in the plan.
    A separator of None marks a plain value (an attribute).
    """
    parts = [value if sep is None else _joined(value, sep) for value, sep in fragments]
    return F.transform(F.array(*parts), _finished)


def page_text(html: Column) -> Column:
    """Visible text of a whole page with single spaces."""
    return F.trim(F.regexp_replace(text_of(drop_hidden(html)), r"(?U)\s+", " "))


def raw_attr(tag: Column, name: str) -> Column:
    """Attribute of an opening tag as written; null when absent.

    Everything before the name is taken in possessive runs, which the matcher
    walks in a loop: a tag may be as long as it likes.
    """
    named = rf"{name}\s*+="
    before = rf"""(?is)^<[a-z][^\s>/]*+(?:[^>"'\s]++|"[^"]*+"|'[^']*+'|\s++(?!{named}))*+\s++{named}\s*+"""
    found = F.nullif(F.regexp_extract(tag, rf"""{before}("[^"]*+"|'[^']*+'|[^\s>"']++)""", 1), F.lit(""))
    return F.regexp_replace(found, """^["']|["']$""", "")


def attr(tag: Column, name: str) -> Column:
    """Attribute of an opening tag, entities decoded; null when absent."""
    return decode_entities(raw_attr(tag, name))


def open_tag_pattern(
    tag: str = "[a-zA-Z][a-zA-Z0-9]*",
    class_name: str | None = None,
    class_part: str | None = None,
    having: str | None = None,
    value: str | None = None,
) -> str:
    """Regex of an opening tag. ``class_name`` is a whole class token,
    ``class_part`` a regex inside the class text, ``having`` an attribute with
    an optional ``value``."""
    looks = ""
    if class_name:
        looks += rf"""(?=[^>]*\sclass\s*=\s*(?:"(?:[^"]*\s)?{class_name}(?:\s[^"]*)?"|'(?:[^']*\s)?{class_name}(?:\s[^']*)?'|{class_name}[\s>]))"""
    if class_part:
        looks += rf"""(?=[^>]*\sclass\s*=\s*(?:"[^"]*(?:{class_part})[^"]*"|'[^']*(?:{class_part})[^']*'))"""
    if having:
        body = rf"""\s*=\s*(?:"{value}"|'{value}'|{value}[\s>/])""" if value else r"""\s*="""
        looks += rf"""(?=[^>]*\s{having}{body})"""
    return rf"<{tag}(?=[\s>/]){looks}{_ATTRS}>"


def first_tag(fragment: Column, **what) -> Column:
    """First matching opening tag; null when there is none."""
    return F.nullif(F.regexp_extract(fragment, f"(?is)({open_tag_pattern(**what)})", 1), F.lit(""))


def first_element(fragment: Column, tag: str = "[a-zA-Z][a-zA-Z0-9]*", **what) -> Column:
    """First matching element with its content, up to its first closing tag."""
    opening = open_tag_pattern(tag=f"({tag})", **what)
    return F.nullif(F.regexp_extract(fragment, rf"(?is)({opening}.*?</\2\s*>)", 1), F.lit(""))


def all_elements(fragment: Column, tag: str, **what) -> Column:
    opening = open_tag_pattern(tag=f"({tag})", **what)
    return F.regexp_extract_all(fragment, F.lit(rf"(?is)({opening}.*?</\2\s*>)"))


def pieces(html: Column, **what) -> Column:
    """Split before every matching opening tag; the part before the first is cut."""
    parts = F.split(html, f"(?is)(?={open_tag_pattern(**what)})")
    return F.filter(parts, lambda p: p.rlike(f"(?is)^{open_tag_pattern(**what)}"))


def until_close(piece: Column, tag: str) -> Column:
    """Cut at the first closing tag; an unclosed element runs to the end."""
    return F.regexp_extract(piece, rf"(?is)^(.*?)(?:</{tag}\s*>|$)", 1)


def _scan(items: Column, at: Column, depth: Column) -> Column:
    """Events (level, at, opens, open) of some parts of a page, from the place and depth before them."""
    event = "struct<level:int,at:int,opens:boolean,open:string>"
    begin = F.struct(at.alias("at"), depth.alias("depth"), F.array().cast(f"array<{event}>").alias("out"))

    def step(acc, p):
        level = F.when(p["turn"] > 0, acc["depth"]).when((p["turn"] < 0) & (acc["depth"] > 0), acc["depth"] - 1)
        new = F.struct(level.alias("level"), acc["at"].alias("at"), (p["turn"] > 0).alias("opens"), p["open"].alias("open"))
        return F.struct(
            (acc["at"] + p["n"]).alias("at"),
            F.greatest(acc["depth"] + p["turn"], F.lit(0)).alias("depth"),
            F.when(level.isNotNull(), F.concat(acc["out"], F.array(new))).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(items, begin, step, lambda acc: acc["out"])


def _events(parts: Column) -> Column:
    """Events of all parts. Pieces of about the square root of their number are scanned apart, so that no long array grows."""
    size = F.greatest(F.ceil(F.sqrt(F.size(parts))).cast("int"), F.lit(1))
    pieces_ = F.transform(F.sequence(F.lit(0), F.size(parts) - 1, size), lambda k: F.slice(parts, k + 1, size))
    state = "struct<at:int,depth:int>"

    def across(acc, piece):
        """A piece turns a depth d into max(d + up, low)."""
        effect = F.aggregate(
            piece,
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("up"), F.lit(0).alias("low")),
            lambda a, p: F.struct(
                (a["n"] + p["n"]).alias("n"), (a["up"] + p["turn"]).alias("up"), F.greatest(a["low"] + p["turn"], F.lit(0)).alias("low")),
        )
        moved = let(effect, lambda e: F.struct(
            (acc["now"]["at"] + e["n"]).alias("at"), F.greatest(acc["now"]["depth"] + e["up"], e["low"]).alias("depth")))
        return F.struct(moved.alias("now"), F.concat(acc["out"], F.array(acc["now"])).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"))
    starts = lambda ps: F.aggregate(
        ps, F.struct(zero.alias("now"), F.array().cast(f"array<{state}>").alias("out")), across, lambda acc: acc["out"])
    return let(pieces_, lambda ps: F.flatten(F.zip_with(ps, starts(ps), lambda p, s: _scan(p, s["at"], s["depth"]))))


def spans(html: Column, tag: str) -> Column:
    """All elements of one tag, nested ones too, in order of their opening tags:
    array of (start, end, open), with characters counted from 0. ``end`` is where the
    closing tag begins; an unclosed element runs to the end.

    On one level of nesting, opening and closing tags take turns, so sorted by
    level and place each element is two neighbours.
    """
    parts = F.split(html, rf"(?i)(?=</?{tag}[\s>/])")

    def turn_of(head):
        return F.when(head.rlike(rf"(?i)^<{tag}[\s>/]"), 1).when(head.rlike(rf"(?i)^</{tag}[\s>/]"), -1).otherwise(0)

    def mark(part):
        # Only the head of a part is looked at: a pattern that fails goes through the whole text.
        return let(turn_of(F.substring(part, 1, len(tag) + 3)), lambda turn: F.struct(
            F.length(part).alias("n"), turn.alias("turn"),
            F.when(turn > 0, F.regexp_extract(part, f"^({TAG})", 1)).alias("open")))

    def paired(events):
        def element(e, i):
            after = F.get(events, i + 1)
            end = F.when(after["level"] == e["level"], after["at"]).otherwise(F.length(html))
            return F.when(e["opens"], F.struct(e["at"].alias("start"), end.alias("end"), e["open"].alias("open")))

        return F.sort_array(F.filter(F.transform(events, element), lambda s: s.isNotNull()))

    events = let(F.transform(parts, mark), _events)
    return F.when(html.isNotNull(), let(F.sort_array(events), paired))


def elements(html: Column, tag: str) -> Column:
    """The texts of ``spans``, nested elements too, in order of their opening tags.

    Where no element holds another, as on most pages, each is the part of the page from its opening
    tag to the next tag of its kind; a span would be sought from the start of the page.
    """
    opens = lambda part: F.substring(part, 1, len(tag) + 2).rlike(rf"(?i)^<{tag}[\s>/]")

    def texts(parts):
        turns = F.array_join(F.transform(parts, lambda p: F.when(opens(p), F.lit("<")).otherwise(F.lit("/"))), "")
        nested = F.transform(spans(html, tag), lambda s: cut(html, s))
        return F.when(F.contains(turns, F.lit("<<")), nested).otherwise(F.filter(parts, opens))

    return let(F.split(html, rf"(?i)(?=</?{tag}[\s>/])"), texts)


def cut(html: Column, span: Column) -> Column:
    """The text of a span."""
    return F.substring(html, span["start"] + 1, span["end"] - span["start"])


def balanced(piece: Column, tag: str) -> Column:
    """Cut at the closing tag that belongs to the opening tag at the start."""
    parts = F.split(piece, rf"(?i)(?=</?{tag}[\s>/])")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(-1).alias("end"))

    def step(acc, part):
        depth = (
            acc["depth"]
            + F.when(part.rlike(rf"(?i)^<{tag}[\s>/]"), F.lit(1)).otherwise(F.lit(0))
            - F.when(part.rlike(rf"(?i)^</{tag}[\s>/]"), F.lit(1)).otherwise(F.lit(0))
        )
        ends = (acc["end"] < 0) & (depth <= 0) & (acc["at"] > 0)
        return F.struct(
            depth.alias("depth"),
            (acc["at"] + F.length(part)).alias("at"),
            F.when(ends, acc["at"]).otherwise(acc["end"]).alias("end"),
        )

    end = F.aggregate(parts, start, step, lambda acc: F.when(acc["end"] < 0, acc["at"]).otherwise(acc["end"]))
    return F.substring(piece, F.lit(1), end)
