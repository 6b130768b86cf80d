"""PII: detected entities get keyed surrogates of the same type and format.

An entity is named by its canonical form (a phone number by its digits, an
e-mail address in lower case, a person by gender, script, given and family
name), so that spellings of one entity share one surrogate. Persons are found
by their titles; then their full and family names are replaced wherever the same
text has them without one. A family name is an entity of its own, so that all
who bear it keep one name; given names are told apart inside it. The surrogate's canonical form is drawn from a
keyed hash of the entity's; every occurrence shows it in its own format. All
distinct entities of the table are checked together: of entities whose surrogates
are equal all but one draw again, and so does one whose surrogate is an entity
of the table itself.
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
import ipaddress
import re
import secrets
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from . import common as C
from .arrow import slices

#: Spark setting with the key of the surrogates (text). Whoever has it can find short numbers again by trial.
KEY_SETTING = "spark.feedrank.surrogates.key"
_RUN_KEY = secrets.token_bytes(32)
#: Entities whose first surrogate clashed; more are joined instead of sent to every task.
SENT_ROWS = 50_000
MOST_ROUNDS = 30

# Titles that mark a person, by gender; given names by script and gender; parts of surnames.
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Señora", "Sra", "Госпожа", "Κυρία"),
    "m": ("Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"),
    "n": ("Dr", "Prof", "Professor"),
}
GIVEN = {
    ("latin", "f"): ("Anna", "Clara", "Elena", "Julia", "Laura", "Marie", "Nora", "Sofia", "Emma", "Lena", "Irene", "Paula"),
    ("latin", "m"): ("Adam", "Bruno", "David", "Erik", "Felix", "Hugo", "Jonas", "Leon", "Marco", "Oscar", "Simon", "Victor"),
    ("latin", "n"): ("Alex", "Charlie", "Kim", "Robin", "Sascha", "Noa", "Toni", "Jules"),
    ("cyrillic", "f"): ("Анна", "Вера", "Елена", "Ирина", "Мария", "Ольга"),
    ("cyrillic", "m"): ("Борис", "Виктор", "Иван", "Олег", "Павел", "Сергей"),
    ("cyrillic", "n"): ("Саша", "Женя", "Валя"),
    ("greek", "f"): ("Άννα", "Ελένη", "Ιωάννα", "Μαρία", "Σοφία"),
    ("greek", "m"): ("Γιώργος", "Δημήτρης", "Νίκος", "Πέτρος", "Στέλιος"),
    ("greek", "n"): ("Χάρις", "Φως"),
}
SYLLABLES = {
    "latin": ("ba", "den", "fal", "gor", "hel", "jan", "kel", "lor", "mar", "nel", "or", "pen", "ros", "sal", "tor", "ven"),
    "cyrillic": ("ба", "вен", "гор", "дал", "кол", "лан", "мир", "нов", "пет", "рос", "сад", "тов"),
    "greek": ("βα", "γορ", "δαλ", "κελ", "λαν", "μαρ", "νελ", "πετ", "ροσ", "σαλ", "τορ"),
}

# Prefixes of access tokens.
TOKEN_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk_live_", "sk_test_", "rk_live_", "xoxb-", "xoxp-", "xoxa-", "xoxr-", "AIza", "AKIA")

_TITLE = {t.casefold(): g for g, ts in TITLES.items() for t in ts}
_NAME = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
PATTERNS = (
    ("email", re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"), "@"),
    ("secret", re.compile(r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"), "AKIA"),
    ("secret", re.compile(rf"(?<![A-Za-z0-9])(?:{'|'.join(TOKEN_PREFIXES)})[A-Za-z0-9_-]{{16,}}(?![A-Za-z0-9])"), ""),
    ("secret", re.compile(r"""(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key)\s*[:=]\s*["']?([^\s"',;]{6,})"""), ""),
    ("secret", re.compile(r"(?<![A-Za-z0-9])(?=[a-f]*\d)(?=\d*[a-f])[0-9a-f]{32,}(?![A-Za-z0-9])"), ""),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"), ""),
    ("ip", re.compile(rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\w)"), ""),
    ("ip", re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f:]*[0-9A-Fa-f])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.\w)"), ":"),
    ("card", re.compile(r"(?<![\w.+-])\d+(?:[ -]\d+)*(?!\w)"), ""),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"), ""),
    ("phone", re.compile(r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{3,4}[ .-]\d{3,4}(?![\w-])"), ""),
    ("phone", re.compile(r"(?<![\w.+-])\+\d{8,15}(?![\w-])"), "+"),
    ("phone", re.compile(r"(?i)\b(?:tel|telephone|phone|mobile|fax|call)\b[.:]? ?(\d{7,15})(?![\w-])"), ""),
    (
        "name",
        re.compile(rf"\b(?:{'|'.join(sorted(map(re.escape, (w for ts in TITLES.values() for t in ts for w in (t, t.upper()))), key=len, reverse=True))})\b\.? (?=({_NAME}(?: {_NAME}){{0,2}})(?!\w))"),
        "",
    ),
)
_NEEDS_DIGIT = {"iban", "ip", "card", "ssn", "phone"}


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def luhn(digits: str) -> int:
    """The check sum modulo 10; 0 for a valid number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10


def _cards(text: str, start: int) -> Iterator[tuple[str, int, int]]:
    """(digits, start, end) of the card numbers in groups of digits: the longest valid runs of whole groups, from the left."""
    groups = [(m.start() + start, m.end() + start, m[0]) for m in re.finditer(r"\d+", text)]
    i = 0
    while i < len(groups):
        best, total = None, ""
        for j in range(i, len(groups)):
            total += groups[j][2]
            if len(total) > 19:
                break
            if len(total) >= 13 and not luhn(total) and set(total) != {"0"}:
                best = (j, total)
        if best is None:
            i += 1
            continue
        yield best[1], groups[i][0], groups[best[0]][1]
        i = best[0] + 1


def _phone(own: str) -> str | None:
    """The digits, with the country code apart where a sign and a separator tell it."""
    digits = _digits(own)
    if not 7 <= len(digits) <= 15:
        return None
    if own.startswith("+1") and len(digits) == 11:
        return digits[1:]
    code = re.match(r"\+(\d{1,3})[ .(-]", own)
    return f"{code[1]}|{digits[len(code[1]):]}" if code else digits


def _script(text: str) -> str:
    for c in text:
        name = unicodedata.name(c, "")
        for script in ("CYRILLIC", "GREEK"):
            if name.startswith(script):
                return script.lower()
    return "latin"


def _person(match: re.Match) -> tuple[str, int, int] | None:
    """Canonical form (gender|script|given names|family name) and span of the capitalised words after a title."""
    words, end = [], match.start(1)
    for part in re.finditer(_NAME, match[1]):
        if not part[0][0].isupper() or (words and part[0].isupper() != words[0].isupper()):
            break
        own = _bare(part[0])
        if own.casefold() in _TITLE:  # a title of the next person, or a second one that is matched itself
            break
        words.append(own)
        end = match.start(1) + part.start() + len(own)
        if own != part[0]:
            break
    if not words:
        return None
    title = match[0][: match.start(1) - match.start()].rstrip(". ").casefold()
    *given, family = map(_folded, words)
    return f"{_TITLE.get(title, 'n')}|{_script(words[-1])}|{' '.join(given)}|{family}", match.start(1), end


def _bare(word: str) -> str:
    """The word without a possessive ending."""
    return re.sub(r"(?<=.)['’][sS]$", "", word)


def _folded(word: str) -> str:
    return unicodedata.normalize("NFC", word).casefold()


def _family(name: str) -> str:
    """The canonical form of a person's family name."""
    _, script, _, family = name.split("|")
    return f"{script}|{family}"


def _told_apart(names: list[str]) -> dict[str, str]:
    """Names as titles give them -> the persons of the text.

    A neutral title takes the one gender that the text gives the full name, else
    the family name while that has one bearer. A family name alone is the one
    bearer of its gender.
    """
    bearers: dict[str, dict[str, set[str]]] = {}
    for name in names:
        gender, _, given, _ = name.split("|")
        bearers.setdefault(_family(name), {}).setdefault(given, set()).update({gender} - {"n"})
    found = {}
    for name in names:
        gender, script, given, family = name.split("|")
        own = bearers[_family(name)]
        full = [g for g in own if g]
        if gender == "n":
            genders = own[given]
            if not genders and (not given or len(full) == 1):
                genders = set().union(*own.values())
            gender = min(genders) if len(genders) == 1 else "n"
        if not given:
            alike = [g for g in full if gender == "n" or gender in own[g] or not own[g]]
            given = alike[0] if len(alike) == 1 else ""
        found[name] = f"{gender}|{script}|{given}|{family}"
    return found


def _untitled(text: str, persons: list[str], taken: list[tuple[int, int]]) -> Iterator[tuple[str, int, int]]:
    """(person, start, end) of full and family names of ``persons`` at places that are not taken."""
    by_family: dict[str, dict[str, str]] = {}
    for name in persons:
        _, _, given, family = name.split("|")
        by_family.setdefault(family, {}).setdefault(given, name)
    starts = [a for a, _ in taken]
    before: list[tuple[str, int, int]] = []  # the given names that may belong to the next word
    for match in re.finditer(rf"(?<!\w){_NAME}(?!\w)", text):
        own = _bare(match[0])
        pieces = [(own, match.start())]
        if _folded(own) not in by_family and own != re.sub(r"['’-]", "", own):
            pieces = [(part[0], match.start() + part.start()) for part in re.finditer(r"[^\W\d_]+", own)]
        for word, start in pieces:
            end, fold = start + len(word), _folded(word)
            if before and text[before[-1][2] : start] != " ":
                before = []
            bearers = by_family.get(fold)
            if bearers is None or not word[0].isupper():
                before = [*before[-1:], (fold, start, end)] if word[0].isupper() else []
                continue
            name, begin = None, start
            for k in (2, 1):
                given = " ".join(w for w, _, _ in before[-k:])
                if len(before) >= k and given in bearers:
                    name, begin = bearers[given], before[-k][1]
                    break
            if name is None:
                if len(word) < 2:  # an initial alone is no name
                    before = [*before[-1:], (fold, start, end)]
                    continue
                name = next(iter(bearers.values()))
                if len(bearers) > 1:
                    gender, script, _, family = name.split("|")
                    name = bearers.get("", f"n|{script}||{family}")
            before = [*before[-1:], (fold, start, end)]  # a family name may be another's given name
            at = bisect.bisect_right(starts, begin)
            if (at == 0 or taken[at - 1][1] <= begin) and (at == len(taken) or taken[at][0] >= end):
                yield name, begin, end
                before = []


def _address(own: str) -> str | None:
    """The long form of an IPv6 address; null for times and other texts with colons."""
    try:
        address = ipaddress.IPv6Address(own)
    except ValueError:
        return None
    return None if address.is_unspecified or address.is_loopback else address.exploded


def find(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, canonical form, start, end) of the entities, in order; earlier patterns win overlaps.

    Full and family names of the persons found are sought once more without titles.
    """
    found, taken = [], []
    digits = any(c in text for c in "0123456789")
    for kind, pattern, needle in PATTERNS:
        if needle not in text or (kind in _NEEDS_DIGIT and not digits):
            continue
        for match in pattern.finditer(text):
            start, end = match.span(1) if pattern.groups and kind in ("secret", "phone") else match.span()
            own = text[start:end]
            named = []
            if kind == "name":
                named = [person] if (person := _person(match)) else []
            elif kind == "email":
                named = [(own.lower(), start, end)]
            elif kind == "card":
                named = list(_cards(own, start))
            elif kind == "ssn":
                named = [(_digits(own), start, end)]
            elif kind == "phone":
                named = [(number, start, end)] if (number := _phone(own)) else []
            elif kind == "iban":
                name = own.replace(" ", "")
                named = [(name, start, end)] if int("".join(str(int(c, 36)) for c in name[4:] + name[:4])) % 97 == 1 else []
            elif kind == "ip" and ":" in own:
                named = [(name, start, end)] if (name := _address(own)) else []
            else:
                named = [(own, start, end)]
            for name, a, b in named:
                at = bisect.bisect_left(taken, (a, b))  # disjoint spans in order: only the neighbours can overlap
                if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or taken[at][0] >= b):
                    taken.insert(at, (a, b))
                    found.append((kind, name, a, b))
    if named := [f[1] for f in found if f[0] == "name"]:
        persons = _told_apart(named)
        found = [(kind, persons[name] if kind == "name" else name, a, b) for kind, name, a, b in found]
        known = list(dict.fromkeys(persons[n] for n in named))
        found += [("name", *f) for f in _untitled(text, known, taken)]
    return sorted(found, key=lambda f: f[2])


def _entities(text: str) -> set[tuple[str, str]]:
    """(kind, canonical form) of all that gets a surrogate: what is found, and the persons' family names."""
    found = {(kind, name) for kind, name, _, _ in find(text)}
    families = {("family", _family(name)) for kind, name in found if kind == "name"}
    return {(kind, name) for kind, name in found if kind != "name" or name.split("|")[2]} | families


class Draws:
    """A stream of numbers that a key, an entity and an attempt decide."""

    def __init__(self, key: bytes, *names: object) -> None:
        self.key, self.seed, self.turn, self.left = key, "\x1f".join(map(str, names)).encode(), 0, 0
        self.pool = 0

    def below(self, n: int) -> int:
        if self.left < 1 << 40:
            block = hmac.new(self.key, self.seed + self.turn.to_bytes(4, "big"), hashlib.sha256).digest()
            self.pool, self.left, self.turn = int.from_bytes(block, "big"), 1 << 256, self.turn + 1
        self.pool, out = divmod(self.pool, n)
        self.left //= n
        return out

    def like(self, text: str, hexa: bool = False) -> str:
        """Letters for letters, digits for digits; other characters stay."""
        out = []
        for c in text:
            if c.isdigit():
                out.append("0123456789"[self.below(10)])
            elif c.isalpha():
                letters = "abcdef" if hexa else "abcdefghijklmnopqrstuvwxyz"
                own = letters[self.below(len(letters))]
                out.append(own.upper() if c.isupper() else own)
            else:
                out.append(c)
        return "".join(out)


def surrogate(kind: str, name: str, attempt: int, key: bytes) -> str:
    """Canonical form of the entity's surrogate."""
    draw = Draws(key, kind, name, attempt)
    if kind == "email":
        local, domain = name.split("@", 1)
        return f"{draw.like(local)}@{draw.like(domain.rsplit('.', 1)[0].replace('.', '-'))}.example"
    if kind == "ip" and ":" in name:  # addresses for documentation
        return "2001:0db8:" + ":".join(f"{draw.below(1 << 16):04x}" for _ in range(6))
    if kind == "ip":  # addresses that are reserved for no use
        return ".".join(str(n) for n in (240 + draw.below(15), draw.below(256), draw.below(256), 1 + draw.below(254)))
    if kind == "card":
        body = name[0] + "".join(str(draw.below(10)) for _ in name[2:])
        return body + str((10 - luhn(body + "0")) % 10)
    if kind == "iban":
        body = draw.like(name[4:])
        check = 98 - int("".join(str(int(c, 36)) for c in body + name[:2] + "00")) % 97
        return f"{name[:2]}{check:02d}{body}"
    if kind == "phone" and "|" in name:
        code, rest = name.split("|")
        return f"{code}|{2 + draw.below(8)}{''.join(str(draw.below(10)) for _ in rest[1:])}"
    if kind in ("phone", "ssn"):
        return str(2 + draw.below(8)) + "".join(str(draw.below(10)) for _ in name[1:])
    if kind == "family":
        script = name.split("|")[0]
        parts = SYLLABLES[script]
        return f"{script}|{''.join(parts[draw.below(len(parts))] for _ in range(3 + attempt // 2))}"
    if kind == "name":  # the family name has a surrogate of its own, by which no two are equal
        gender, script, given, family = name.split("|")
        names = GIVEN[script, gender]
        new = ("-".join(names[draw.below(len(names))] for _ in range(1 + attempt // 2)) for _ in given.split())
        return f"{gender}|{script}|{' '.join(new)}|{family}"
    prefix = next((p for p in TOKEN_PREFIXES if name.startswith(p)), "")
    return prefix + draw.like(name[len(prefix):], hexa=not re.search(r"[g-zG-Z]", name))


def show(kind: str, own: str, replaced: str) -> str:
    """The surrogate in the format of this occurrence."""
    if kind in ("phone", "card", "ssn"):
        digits = list(_digits(replaced))
        keep = len(_digits(own)) - len(digits)
        out = []
        for c in own:
            if c.isdigit():
                c = c if keep > 0 else digits.pop(0)
                keep -= 1
            out.append(c)
        return "".join(out)
    if kind == "iban":
        rest = iter(replaced)
        return "".join(c if c == " " else next(rest) for c in own)
    if kind == "email":
        return replaced.upper() if own.isupper() else replaced
    if kind == "name":
        _, _, given, family = replaced.split("|")
        out = f"{given} {family.capitalize()}" if " " in own and given else family.capitalize()
        return out.upper() if own.isupper() and len(own) > 1 else out
    return replaced


def replace(text: str, moved: dict[tuple[str, str], int], key: bytes) -> tuple[str, list[dict]]:
    """The text with surrogates, and their kinds and places in the new text."""
    out, at, spans, size = [], 0, [], 0
    for kind, name, start, end in find(text):
        new = surrogate(kind, name, moved.get((kind, name), 0), key)
        if kind == "name":
            family = "family", _family(name)
            new = f"{new.rpartition('|')[0]}|{surrogate(*family, moved.get(family, 0), key).partition('|')[2]}"
        new = show(kind, text[start:end], new)
        out += [text[at:start], new]
        size += start - at
        spans.append({"kind": kind, "start": size, "end": size + len(new)})
        size += len(new)
        at = end
    return "".join([*out, text[at:]]) if out else text, spans


def _named(batches) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches, "text"):
        rows = {e for t in texts for e in _entities(t.decode())}
        yield pa.RecordBatch.from_pydict({"kind": [k for k, _ in rows], "name": [n for _, n in rows]}, schema=_ENTITY)


_ENTITY = pa.schema([("kind", pa.string()), ("name", pa.string())])


def run_key(spark: SparkSession) -> bytes:
    """The key of the setting; without it one that this driver process has drawn, so that no reader of the code has it."""
    own = spark.conf.get(KEY_SETTING, None)
    return own.encode() if own else _RUN_KEY


def assign(entities: DataFrame, key: bytes | None = None) -> DataFrame:
    """Rows (kind, name) get ``attempt`` and ``surrogate`` so that no two surrogates of a kind are equal.

    One pass draws for all; the rounds that follow draw again for those that
    clash, and compare them with all others.
    """
    key = key or run_key(entities.sparkSession)

    def draw(batches):
        for batch in batches:
            kinds, names, attempts = (batch.column(i).to_pylist() for i in range(3))
            made = [surrogate(k, n, a, key) for k, n, a in zip(kinds, names, attempts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], ["kind", "name", "attempt", "surrogate"])

    schema = "kind string, name string, attempt int, surrogate string"
    state = materialize(entities.withColumn("attempt", F.lit(0)).mapInArrow(draw, schema), "pii-surrogates")
    real = entities.select("kind", F.col("name").alias("surrogate"), F.lit(True).alias("real"))
    for _ in range(MOST_ROUNDS):
        first = state.groupBy("kind", "surrogate").agg(
            F.min(F.struct("attempt", "name")).alias("stays"), F.count(F.lit(1)).alias("n")
        )
        clash = first.join(real, ["kind", "surrogate"], "left").filter("n > 1 or real")
        if not clash.take(1):
            return state
        marked = state.join(clash.select("kind", "surrogate", "stays", "real"), ["kind", "surrogate"], "left")
        # Only equal surrogates and real entities draw again.
        again = F.col("stays").isNotNull() & (F.col("real").isNotNull() | (F.col("stays.name") != F.col("name")))
        redrawn = marked.filter(again).select("kind", "name", (F.col("attempt") + 1).alias("attempt")).mapInArrow(draw, schema)
        state = materialize(marked.filter(~again).select(*state.columns).unionByName(redrawn), "pii-surrogates")
    raise RuntimeError(f"surrogates still clash after {MOST_ROUNDS} rounds")


def pseudonymize(docs: DataFrame, key: bytes | None = None, sent_rows: int = SENT_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, text with surrogates, spans (kind, start, end in the new text).

    Texts without entities stay as they are; a null text stays null. Repeated
    rows get the same surrogates, and so do runs with the same ``key`` (default:
    see ``run_key``). Other columns are not read, whatever their names; texts of
    any length are read whole. An empty table gives no rows.
    """
    key = key or run_key(docs.sparkSession)
    entities = materialize(docs.select("text").mapInArrow(_named, "kind string, name string").distinct(), "pii-entities")
    moved = assign(entities, key).filter("attempt > 0").select("kind", "name", "attempt")
    schema = "doc_id long, text string, spans array<struct<kind:string,start:int,end:int>>"

    def run(sent: dict[tuple[str, str], int], joined: bool):
        def rows(batches):
            for batch, texts in slices(batches, "text"):
                at = batch.schema.get_field_index("moved")
                lists = batch.column(at).to_pylist() if joined else [None] * len(texts)
                nulls = batch.column(1).is_null().to_pylist()
                made = [
                    replace(t.decode(), {(m["kind"], m["name"]): m["attempt"] for m in own or ()} if joined else sent, key)
                    for t, own in zip(texts, lists)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([None if n else t for (t, _), n in zip(made, nulls)], pa.string()),
                        pa.array([s for _, s in made], _SPANS),
                    ],
                    ["doc_id", "text", "spans"],
                )

        return rows

    few = moved.limit(sent_rows + 1).collect()  # given names are drawn again most: a family has few first ones
    if len(few) <= sent_rows:
        sent = {(r.kind, r.name): r.attempt for r in few}
        return docs.select("doc_id", "text").mapInArrow(run(sent, False), schema)
    # More than a task should be sent: each text gets the attempts of its own entities by a join.
    named = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("at"))

    def own(batches):
        for batch, texts in slices(batches, "text"):
            rows = {(a, k, n) for a, t in zip(batch.column(1).to_pylist(), texts) for k, n in _entities(t.decode())}
            yield pa.RecordBatch.from_pylist(
                [{"at": a, "kind": k, "name": n} for a, k, n in rows], schema=pa.schema([("at", pa.int64()), *_ENTITY])
            )

    lists = (
        named.select("text", "at").mapInArrow(own, "at long, kind string, name string").distinct()
        .join(moved, ["kind", "name"]).groupBy("at")
        .agg(F.collect_list(F.struct("kind", "name", "attempt")).alias("moved"))  # of one text
    )
    return named.join(lists, "at", "left").select("doc_id", "text", "moved").mapInArrow(run({}, True), schema)


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def op5_pii_surrogates(spark, sf_dir):
    made = pseudonymize(C.table(spark, sf_dir, "documents"))
    return made.select("doc_id", F.size("spans").cast("long").alias("n_entities"), "text", F.col("spans.kind").alias("kinds"))
