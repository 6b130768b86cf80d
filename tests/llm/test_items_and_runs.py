"""Decontamination, periodic runs and ranked search against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from feedrank.llm import common, decontaminate, lexical_search, period_runs
from test_corpus import SCHEMA, prose, raw, rows

SMALL = "/root/testdata/sf0.001"


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


ITEM_SCHEMA = "item_id long, text string, score double, n_words long, words string"


def item_rows():
    """Benchmark-like rows: long, short, one word, empty, null, repeated, shared, and clashing columns."""
    own = prose(40, 2)
    texts = [prose(60, 1), prose(25, 99), own, own, "one two three", "x", "", None, "two three", "TOK tok", prose(12, 98) + "é",
             " ".join(prose(9, 97).split()[:9])]
    out = [(i, t, 0.0, 0, "w") for i, t in enumerate(texts)]
    return [*out, out[0], (4, "one two", 0.0, 0, "w"), (None, "w▁x y z", 0.0, 0, "w")]


@pytest.fixture(scope="module")
def frames(spark):
    passage = prose(60, 1).split()
    more = [
        (100, prose(50, 70) + " ".join(passage[5:40]) + ". " + prose(50, 71)),
        (101, " ".join(passage[:15]) + " Stop " + " ".join(passage[15:24]) + " " + " ".join(passage[30:50]).upper()),
        (102, "x " * 5 + "One, two; three!"), (103, prose(40, 2)), (104, prose(40, 2)), (104, prose(40, 2)),
        (105, " ".join(passage[:10])), (106, " ".join(passage[:9])),
        (107, prose(90_000, 6) + " ".join(passage[20:35]) + " " + prose(90_000, 7)),
    ]
    made = [*rows(), *[(i, t, "en", "s", 0, "c", 0, "k") for i, t in more]]
    docs = spark.createDataFrame(made, SCHEMA).repartition(3).cache()
    return docs, made, spark.createDataFrame(item_rows(), ITEM_SCHEMA).cache()


# -- 11 decontamination

_WORD11 = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def hits(text, items, window=10):
    words = re.findall(_WORD11, lower(text))
    grams = defaultdict(set)
    for i, t in items:
        own = re.findall(_WORD11, lower(t))
        size = min(window, len(own))
        for k in range(len(own) - size + 1 if own else 0):
            grams[tuple(own[k : k + size])].add("" if i is None else str(i))
    covered, names = set(), set()
    for size in {len(g) for g in grams}:
        for k in range(len(words) - size + 1):
            own = grams.get(tuple(words[k : k + size]))
            if own:
                covered |= set(range(k, k + size))
                names |= own
    return len(words), covered, sorted(names)


@pytest.mark.parametrize("block_words", [decontaminate.BLOCK_WORDS, 30])
def test_hit_words(frames, block_words):
    docs, made, items = frames
    own = [(r[0], r[1]) for r in item_rows()]
    want = Counter()
    for r in made:
        n, covered, names = hits(r[1], own)
        want[(r[0], n, len(covered), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(covered))] += 1
    found = decontaminate.digests(decontaminate.matches(docs, items, block_words=block_words, keep_text=False))
    assert Counter(map(tuple, found.collect())) == want
    assert sum(r[2] > 0 for r in want) > 5


def test_cleaned_texts(frames, spark):
    docs, made, items = frames
    own = [(r[0], r[1]) for r in item_rows()]
    got = decontaminate.decontaminate(docs.filter("doc_id >= 100"), items, least_words=12, most_hit=0.6).collect()
    texts = {r[0]: r[1] for r in made}
    for r in got:
        n, covered, _ = hits(texts[r.doc_id], own)
        places = [m.span() for m in re.finditer(_WORD11.encode(), raw(texts[r.doc_id]).lower())]
        kept, spans, k = b"", [], 0
        while k < n:
            end = k
            while end in covered:
                end += 1
            if end - k >= 12:
                spans.append((places[k][0], places[end - 1][1]))
            k = max(end, k + 1)
        at = 0
        for a, b in spans:
            kept += raw(texts[r.doc_id])[at:a]
            at = b
        assert list(zip(r.removed_from, r.removed_to)) == spans
        assert raw(r.kept_text) == kept + raw(texts[r.doc_id])[at:]
        assert r.dropped == (len(covered) > 0.6 * n)
    assert {r.doc_id for r in got if r.dropped} >= {103, 104, 105} and any(r.removed_from for r in got if not r.dropped)


def test_empty_tables_of_hits(frames, spark):
    docs, made, items = frames
    no_docs, no_items = docs.limit(0), items.limit(0)
    assert decontaminate.matches(no_docs, items).count() == 0
    got = decontaminate.digests(decontaminate.matches(docs, no_items)).collect()
    assert len(got) == len(made) and not any(r.contaminated or r.n_items for r in got)
    assert decontaminate.decontaminate(no_docs, no_items).count() == 0


def test_automaton_finds_longest_matches():
    own = random.Random(3)
    for _ in range(60):
        items = [(str(i), [own.choice([b"a", b"b", b"c"]) for _ in range(own.randint(0, 14))]) for i in range(own.randint(1, 6))]
        window = own.randint(1, 6)
        text = [own.choice([b"a", b"b", b"c", b"d"]) for _ in range(60)]
        automaton = decontaminate.Automaton(items, window)
        n, spans, names = automaton.match(b" ".join(text))
        covered, want = set(), set()
        for name, words in items:
            size = min(window, len(words))
            for k in range(len(words) - size + 1 if words else 0):
                for j in range(len(text) - size + 1):
                    if text[j : j + size] == words[k : k + size]:
                        covered |= set(range(j, j + size))
                        want.add(name)
        assert n == 60 and names == want
        assert {k for a, b in spans for k in range(a, b)} == covered


# -- 12 periodic runs


def brute_runs(x):
    x, out = np.asarray(x), []
    for q in range(1, len(x) // 3 + 1):
        same = np.concatenate([[False], x[:-q] == x[q:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            length = b - a + q
            if length >= max(24, 3 * q) and not any(q % d == 0 and np.array_equal(x[a : a + length - d], x[a + d : a + length]) for d in range(1, q)):
                out.append((a, length, q))
    return sorted(out)


def test_transforms_are_exact():
    rng = np.random.default_rng(1)
    for size in (2, 16, 128):
        rows_ = rng.integers(0, period_runs.PRIME, (3, size)).astype(np.uint64)
        assert np.array_equal(period_runs.restore(period_runs.transform(rows_)), rows_)
    blocks = rng.integers(0, 3, (50, 4))
    windows = rng.integers(0, 3, (50, 8))
    got = set(zip(*[x.tolist() for x in period_runs.zero_distances(blocks, windows)]))
    assert got == {(r, d) for r in range(50) for d in range(4) if np.array_equal(blocks[r], windows[r, d : d + 4])}


def test_runs_of_sequences():
    own = np.random.default_rng(5)
    cases = [[], [1], [1] * 24, [1] * 23, [1, 2] * 300, list(range(100)) * 3, list(range(100)) * 3 + [0, 1, 5] * 40, [0] * 5_000]
    for k in range(300):
        base = own.integers(0, int(own.integers(1, 4)) + 1, int(own.integers(1, 60)))
        parts = [own.integers(0, 5, int(own.integers(0, 40))), np.tile(base, int(own.integers(1, 9))), own.integers(0, 2, int(own.integers(0, 80)))]
        parts.append(np.tile(np.concatenate(parts)[-200:], int(own.integers(1, 6))))
        cases.append(np.concatenate(parts).tolist())
    wanted = [brute_runs(np.array(c, np.int64)) for c in cases]
    for c, want in zip(cases, wanted):
        got = period_runs.slice_runs([np.array(c, np.int64)], 200)[0]
        assert got == want, (c, got, want)
    together = period_runs.slice_runs([np.array(c, np.int64) for c in cases], 200)
    assert [sorted(x) for x in together] == wanted
    assert sum(map(len, wanted)) > 300


def run_row(doc_id, text, rewrite=True):
    words = raw(text).split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if rewrite and doc_id is not None and h % 10 == 0 and n:
        a, p = (h // 10) % n, 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    table = {}
    found = brute_runs(np.array([table.setdefault(w, len(table)) for w in words], np.int64))
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{length},{q}\n" for s, length, q in sorted(found, key=lambda r: (r[0], r[2]))).encode()),
            sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_periodic_runs_of_documents(spark, frames):
    docs, made, _ = frames
    few = [r for r in made if len(r[1] or "") < 20_000]
    got = period_runs.digests(period_runs.find_runs(spark.createDataFrame(few, SCHEMA), rewrite=True)).collect()
    assert Counter(map(tuple, got)) == Counter(run_row(r[0], r[1]) for r in few)
    plain = period_runs.digests(period_runs.find_runs(spark.createDataFrame(few, SCHEMA))).collect()
    assert Counter(map(tuple, plain)) == Counter(run_row(r[0], r[1], False) for r in few)
    assert period_runs.find_runs(docs.limit(0)).count() == 0
    long_text = " ".join(f"w{i % 7001}" for i in range(200_000))
    one = period_runs.find_runs(spark.createDataFrame([(1, long_text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in one.runs] == [(0, 200_000, 7001)] and one.collapsed == " ".join(f"w{i}" for i in range(7001))


def test_op12_on_the_documents_table(spark):
    made = [(r.doc_id, r.text) for r in common.table(spark, SMALL, "documents").collect()]
    want = Counter(run_row(*r) for r in made)
    assert Counter(map(tuple, period_runs.op12_period_runs(spark, SMALL).collect())) == want
    assert sum(r[1] > 0 for r in want) > 10


# -- 13 ranked search

_TERM13 = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def ranked(made, items, top=20):
    bags = [(r[0], Counter(re.findall(_TERM13, lower(r[1])))) for r in made]
    n_docs, total = sum(bool(b) for _, b in bags), max(1, sum(b.total() for _, b in bags))
    df = Counter(t for _, b in bags for t in b)
    out = []
    for i, text in sorted(set(items), key=str):
        found = []
        own = Counter(re.findall(_TERM13, lower(text)))
        for doc_id, b in bags:
            m = 75 + 25 * b.total() * n_docs // total
            s = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 12 * m)) for t, c in own.items() if b[t])
            if s > 0:
                found.append((-s, doc_id is None, doc_id or 0))
        out += [(i, k + 1, None if f[1] else f[2], -f[0]) for k, f in enumerate(sorted(found)[:top])]
    return Counter(out)


@pytest.mark.parametrize("top,block_bytes", [(20, lexical_search.BLOCK_BYTES), (3, 300)])
def test_ranked_search(frames, top, block_bytes):
    docs, made, items = frames
    items = items.filter("item_id != 4 and item_id is not null")
    own = [(r[0], r[1]) for r in item_rows() if r[0] not in (4, None)]
    got = lexical_search.search(docs, items, top, block_bytes).select("item_id", "rank", "doc_id", "score").collect()
    assert Counter(map(tuple, got)) == ranked(made, own, top)


def test_large_classes_and_ties(spark):
    """Classes of many members, of equal scores, and with repeated and null ids; a third of all rows is one class."""
    made = [(i, "alpha beta " + "pad " * 3) for i in range(400, 0, -1)] + [(i % 50, f"alpha beta q{i % 9} r s") for i in range(400)]
    made += [(None, "alpha alpha beta beta gamma"), (None, "alpha x x x x"), (7, "alpha alpha"), (7, "ALPHA alpha"), (1, None), (2, "")]
    items = [(0, "alpha beta"), (1, "gamma"), (2, "nothing here"), (3, "beta beta pad"), (4, "alpha")]
    docs, wanted = spark.createDataFrame(made, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = lexical_search.search(docs, wanted).select("item_id", "rank", "doc_id", "score").collect()
    assert Counter(map(tuple, got)) == ranked(made, items)
    assert lexical_search.search(docs.limit(0), wanted).count() == 0
    assert lexical_search.search(docs, wanted.limit(0)).count() == 0
