"""The corpus operators against brute force, on small tables with awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from feedrank.llm import (
    common, components, exact_dedup, hashing, jaccard_join, lm_score, mixing, pii, quality_rules, queries, sharding,
    sp_codec, suffix_dedup, token_binary,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, check string, bucket int, key string"
_RANDOM = random.Random(7)
_SYLLABLES = "th er ing on an re ou la del mente été ß".split()


def prose(n: int, seed: int) -> str:
    own = random.Random(seed)
    words = ["".join(own.choices(_SYLLABLES, k=own.randint(1, 3))) for _ in range(n)]
    return "".join(w + own.choice([" ", " ", " ", ", ", ".\n"]) for w in words)


def rows() -> list[tuple]:
    """Nulls, empty and very long texts, copies, near copies, shared passages, repeated rows, clashing columns."""
    base = [prose(120, i) for i in range(24)]
    passage = prose(70, 99)
    near = base[0].split(" ")
    near[40] = "changed"
    texts = [None, "", "  \n\t ", "x", "one two three", prose(30_000, 5), "ab" * 1_500, "tok " * 900, *base,
             base[1], base[1], base[1] + " ", " ".join(near), passage + base[2], base[3] + passage, base[4] + passage + base[4],
             "é" * 300 + base[5], "#$% " * 60, "line one is here\n" * 40, "w▁x  y  z <|endoftext|> Á"]
    out = [(i, t, "en", None if i % 11 == 0 else f"s{i % 3}", 0, "c", i, "k") for i, t in enumerate(texts)]
    out += [out[9], out[9], (None, base[6], "en", "s0", 0, "c", 0, "k"), (7, base[7] + "tie", "en", "s1", 0, "c", 0, "k")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def raw(text) -> bytes:
    return (text or "").encode()


# -- 1 quality rules


def base_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {k for i in range(len(words) - 7) if runs[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_base_counts_and_verdicts(spark, docs, nothing):
    labels = spark.createDataFrame([(None, 0, 0), (3, 5, 0), (10, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_rules.judge(docs, labels).collect()
    want = Counter((r[0], base_counts(r[1])) for r in rows())
    assert Counter((r.doc_id, tuple(r[1:6])) for r in got) == want
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in got)
    assert all(r.kept == (not r.base_failed) for r in got)  # such labels teach no rule
    assert quality_rules.judge(nothing, labels).count() == 0


def test_rules_find_what_labels_show(spark):
    made = [(i, i % 4 == 0, {"symbols": 1.0 if i % 8 == 0 else 0.0, "word_length": 9.0 if i % 8 == 4 else 4.0}) for i in range(400)]
    frame = spark.createDataFrame(
        [(i, low, *[v.get(f, (i % 7) / 7) for f in quality_rules.FEATURES]) for i, low, v in made],
        "doc_id long, low boolean, " + ", ".join(f"{f} double" for f in quality_rules.FEATURES))
    rules = quality_rules.learn(frame)
    judged = frame.withColumn("rule", quality_rules.verdict(rules)).collect()
    assert len(rules) == 2 and all((r.rule > 0) == r.low for r in judged)


def test_held_out_accuracy(spark):
    """The rules learned from half of the labels, on the other half."""
    sf = "/root/testdata/sf0.01"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    got = quality_rules.judge(docs, labels.filter("doc_id % 2 = 0"))
    told = got.join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("not base_failed").collect()
    low, good = [r for r in told if r.quality == 0], [r for r in told if r.quality == 1]
    assert sum(r.kept for r in good) >= 0.99 * len(good) and sum(not r.kept for r in low) >= 0.8 * len(low)


# -- 2 language model


def test_counts_of_the_base_model(docs, nothing):
    got = lm_score.score(docs).collect()
    tokens = lambda t: raw(t).lower().split() + [None]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter(w for r in rows() if not out(r[0]) for w in tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    want = defaultdict(list)
    for r in rows():
        own = tokens(r[1])
        want[r[0]].append((out(r[0]), len(own), sum(counts[w] > 0 for w in own), n,
                           round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), 4)))
    found = defaultdict(list)
    for r in got:
        found[r.doc_id].append((r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)))
        assert math.isfinite(r.score) and r.score < 0
    assert {k: sorted(x) for k, x in found.items()} == {k: sorted(x) for k, x in want.items()}
    assert lm_score.score(nothing).count() == 0


def test_gradients_and_windows():
    rng = np.random.default_rng(0)
    flat = lm_score.Model.fresh(np.zeros(lm_score.CLASSES))
    inputs, goals = rng.integers(0, lm_score.CLASSES, (3, 32)), rng.integers(3, lm_score.CLASSES, (3, 16))
    counted = np.ones((3, 16), bool)
    grad = lm_score.Model(flat).gradient(inputs, goals, counted)
    for i in rng.integers(0, len(flat), 40):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-2
        down[i] -= 1e-2
        slope = (lm_score.Model(down).log_probs(inputs, goals).mean() - lm_score.Model(up).log_probs(inputs, goals).mean()) / 2e-2
        assert abs(slope - grad[i]) < 2e-3
    whole = lm_score.Model(flat).forward(inputs)
    assert np.allclose(np.exp(whole).sum(axis=1), 1, atol=1e-4)
    assert np.allclose(whole[np.arange(48), goals.ravel()], lm_score.Model(flat).log_probs(inputs, goals), atol=1e-4)
    # Later inputs never change a target's probability.
    later = inputs.copy()
    later[:, 24:] = 5
    a, b = (lm_score.Model(flat).log_probs(x, goals).reshape(3, 16)[:, :8] for x in (inputs, later))
    assert np.allclose(a, b, atol=1e-5)


def test_training_beats_the_prior(spark):
    training = [prose(200, i).encode() for i in range(60)]
    pieces = lm_score._pieces(sp_codec.model_path())
    counts = np.zeros(pieces.get_piece_size())
    for t in training:
        for ids in pieces.encode([w.decode() for w in t.split()]):
            np.add.at(counts, ids, 1)
    vocabulary = lm_score.Vocabulary(counts)
    kinds = np.bincount(vocabulary.kind, (counts + 1) / 1, lm_score.CLASSES)
    assert np.allclose(np.bincount(vocabulary.kind, 10**vocabulary.share, lm_score.CLASSES)[kinds > 0], 1)
    start = lm_score.Model.fresh(vocabulary.prior(counts, 60))
    done = lm_score.train(start, lm_score._windows(training[:50], vocabulary, pieces), 1)
    held = lm_score._windows(training[50:], vocabulary, pieces)
    goals, good = np.maximum(held[:, 17:], 0), held[:, 17:] >= 2
    score = lambda f: (lm_score.Model(f).log_probs(np.maximum(held[:, :32], 0), goals).reshape(goals.shape) * good).sum()
    assert score(done) > score(start)


def test_held_out_texts_are_likelier_than_by_the_base_model(spark):
    rows_ = lm_score.op2_lm_scoring(spark, "/root/testdata/sf0.01").filter("held_out").collect()
    tokens = sum(r.n_tokens for r in rows_)
    assert sum(r.score for r in rows_) / tokens > sum(r.base_score for r in rows_) / tokens + 0.1


def test_scores_of_whole_texts(docs):
    """The score from its parts: full forward passes over subword classes, word by word."""
    training = docs.filter(~lm_score.held_out())
    counts = {r.word: r.n for r in lm_score.word_counts(training.select(common.whole_text().alias("text"))).collect()}
    n_docs = training.count()
    n, once = sum(counts.values()) + n_docs, sum(c == 1 for c in counts.values())
    novel = (once + 1) / (n + 2)
    frozen = lm_score.fit(training.select(common.whole_text().alias("text")), lm_score.word_counts(training.select(common.whole_text().alias("text"))), n_docs)
    flat, vocabulary = frozen
    model, pieces = lm_score.Model(flat), lm_score._pieces(sp_codec.model_path())
    own_fit, lm_score.fit = lm_score.fit, lambda *_: frozen
    try:
        got = {(r.doc_id, r.n_tokens): r.score for r in lm_score.score(docs).collect()}
    finally:
        lm_score.fit = own_fit
    for doc_id, text in [(r[0], r[1]) for r in rows() if r[0] in (3, 4, 9, 12, 20)]:
        words = raw(text).lower().split()
        coded = [pieces.encode(w.decode()) for w in words]
        line = [lm_score.START] + [int(vocabulary.kind[i]) for c in coded for i in c] + [lm_score.END]
        logs = []
        for k in range(1, len(line)):  # the window of a target: its block's inputs and the STEP before
            block = (k - 1) // lm_score.STEP * lm_score.STEP
            padded = [lm_score.PAD] * lm_score.STEP + line
            window = padded[block : block + lm_score.SPAN]
            window = [c if place <= k - 1 - block + lm_score.STEP else lm_score.PAD for place, c in enumerate(window + [0] * (lm_score.SPAN - len(window)))]
            logs.append(model.forward(np.array([window]))[(k - 1) % lm_score.STEP, line[k]])
        total, at = 0.0, 0
        for w, c in [*zip(words, coded), (None, [None])]:
            by_model = sum(logs[at : at + len(c)]) + (sum(vocabulary.share[i] for i in c) * math.log(10) if w is not None else 0)
            at += len(c)
            seen = n_docs if w is None else counts.get(w.decode(), 0)
            by_count = seen * (1 - novel) / n if seen else novel
            total += math.log10(lm_score.ATTENTION * math.exp(by_model) + (1 - lm_score.ATTENTION) * by_count)
        assert abs(got[doc_id, len(words) + 1] - total) < 1e-3 * max(1, abs(total))


def test_training_meets_every_target(monkeypatch):
    pieces = lm_score._pieces(sp_codec.model_path())
    texts = [prose(n, n).encode() for n in (3, 40, 1_000)] + [b"", b"  ", b"tok " * 500]
    vocabulary = lm_score.Vocabulary(np.zeros(pieces.get_piece_size()))
    windows = lm_score._windows(texts, vocabulary, pieces)
    lines = [[int(vocabulary.kind[i]) for w in t.lower().split() for i in pieces.encode(w.decode())] + [lm_score.END] for t in texts]
    goals = windows[:, lm_score.STEP + 1 :]
    assert goals[goals >= 0].tolist() == [k for line in lines for k in line]
    assert (windows[:, lm_score.STEP] == lm_score.START).sum() == len(texts)
    met, gradient = [], lm_score.Model.gradient
    monkeypatch.setattr(lm_score, "LEAST_STEPS", 1)
    monkeypatch.setattr(lm_score.Model, "gradient", lambda m, i, t, counted: met.append(counted.sum()) or gradient(m, i, t, counted))
    start = lm_score.Model.fresh(vocabulary.prior(np.zeros(pieces.get_piece_size()), 6))
    lm_score.train(start, iter([windows[:9], windows[9:]]), 1)
    assert sum(met) == sum(map(len, lines))


def test_tasks_of_a_worker_code_a_word_once(monkeypatch):
    """Learning and scoring the same texts, batch by batch, codes each distinct word once, as a direct split would."""
    true, met = lm_score._pieces(sp_codec.model_path()), []

    class Counting:
        def encode(self, words, num_threads=1):
            met.extend(words)
            return true.encode(words, num_threads=num_threads)

    monkeypatch.setattr(lm_score, "_pieces", lambda _: Counting())
    lm_score._coded.cache_clear()
    texts = [prose(80, i) for i in range(6)] + [" A b\x0b\x0cC\t", "", "x", None, " \n ", "\u00c9 b\x1cz \u00c9\u00a0q"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([False] * len(texts)), pa.array(texts)], ["doc_id", "held_out", "text"])
    counts = np.zeros(true.get_piece_size())
    vocabulary = lm_score.Vocabulary(counts)
    flat = lm_score.Model.fresh(vocabulary.prior(counts, len(texts)))
    list(lm_score._train_rows(flat, vocabulary, "here", 0)(iter([batch.slice(0, 7).select(["text"]), batch.select(["text"])])))
    rows_ = list(lm_score._score(flat, vocabulary, (np.zeros(0, np.uint64), np.zeros(0)), 3, 50, 0.1, "here")(iter([batch])))
    split = [(t or "").encode().lower().split() for t in texts]
    assert Counter(met) == Counter({w.decode() for words in split for w in words})
    assert rows_[0].column("n_tokens").to_pylist() == [len(words) + 1 for words in split]
    monkeypatch.setattr(lm_score, "CACHED_WORDS", 5)  # a full store is emptied, and gives the same ids
    small, words = lm_score.Coded(true), sorted({w.decode() for t in split for w in t})
    for part in (words[:4], words[2:9], words, words[:1], []):
        hashes = hashing.mix(np.array([words.index(w) for w in part], np.uint64))
        ids, sizes = small.get(pa.array(part, pa.string()), hashes)
        assert np.split(ids, np.cumsum(sizes)[:-1])[0].tolist() == (true.encode(part)[0] if part else [])
        assert ids.tolist() == [i for w in part for i in true.encode(w)]
    lm_score._coded.cache_clear()


def test_sums_by_class_and_steep_weights():
    rng = np.random.default_rng(3)
    classes = rng.integers(0, 40, (9, 32)) ** 2 % lm_score.CLASSES
    rows_ = np.concatenate([rng.normal(0, 1, (classes.size, 5)), np.zeros((1, 5))]).astype(np.float32)
    want = np.zeros((lm_score.CLASSES, 5))
    np.add.at(want, classes.ravel(), rows_[:-1])
    assert np.allclose(lm_score._sums(classes, rows_), want, atol=1e-4)
    flat = lm_score.Model.fresh(np.zeros(lm_score.CLASSES))
    inputs, goals = rng.integers(1, lm_score.CLASSES, (5, 32)), rng.integers(3, lm_score.CLASSES, (5, 16))
    inputs[:2, :16] = lm_score.PAD
    steep = lm_score.Model(flat * np.float32(12))  # plain exponentials overflow
    assert np.isfinite(steep.gradient(inputs, goals, np.ones((5, 16), bool))).all()
    # What a pad holds changes nothing, and learns nothing.
    model, other = lm_score.Model(flat), flat.copy()
    other[: lm_score.WIDTH] = 9
    assert np.allclose(model.log_probs(inputs, goals), lm_score.Model(other).log_probs(inputs, goals), atol=1e-5)
    assert not model.gradient(inputs, goals, np.ones((5, 16), bool))[: lm_score.WIDTH].any()


@pytest.mark.parametrize("most", [0, 40])
def test_hot_words_change_no_score(docs, monkeypatch, most):
    """Counts that are joined give the scores that counts in the task give."""
    weights = lm_score.fit(docs.filter("not (doc_id <=> 5)"), lm_score.word_counts(docs), 40)
    monkeypatch.setattr(lm_score, "fit", lambda *_: weights)
    told = lambda: sorted((r.doc_id or -1, r.n_tokens, round(r.base_score, 4), round(r.score, 4)) for r in lm_score.score(docs).collect())
    want = told()
    monkeypatch.setattr(lm_score, "HOT_WORDS", most)
    assert np.allclose(told(), want, atol=1e-3)


# -- 3 sharding, 10 mixing


def test_shards_follow_the_mixture(docs, nothing):
    got = sharding.interleave(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (r[0], len(raw(r[1])) + 8, zlib.crc32(raw(r[1]))) for r in rows())
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in shards.values()) and set(shards) == set(range(24))
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert sharding.interleave(nothing).count() == 0


def test_each_shard_holds_its_share(spark):
    frame = spark.range(4800).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"),
                                     F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 4)).alias("source"))
    got = sharding.interleave(frame).join(frame, "doc_id").groupBy("shard", "source").count().collect()
    total = Counter(r[0] for r in frame.select("source").collect())
    assert all(abs(r["count"] - total[r.source] / 24) <= 1 for r in got)
    again = sharding.interleave(frame.repartition(7)).select("doc_id", "shard", "slot").collect()
    assert sorted(again) == sorted(sharding.interleave(frame).select("doc_id", "shard", "slot").collect())


def wanted_targets(sizes):
    """By the rule itself: cap, share the excess again, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight, capped = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {}
    while True:
        free = [s for s in names if s not in capped]
        level = (sum(sizes.values()) - sum(capped.values())) / max(1, sum(weight[s] for s in free))
        over = [s for s in free if weight[s] * level > 3 * sizes[s]]
        if not over:
            return {s: capped.get(s, weight[s] * level) for s in names}
        capped.update({s: 3 * sizes[s] for s in over})


def test_mix_meets_its_targets(docs, nothing):
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for r in rows():
        sizes[r[3]] += len(raw(r[1]).split())
    want = wanted_targets(sizes)
    source = {r[0]: r[3] for r in rows()}
    taken = Counter()
    for r in got:
        own = source[r.doc_id]
        assert r.source_size == sizes[own] or r.doc_id == 7
        assert r.taken <= 3 * r.size
        if r.doc_id != 7:
            assert abs(r.target - want[own]) < 1e-6 * max(1, want[own])
        taken[r.target] += r.taken
    assert sorted(r[:5] for r in got if r.doc_id is not None) == sorted(
        r[:5] for r in mixing.mix(docs.repartition(5)).collect() if r.doc_id is not None)
    assert all(abs(n - t) <= 4 * mixing.BLOCK_TOKENS for t, n in taken.items())
    assert mixing.mix(nothing).count() == 0


def test_capped_sources_and_quotas(spark):
    sizes = {"a": 10, "b": 4000, "c": 50, "d": 7, "e": 900, None: 33}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    made = mixing.apportion(mixing.targets(frame), 16)
    want = wanted_targets(sizes)
    assert all(abs(r.target - want[r.source]) < 1e-9 * max(1, want[r.source]) for r in made.collect())
    quotas = mixing.shard_quotas(made).groupBy("source").agg(F.sum("quota").alias("q"), (F.max("quota") - F.min("quota")).alias("gap"))
    seats = {r.source: r.seats for r in made.collect()}
    assert all(r.q == seats[r.source] and r.gap <= 1 for r in quotas.collect())


# -- 4 sentencepiece, 6 token files


def test_pieces_ids_and_spans(docs, nothing):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sp_codec.model_path())
    got = defaultdict(list)
    for r in sp_codec.encode_decode(docs).collect():
        got[r.doc_id].append((r.ids, r.begins, r.ends, r.decoded))
    for r in rows():
        ids = lib.encode(r[1] or "")
        mine = next(x for x in got[r[0]] if x[0] == ids)
        assert mine[3] == lib.decode(ids)
        text, at = raw(r[1]), 0
        for begin, end in zip(mine[1], mine[2]):
            assert begin == at or begin == end
            at = max(at, end)
        assert at == len(text)
    assert sp_codec.encode_decode(nothing).count() == 0


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
def test_longest_prefix_normalisation(rule):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    lib = sentencepiece.SentencePieceNormalizer(
        rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    model = pb.ModelProto()
    model.ParseFromString(lib.serialized_model_proto())
    mine = sp_codec.Normalizer(model.normalizer_spec.precompiled_charsmap, True, True)
    for _ in range(400):
        text = "".join(_RANDOM.choices(" \tabé▁ﬁｶﾞ①㎏ﷺ中́", k=_RANDOM.randint(1, 14)))
        norm, align = mine(text.encode())
        assert norm.decode() == lib.normalize(text)
        assert len(align) == len(norm) + 1 and (np.diff(align) >= 0).all() and align[-1] <= len(text.encode())


def test_token_files_hold_the_ids(docs, nothing):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(token_binary.model_path())
    want, start = [], 0
    ordered = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(raw(r[1]))))
    for r in ordered:
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids + [2]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = token_binary.round_trip(docs).collect()
    assert sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted((b, a, c, d) for a, b, c, d in want)
    assert token_binary.round_trip(nothing).count() == 0


@pytest.mark.parametrize("values", [
    [], [0], [2**63 + 5, 1, 2, 2**61, 0, 2**64 - 1] * 90, list(range(1000)), [1] * 700, [2**60 - 1, 2**60] * 200])
def test_simple8b_round_trip(values):
    ids = np.array(values, np.uint64)
    words, firsts = token_binary.pack(ids)
    assert (token_binary.unpack(words, firsts, len(ids)) == ids).all()
    content = token_binary.file_bytes([None], np.array([len(ids)]), ids)
    assert token_binary.read_file(content)[0] == [None] and (token_binary.read_file(content)[2] == ids).all()


# -- 5 surrogates

_PERSONAL = ["Mail a.b@c.org or A.B@C.org, call +1 (386) 555-3733 or 386-555-3733.", "Mrs. Anna Miller met Dr Smith. Mrs Miller left.",
             "card 4111 1111 1111 1111, host 10.1.2.3, password=hunter22x", "Госпожа Иванова и Господин Петров", None, "", "Mr. and no name, 12-34"]


def test_surrogates(spark, nothing):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(_PERSONAL)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymize(frame).collect()}
    for i, t in enumerate(_PERSONAL):
        for _, _, a, b in pii.find(t or ""):
            assert t[a:b] not in got[i].text
    mails = re.findall(r"\S+@[\w.-]+\w", got[0].text)
    assert mails[0].lower() == mails[1].lower()
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[0].text)[0][4:7] == re.search(r"(\d{3})-\d{3}-\d{4}\.", got[0].text)[1]
    names = re.findall(r"Mrs\.? ([\w ]+?)(?: met| left)", got[1].text)
    assert names[0].split()[-1] == names[1] and names[0].split()[0] in pii.GIVEN["latin", "f"]
    assert pii.luhn(re.search(r"card ([\d ]+),", got[2].text)[1].replace(" ", "")) == 0
    assert re.search("[а-я]", got[3].text) and got[4].text is None and got[5].text == "" and got[6].text == _PERSONAL[6]
    joined = {r.doc_id: r.text for r in pii.pseudonymize(frame, sent_rows=-1).collect()}
    assert joined == {i: r.text for i, r in got.items()}
    assert pii.pseudonymize(nothing).count() == 0


def test_clashing_surrogates_are_drawn_again(spark, monkeypatch):
    entities = spark.createDataFrame([("ip", f"9.9.9.{i}") for i in range(40)] + [("ip", "240.0.0.1")], "kind string, name string")
    made = pii.assign(entities).collect()
    assert len({r.surrogate for r in made}) == 41 and not {r.surrogate for r in made} & {r.name for r in made}
    few = spark.createDataFrame([("ssn", f"{i}") for i in range(6)], "kind string, name string")  # one digit: eight surrogates
    state = pii.assign(few.filter("name < '2'")).collect()
    assert len({r.surrogate for r in state}) == 2 and all(r.surrogate >= "2" for r in state)


def test_persons_without_titles(spark):
    text = ("Dr Anna Miller spoke. Mrs. Miller's paper by Anna Miller and MILLER; Miller, Peter Miller-Kurz. miller stays. "
            "Dr Smith met Mrs Smith and Smithers. Mr Peter Jones, Mr Paul Jones: Paul Jones, Jones.")
    names = [(n, text[a:b]) for k, n, a, b in pii.find(text) if k == "name"]
    anna = "f|latin|anna|miller"
    assert names[:6] == [(anna, own) for own in ("Anna Miller", "Miller", "Anna Miller", "MILLER", "Miller", "Miller")]
    assert [n for n, own in names if own == "Smith"] == ["f|latin||smith"] * 2
    assert [n for n, own in names if own == "Paul Jones"] == ["m|latin|paul|jones"] * 2
    new = pii.pseudonymize(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text
    assert not re.search(r"Anna Miller|Miller|MILLER|Smith\b|Jones|Paul", new) and "miller stays" in new and "Smithers" in new
    shown = re.match(r"Dr (\S+ (\S+)) spoke. Mrs. (\S+)'s paper by (\S+ \S+) and (\S+); (\S+), ", new).groups()
    assert shown[0] == shown[3] and {shown[1]} == {shown[2], shown[5], shown[4].capitalize()}


def test_full_names_stay_apart(spark):
    rows_ = [(i, f"{title} {given}{i} Smith".replace(str(i), "abcdefghijklmnopqrstuvwxyz"[i])) for i in range(26) for title, given in [("Mr", "Pe")]]
    rows_ += [(100 + i, f"Κύριος {'αβγδεζηθικλμ'[i].upper()}νν Παππ") for i in range(12)] + [(200 + i, f"Dr {'ΑΒΓΔΕΖΗΘ'[i]}νν Παππ") for i in range(8)]
    got = [r.text for r in pii.pseudonymize(spark.createDataFrame(rows_, "doc_id long, text string")).collect()]
    assert len(set(got)) == len(rows_)
    assert len({t.split()[-1] for t in got}) == 2  # one family name each for Smith and Παππ


# -- 7 exact, 8 passages, 9 near duplicates


def test_exact_copies(docs, nothing):
    got = exact_dedup.find_copies(docs, bucket_bytes=2_000).collect()
    groups = defaultdict(list)
    for r in rows():
        groups[r[1] or ""].append(r[0])
    for r in got:
        own = next(v for k, v in groups.items() if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        keep = max((i for i in own if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(own), r.doc_id == keep)
    assert len(got) == len(rows()) and exact_dedup.find_copies(nothing).count() == 0


def test_directory_splits_and_doubles(spark):
    keys = spark.range(4000).select(F.xxhash64("id").alias("key"), F.lit(10).cast("long").alias("bytes"))
    directory, depth = exact_dedup.build_directory(keys, 4_000)
    assert depth >= 4 and directory.count() == 2**depth
    load = keys.withColumn("slot", common.key_bucket(F.col("key"), depth)).join(directory, "slot").groupBy("bucket").agg(F.sum("bytes").alias("b"))
    assert load.agg(F.max("b")).first()[0] <= 4_000
    same = spark.range(500).select(F.lit(5).cast("long").alias("key"), F.lit(10).cast("long").alias("bytes"))
    assert exact_dedup.build_directory(same, 100)[1] == exact_dedup.MOST_BITS


def test_exact_sql_gives_the_same(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.execute(exact_dedup.OP7_SQL).fetchall()
    names = [c[0] for c in con.description]
    got = exact_dedup.op7_exact_dedup(spark, "/root/testdata/sf0.001").select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def removed(texts):
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        cover = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                cover[i : i + 200] = True
        edges = np.diff(np.concatenate([[0], cover.astype(int), [0]]))
        out.append((len(t), int(cover.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~cover].tobytes()).hexdigest()))
    return out


def test_repeated_passages(spark, docs, nothing):
    texts = [(r[0], raw(r[1])) for r in rows()]
    want = Counter((i, *x) for (i, _), x in zip(texts, removed([t for _, t in texts])))
    assert Counter(map(tuple, suffix_dedup.digests(suffix_dedup.remove_repeats(docs)).collect())) == want
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_passages_of_few_letters(spark):
    """Periodic texts and near periods, where one run holds its own repeats."""
    own = random.Random(3)
    texts = ["ab" * 150 + "c" + "ab" * 130, "a" * 450, "b" * 199, "b" * 200, "xyz" * 100 + "q" + "xyz" * 90]
    texts += ["".join(own.choices("ab", k=40)) * own.randint(4, 12) + "".join(own.choices("ab", k=300)) for _ in range(12)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {(i, *x) for i, x in enumerate(removed([t.encode() for t in texts]))}
    assert set(map(tuple, suffix_dedup.digests(suffix_dedup.remove_repeats(frame)).collect())) == want


@pytest.mark.parametrize("period", [168, 169, 170])
def test_periods_about_the_grams_of_a_string(spark, period):
    """Lines of as many bytes as a string has q-grams, alone and in two documents of different length."""
    line = lambda seed: "".join(random.Random(seed).choices("abcdefgh ", k=period - 1)) + "\n"
    for texts in ([line(1) * 5], [prose(60, 3) + line(2) * 4 + prose(60, 4), line(2)[50:] + line(2) * 9]):
        frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        want = {(i, *x) for i, x in enumerate(removed([t.encode() for t in texts]))}
        assert set(map(tuple, suffix_dedup.digests(suffix_dedup.remove_repeats(frame)).collect())) == want


def test_personal_data_in_many_forms(spark):
    """Numbers beside other numbers, titles in capitals, unseparated phones, IPv6, tokens: nothing stays in clear."""
    secret = {
        "card": ("id 12 4111 1111 1111 1111 end", "4111 1111"), "caps": ("by DR ANNA MILLER today", "MILLER"),
        "phone": ("mail +4915112345678 now", "15112345678"), "tel": ("Tel: 5551234567.", "5551234567"),
        "v6": ("host 2001:4860:4860::8888 up", "4860"), "git": ("ghp_" + "a1B2" * 9 + " x", "a1B2a1B2"), "pay": ("k sk_live_" + "Zz09" * 5, "Zz09Zz09"),
        "code": ("+49 301 234 5678", "234 5678"),
    }
    clean = ["at 10:20:30 on 12 12 2024", "order 1234567890123456 1", "a:b::c", "the ratio 3:4", "5551234567 parts", "tel aviv 12"]
    rows_ = [(i, t) for i, (t, _) in enumerate(secret.values())] + [(100 + i, t) for i, t in enumerate(clean)]
    frame = spark.createDataFrame([(i, t, "x", 1, "k") for i, t in rows_], "doc_id long, text string, name string, attempt int, kind string")
    got = {r.doc_id: r.text for r in pii.pseudonymize(frame).collect()}
    assert all(left not in got[i] and got[i] != t for i, (t, left) in enumerate(secret.values()))
    assert [got[100 + i] for i in range(len(clean))] == clean
    assert got[0].startswith("id 12 ") and pii.luhn(re.sub(r"\D", "", got[0])[2:]) == 0
    assert got[7].startswith("+49 ") and got[1].startswith("by DR ") and got[1].split()[2].isupper()
    assert got[5].startswith("ghp_") and "sk_live_" in got[6]
    one = pii.pseudonymize(frame, b"one").collect()
    assert one == pii.pseudonymize(frame, b"one").collect() and one != pii.pseudonymize(frame, b"two").collect()
    many = " ".join(f"u{i}@host{i}.org" for i in range(20_000))  # a very long text
    assert len(pii.find(many)) == 20_000


def shingles(text):
    w = raw(text).split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_duplicates(spark, nothing):
    base = prose(150, 1).split()
    made = [(i, t) for i, t in enumerate([None, "", "x", "x", "one two three", "one two three", "one two four"])]
    own = random.Random(11)
    for i in range(7, 90):
        words = list(base) if i % 2 else prose(60 + i, i // 8).split()
        for _ in range(own.randint(0, 6)):
            words[own.randrange(len(words))] = f"w{own.randint(0, 9)}"
        made.append((i, " ".join(words)))
    frame = spark.createDataFrame([*made, made[9], (None, made[10][1])], "doc_id long, text string")
    got = jaccard_join.near_duplicates(frame).filter("doc_id is not null").dropDuplicates(["doc_id"]).collect()
    sets = {i: shingles(t) for i, t in made}
    distinct = set(sets.values())
    near = lambda a, b: a != b and a and b and 5 * len(a & b) >= 4 * len(a | b)
    links = {s: {t for t in distinct if near(s, t)} for s in distinct}
    for r in got:
        own_set, todo, group = sets[r.doc_id], [sets[r.doc_id]], {sets[r.doc_id]}
        while todo:
            new = links[todo.pop()] - group
            group |= new
            todo += new
        assert r.class_id == min(i for i, s in sets.items() if s in group)
        assert r.n_links == len(links[own_set])
    assert max(r.n_links for r in got) > 5
    assert jaccard_join.near_duplicates(nothing).count() == 0


def test_an_id_with_two_texts_keeps_all_links(spark):
    """doc 7 stands with texts A and B; 9 is near A, 11 near B. Extra columns clash, one text is very long."""
    a, b, huge = prose(90, 1).split(), prose(90, 2).split(), prose(60_000, 3)
    change = lambda w: " ".join([*w[:40], "other", *w[41:]])
    made = [(7, " ".join(a)), (7, " ".join(b)), (9, change(a)), (11, change(b)), (12, huge), (13, huge + " end"), (14, None), (None, change(a) + " x")]
    frame = spark.createDataFrame([(i, t, "n", 1, 2, "r", 3) for i, t in made],
                                  "doc_id long, text string, node string, high long, count long, root string, check long")
    got = [(r.doc_id, r.class_id, r.n_links) for r in jaccard_join.near_duplicates(frame).collect()]
    assert sorted(got, key=str) == sorted(
        [(7, 7, 2), (7, 7, 1), (9, 7, 2), (11, 7, 1), (12, 12, 1), (13, 12, 1), (14, 14, 0), (None, 7, 2)], key=str)


def test_a_third_of_all_rows_in_one_group(spark):
    """Near copies of one text, a third of the rows, all counted."""
    own = random.Random(2)
    base = [f"b{i}" for i in range(300)]

    def near(k):
        words = list(base)
        words[own.randrange(300)] = f"x{k}"
        return " ".join(words)

    rows_ = [(k, near(k)) if k % 3 == 0 else (k, " ".join(f"{k}w{j}" for j in range(8))) for k in range(3_000)]
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows_, "doc_id long, text string")).collect()
    sets = {shingles(t) for k, t in rows_ if k % 3 == 0}
    assert all((r.class_id, r.n_links) == ((0, len(sets) - 1) if r.doc_id % 3 == 0 else (r.doc_id, 0)) for r in got)


def test_recall_of_the_prefixes():
    depth = jaccard_join.prefix_depth(0.8)
    assert 1 - (1 - 0.8**depth) ** jaccard_join.TREES >= jaccard_join.RECALL > 1 - (1 - 0.8 ** (depth + 1)) ** jaccard_join.TREES


def test_forest_joins_what_signatures_estimate(spark):
    """Groups of candidates are those that comparing all signatures of shared prefixes gives, whichever nodes are closed."""
    own = np.random.default_rng(4)
    prefix, frame = jaccard_join.prefix_depth(0.8), []
    base = own.integers(0, 256, (6, 192))
    for k in range(240):
        labels = np.where(own.random(192) < own.uniform(0, 0.4), own.integers(0, 256, 192), base[k % 6]).astype(np.uint8)
        trees = labels.reshape(jaccard_join.TREES, jaccard_join.DEPTH)[:, :prefix]
        keys = [int.from_bytes(hashlib.sha256(bytes([t]) + tree.tobytes()).digest()[:8], "big", signed=True) for t, tree in enumerate(trees)]
        frame.append((k, bytearray(labels.tobytes()), keys))
    root = np.arange(len(frame))
    table = np.array([np.frombuffer(bytes(r[1]), np.uint8) for r in frame])
    keyed = np.array([r[2] for r in frame])
    while True:
        before = root.copy()
        for i in range(len(frame)):
            met = (keyed == keyed[i]).any(axis=1) & ((table == table[i]).sum(axis=1) >= int(jaccard_join.LEAST_ESTIMATE * 192))
            root[met] = root[met].min()
        if (before == root).all():
            break
    nodes = spark.createDataFrame(frame, "node long, labels binary, keys array<long>")
    got = {r.node: r.root for r in jaccard_join.candidates(nodes).collect()}
    sizes = Counter(root.tolist())
    assert got == {k: int(r) for k, r in enumerate(root) if sizes[r] > 1}
    assert 10 < len(got) and len(set(got.values())) > 1


def test_recall_against_brute_force(spark):
    """Every text against all texts of a whole table: all links are counted."""
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    counted = {r.doc_id: r.n_links for r in jaccard_join.near_duplicates(docs).collect()}
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    holders = defaultdict(list)
    for s in set(sets.values()):
        for x in s:
            holders[x].append(s)
    links = {}
    for i in sets:
        met = Counter(id(t) for x in sets[i] for t in holders[x])
        by_id = {id(t): t for x in sets[i] for t in holders[x]}
        links[i] = sum(5 * n >= 4 * (len(sets[i]) + len(by_id[k]) - n) for k, n in met.items() if by_id[k] != sets[i])
    assert sum(links.values()) > 0 and counted == links


def test_seats_fill_the_quotas_of_the_shards(spark):
    for seats, shards in ((1, 24), (23, 24), (24, 24), (1000, 24), (77, 5)):
        frame = spark.createDataFrame([(None, seats)], "source string, seats long")
        quotas = {r.shard: r.quota for r in mixing.shard_quotas(frame, shards).collect() if r.quota}
        dealt = spark.range(seats).select(mixing.shard_of(F.col("id"), F.lit(seats), shards).alias("s")).groupBy("s").count()
        assert {r.s: r["count"] for r in dealt.collect()} == quotas
    blocks = (1 << 33) + 5
    place = spark.range(1).select(mixing._place(F.lit(blocks - 2), F.lit(blocks), F.lit(11).cast("long")).alias("p")).first().p
    assert place == ((blocks - 2) * mixing._PRIMES[0] + 11) % blocks


def test_components(spark):
    edges = [(i + 1, i) for i in range(60)] + [(200 + i, 200) for i in range(1, 50)] + [(301, 300)]
    frame = spark.createDataFrame(edges, "a long, b long")
    roots = {r.node: r.root for r in components.components(frame, "test-components").collect()}
    assert roots == {**{i: 0 for i in range(61)}, **{200 + i: 200 for i in range(50)}, 300: 300, 301: 300}


def test_components_around_hubs(spark):
    """Hubs whose edges are broadcast, in a chain, beside a long path."""
    edges = [(1_000 * h + i, 1_000 * h) for h in range(1, 5) for i in range(1, 400)]
    edges += [(1_000 * (h + 1) + 7, 1_000 * h + 9) for h in range(1, 4)] + [(9_000 + i, 9_001 + i) for i in range(50)]
    frame = spark.createDataFrame([(max(e), min(e)) for e in edges], "a long, b long")
    roots = {r.node: r.root for r in components.components(frame, "test-components").collect()}
    assert roots == {**{1_000 * h + i: 1_000 for h in range(1, 5) for i in range(400)}, **{9_000 + i: 9_000 for i in range(51)}}


def test_equal_spans_have_equal_hashes():
    data = np.frombuffer(b"abcabcabd" * 5, np.uint8)
    sums = hashing.prefix_sums(data)
    grams = hashing.windows(sums, 3)
    seen = {}
    for i, h in enumerate(grams):
        assert seen.setdefault(bytes(data[i : i + 3]), h) == h
    assert len(set(seen.values())) == len(seen)


# -- pipeline and registration


def test_pipeline_stages(spark, docs, nothing):
    sf, now = "/root/testdata/sf0.001", docs
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, now = now, stage(spark, now, sf).cache()
        if k < 4:
            assert now.columns == columns
        if k == 0:
            assert now.count() and all(len((r.text or "").split()) >= 20 for r in now.collect())
        if k == 1:
            assert sorted(r.text for r in now.collect()) == sorted({r.text for r in before.collect()})
        if k == 2:
            # One document stays of each class that links at the threshold join, by brute force; texts without words are one class.
            sets = {shingles(r.text) for r in before.collect()}
            left = [shingles(r.text) for r in now.collect()]
            classes, todo = [], set(sets)
            while todo:
                group, front = set(), [todo.pop()]
                while front:
                    group.add(own := front.pop())
                    linked = {t for t in todo if 5 * len(own & t) >= 4 * len(own | t)}
                    todo -= linked
                    front += linked
                classes.append(group)
            assert len(left) == len(classes) and all(sum(x in group for x in left) == 1 for group in classes)
        if k == 3:
            times = Counter(r.text for r in now.collect())
            assert max(times.values()) <= 3 and set(times) <= {r.text for r in before.collect()}
        if k == 4:
            assert now.count() == before.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, sf).count() == 0


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op13_lexical_search"}))  # op13 returns rows of items
def test_registered_queries_return_every_document(spark, name):
    sf = "/root/testdata/sf0.001"
    df = queries.QUERIES[name][0](spark, sf)
    assert "doc_id" in df.columns and df.count() == common.table(spark, sf, "documents").count()
