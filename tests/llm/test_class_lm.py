from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_docs import make_docs  # noqa: F401
from pyspark.sql import functions as F

from branchlore.llm import class_lm


def tokens(text: str | None) -> list[str]:
    small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", small) + [None]


def held_out(doc) -> bool:
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 7 == 2


def slow_base(rows: list[tuple]) -> list[tuple]:
    counts = Counter(t for doc, text in rows if not held_out(doc) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    out = []
    for doc, text in rows:
        ts = tokens(text)
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts)
        out.append((doc, held_out(doc), len(ts), sum(counts[t] > 0 for t in ts), n, round(base, 6)))
    return sorted(out, key=str)


def sentences(rng: random.Random, n: int) -> str:
    """Words of three kinds that follow each other in a fixed order."""
    kinds = [[f"{k}{i}" for i in range(30)] for k in ("det", "Noun", "VERB")]
    return " ".join(rng.choice(kinds[i % 3]) for i in range(n))


def sample(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    rows = [(None, "A a"), (1, None), (2, ""), (3, " \x85x \n"), (9, "neverseen " * 3)]
    rows += [(i, sentences(rng, rng.choice([1, 9, 90])) + rng.choice(["", f" rare{i}", " İ É é"])) for i in range(10, 150)]
    return rows + rows[-4:] + [(800, sentences(rng, 30_000) + " " + "x" * 100 + " end")]


@pytest.mark.parametrize("dictionary", [class_lm.DICTIONARY, 60, 0])
def test_base_scores_equal_brute_force(make_docs, monkeypatch, dictionary):
    monkeypatch.setattr(class_lm, "DICTIONARY", dictionary)
    rows = sample()
    got = class_lm.score(make_docs(*rows), rounds=1).collect()
    found = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got]
    assert sorted(found, key=str) == slow_base(rows)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


@pytest.mark.parametrize("dictionary", [class_lm.DICTIONARY, 60, 0])
def test_scores_equal_a_plain_model_with_the_same_classes(make_docs, spark, monkeypatch, dictionary):
    monkeypatch.setattr(class_lm, "DICTIONARY", dictionary)
    rows = sample(3)
    made = []
    real = class_lm.exchange
    monkeypatch.setattr(class_lm, "exchange", lambda *given: made.append(real(*given)) or made[-1])
    got = {r.doc_id: r.score for r in class_lm.score(make_docs(*rows), rounds=2).collect()}
    learnt = [(doc, text) for doc, text in rows if not held_out(doc)]
    words = class_lm.count_words(spark.createDataFrame([(t or "",) for _, t in learnt], "text string")).cache()
    frequent = class_lm.most_frequent(words, dictionary)[0]
    classes = {r.code: r.cls for r in made[0][0].table.collect()}
    code = {r.word.decode(): r.code for r in words.select("word", class_lm.rare_code(F.col("word"), 0).alias("code")).collect()}
    code |= {w.decode(): i for i, w in enumerate(frequent)}
    end, unknown = class_lm.CLASSES, class_lm.CLASSES + 1
    counts = Counter(t for _, text in learnt for t in tokens(text))
    assert any(n == 1 for n in counts.values()) and any(t not in counts for doc, text in rows for t in tokens(text))
    cls = lambda t: end if t is None else classes[code[t]] if t in counts else unknown
    pairs, of, after_once, before_once = Counter(), Counter(), Counter(), Counter()
    for _, text in learnt:
        seq = [None, *tokens(text)]
        for a, b in zip(seq, seq[1:]):
            pairs[cls(a), cls(b)] += 1
            of[cls(b)] += 1
            after_once[cls(b)] += a is not None and counts[a] == 1
            before_once[cls(a)] += b is not None and counts[b] == 1
    before = Counter()
    for (a, _), n in pairs.items():
        before[a] += n
    total, k = sum(of.values()), class_lm.N_CLASSES
    new = (sum(n == 1 for t, n in counts.items() if t) + 1) / (total + 2)
    for doc, text in rows:
        want, last = 0.0, end
        for t in tokens(text):
            c, alone = cls(t), (of[cls(t)] + 1) / (total + k)
            seen, n = (sum(after_once.values()), after_once[c]) if last == unknown else (before[last], pairs[last, c])
            unseen = new if last == unknown else (before_once[last] + k * new) / (seen + k)
            if c == unknown:
                want += math.log10(unseen / (len(counts) + 1))
            else:
                want += math.log10((1 - unseen) * (n + k * alone) / (seen + k) * (1 if c == end else counts[t] / of[c]))
            last = c
        assert got[doc] == pytest.approx(want, abs=1e-6)


def test_class_probabilities_add_up_to_one_at_most():
    rng = np.random.default_rng(1)
    k = class_lm.N_CLASSES
    pairs = rng.integers(0, 50, (k, k))
    pairs[-1], pairs[:, -1] = 0, 0
    once = np.minimum(rng.integers(0, 9, (2, k)), pairs.sum(1))
    share = (10 ** class_lm.class_follows(pairs, once, 0.1)).sum(1)
    assert (share <= 1 + 1e-9).all() and (share > 0.9).all()


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_held_out_texts_score_above_counting_words(spark, folder):
    docs = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet")
    got = class_lm.score(docs, rounds=4).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got.s > got.b


def test_classes_help_on_held_out_texts(make_docs):
    rng = random.Random(5)
    rows = [(i, sentences(rng, 120)) for i in range(400)]
    got = [r for r in class_lm.score(make_docs(*rows)).collect() if r.held_out]
    assert got and sum(r.score for r in got) > sum(r.base_score for r in got) + 20 * len(got)


def test_exchange_raises_the_likelihood(make_docs, spark):
    rng = random.Random(6)
    seqs = [[rng.randrange(40) + 40 * (i % 3) for i in range(60)] + [120] for _ in range(50)]
    train = spark.createDataFrame([(s,) for s in seqs], "codes array<int>")
    layout = class_lm.Layout(np.array([100] * 120))
    _, before = class_lm.exchange(train, layout, rounds=0)
    _, after = class_lm.exchange(train, layout, rounds=4)
    assert class_lm.likelihood(after) > class_lm.likelihood(before)


def test_empty_table(make_docs):
    docs = make_docs((1, "x"))
    assert class_lm.score(docs.where("false")).collect() == []


def slow_best_class(word: np.ndarray, own: int, pairs: np.ndarray) -> int:
    xlogx = lambda n: n * np.log(np.maximum(n, 1))
    k, c = len(pairs), class_lm.CLASSES
    after, before = word[:k], word[k:]
    rest = pairs.astype(float)
    rest[:, own] -= after
    rest[own, :] -= before
    rest = np.maximum(rest, 0)
    to, out = rest[:, :c].T, rest[:c, :]
    gain = (xlogx(to + after) - xlogx(to)).sum(1) + (xlogx(out + before) - xlogx(out)).sum(1)
    into, from_ = rest.sum(0)[:c], rest.sum(1)[:c]
    gain -= xlogx(into + after.sum()) - xlogx(into) + xlogx(from_ + before.sum()) - xlogx(from_)
    best = int(np.argmax(gain))
    return best if gain[best] > gain[own] + 1e-9 else own


def test_best_classes_equal_one_word_at_a_time():
    rng = np.random.default_rng(2)
    k = class_lm.N_CLASSES
    words = rng.integers(0, 9, (300, 2 * k)) * (rng.random((300, 2 * k)) < rng.choice([0.02, 0.2, 0.9], (300, 1)))
    own = rng.integers(0, class_lm.CLASSES, 300)
    pairs = rng.integers(0, 40, (k, k))
    np.add.at(pairs, (slice(None), own), words[:, :k].T)
    np.add.at(pairs, own, words[:, k:])
    pairs[own[0], own[0]] = 0
    of, cell = np.nonzero(words)
    got = class_lm.best_classes(own, of, cell, words[of, cell], pairs)
    assert got.tolist() == [slow_best_class(w, o, pairs) for w, o in zip(words, own)]
    assert (got != own).any()


@pytest.mark.parametrize("dictionary", [class_lm.DICTIONARY, 6, 0])
def test_words_outside_the_dictionary_get_classes_from_their_contexts(make_docs, spark, monkeypatch, dictionary):
    monkeypatch.setattr(class_lm, "DICTIONARY", dictionary)
    made = []
    real = class_lm.exchange
    monkeypatch.setattr(class_lm, "exchange", lambda *given: made.append(real(*given)) or made[-1])
    rng = random.Random(5)
    kinds = [[f"{k}{i}" for i in range(300)] for k in ("det", "Noun", "VERB")]
    rows = [(i, " ".join(rng.choice(kinds[j % 3]) for j in range(120))) for i in range(250)]
    got = [r for r in class_lm.score(make_docs(*rows)).collect() if r.held_out]
    classes, pairs = made[0]
    n_words = len({t for doc, text in rows if not held_out(doc) for t in tokens(text)})
    assert classes.table.count() == n_words
    assert classes.table.where(f"cls < {class_lm.CLASSES}").count() == n_words - 1
    assert sum(r.score for r in got) > sum(r.base_score for r in got) + 20 * len(got)
    train = np.array([0, 0])
    for doc, text in rows:
        if not held_out(doc):
            train += [len(tokens(text)), 1]
    assert pairs.sum() == train[0] and pairs[class_lm.CLASSES].sum() == train[1]


def test_exchange_ends_when_both_halves_gain_nothing(spark):
    rng = random.Random(6)
    seqs = [[rng.randrange(40) + 40 * (i % 3) for i in range(60)] + [120] for _ in range(50)]
    train = spark.createDataFrame([(s,) for s in seqs], "codes array<int>")
    layout = class_lm.Layout(np.array([100] * 120))
    classes, pairs = class_lm.exchange(train, layout)
    of = np.append(classes.frequent, class_lm.CLASSES)
    words = np.zeros((120, 2 * class_lm.N_CLASSES), dtype=np.int64)
    for seq in seqs:
        for a, b in zip([120, *seq], seq):
            if b < 120:
                words[b, of[a]] += 1
            if a < 120:
                words[a, class_lm.N_CLASSES + of[b]] += 1
    for half in (0, 1):
        chosen = of.copy()
        for w in range(half, 120, 2):
            chosen[w] = slow_best_class(words[w], int(of[w]), pairs)
        table = np.zeros_like(pairs)
        for seq in seqs:
            np.add.at(table, (chosen[[120, *seq[:-1]]], chosen[seq]), 1)
        assert class_lm.likelihood(table) <= class_lm.likelihood(pairs)


@pytest.mark.parametrize(("at_once", "fan_in"), [(1 << 20, 256), (64, 2)])
def test_neighbour_lists_equal_plain_counts(spark, monkeypatch, at_once, fan_in):
    """Words of the dictionary and others, merged at once and over several levels."""
    monkeypatch.setattr(class_lm, "LISTED_AT_ONCE", at_once)
    monkeypatch.setattr(class_lm, "FAN_IN", fan_in)
    rng = random.Random(7)
    seqs = [[rng.choice([*range(20), -3, -8]) for _ in range(rng.randrange(40))] + [20] for _ in range(60)]
    rows = [([max(c, -1) for c in s], [c for c in s if c < 0]) for s in seqs]
    train = spark.createDataFrame(rows, "codes array<int>, rare array<bigint>").repartition(4)
    want = Counter()
    for s in seqs:
        for a, b in zip([20, *s], s):
            if a >= 0:
                want[b, 2 * a] += 1
            if b >= 0:
                want[a, 2 * b + 1] += 1
    got = {}
    for r in class_lm.neighbour_lists(train, class_lm.Layout(np.array([50] * 20))).collect():
        others, ns = np.frombuffer(r.others, np.int32), np.frombuffer(r.ns, np.int64)
        assert len(others) == len(ns) and (np.diff(others) > 0).all()
        for o, n in zip(others.tolist(), ns.tolist()):
            assert (r.code, o) not in got
            got[r.code, o] = n
    assert got == want


def test_long_lists_are_looked_at_in_bounded_parts(monkeypatch):
    def lists(first: int, sizes: list[int]) -> pa.RecordBatch:
        codes = np.repeat(np.arange(first, first + len(sizes)), sizes)
        return class_lm._word_lists(codes, np.concatenate([np.arange(n) for n in sizes]), np.ones(sum(sizes), dtype=np.int64))

    monkeypatch.setattr(class_lm, "READ_AT_ONCE", 50)
    batches = [lists(0, [30, 20, 1, 200, 7]), lists(9, [49, 2]).slice(1), lists(20, [3] * 40)]
    parts = list(class_lm._slices(iter(batches), 10))
    assert [p.column("code").to_pylist() for p in parts][:4] == [[0, 1], [2], [3], [4]]
    for part in parts:
        assert part.num_rows == 1 or part.num_rows <= 10 and len(class_lm._near(part)[0]) <= 50
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches(batches))
    assert list(class_lm._slices(iter([batches[0].slice(0, 0)]))) == []


def test_no_stage_has_the_workers_of_two_functions(make_docs):
    """Each function has its own Python workers, which keep their memory from stage to stage."""
    docs = make_docs((1, "a"))
    codes = F.expr("X''")
    rare = docs.select(F.lit(0).alias("cls"), codes.alias("others"), codes.alias("ns"))
    plan = class_lm.rare_beside(rare)._jdf.queryExecution().executedPlan().toString()
    stages = re.split(r"Exchange", plan)
    assert [stage.count("MapInArrow") for stage in stages if "MapInArrow" in stage] == [1, 1]


def test_words_and_their_codes_equal_plain_splitting(spark):
    texts = ["", " ", "A  b\tC\x0b\x1cd \x85 É x\n", "b", "\nb A", "z" * 70]
    words, at, sizes = class_lm.words_of(pa.array([t.encode() for t in texts], pa.binary()))
    spelled = class_lm._spelled(words)
    want = [[t.encode() for t in tokens(text) if t] for text in texts]
    assert sizes.tolist() == [len(w) for w in want]
    assert [spelled[i] for i in at] == [w for ws in want for w in ws]
    found = spark.createDataFrame([(bytearray(w),) for w in spelled], "word binary").select(class_lm.rare_code(F.col("word"), 3)).collect()
    assert class_lm.rare_codes(spelled, 3).tolist() == [r[0] for r in found]
    assert class_lm._spelled(class_lm.words_of(pa.array([b""], pa.binary()))[0]) == []


def test_lists_go_through_shuffles_in_a_row_for_each_part():
    rng = np.random.default_rng(3)
    words, others = rng.integers(-500, 500, 5000), rng.integers(0, 900, 5000)
    made = class_lm._dealt(words, others, others + 1, 4)
    assert made.num_rows == 8 == len(set(made.column("part").to_pylist()))
    got = []
    for at in range(made.num_rows):
        code, other, n = class_lm._block(made.slice(at, 1))
        assert len({(c % 4, c < 0) for c in code.tolist()}) == 1 and (n == other + 1).all()
        got += zip(code.tolist(), other.tolist())
    assert sorted(got) == sorted(zip(words.tolist(), others.tolist()))


def test_what_a_half_changes_equals_counting_all_again(spark):
    rng = np.random.default_rng(4)
    k, end = class_lm.N_CLASSES, 40
    seqs = [rng.integers(0, end, 30).tolist() + [end] for _ in range(20)]
    train = spark.createDataFrame([(s, []) for s in seqs], "codes array<int>, rare array<bigint>")
    cells = np.arange(2 * k, dtype=np.int32)
    far = [(c, bytearray(cells.tobytes()), bytearray(rng.integers(0, 9, 2 * k).tobytes())) for c in range(end + 1)]
    rows = class_lm.neighbour_lists(train, class_lm.Layout(np.full(end, 15))).join(
        spark.createDataFrame(far, "code long, cells binary, cell_ns binary"), "code"
    )
    was = np.append(rng.integers(0, class_lm.CLASSES, end), class_lm.CLASSES)
    of = was.copy()
    of[:end:2] = rng.integers(0, class_lm.CLASSES, end // 2)
    want = class_lm.class_pairs(rows, of) - class_lm.class_pairs(rows, was)
    got = class_lm.changed_pairs(rows.where("code % 2 = 0"), was, of)
    assert want[0].any() and (got[0] == want[0]).all() and (got[2:] == want[2:]).all()


def test_words_that_only_held_out_texts_have_count_nothing(spark):
    rows = [("a b a", False), ("b c c", True), ("B", False)]
    counts = class_lm.count_words(spark.createDataFrame(rows, "text string, held_out boolean"))
    assert {bytes(r.word): r.n for r in counts.collect()} == {b"a": 2, b"b": 2, b"c": 0}


@pytest.mark.parametrize("rounds", [8, 11])
def test_class_pairs_stay_right_over_rounds_of_all_words(make_docs, spark, monkeypatch, rounds):
    monkeypatch.setattr(class_lm, "DICTIONARY", 40)
    made = []
    real = class_lm.exchange
    monkeypatch.setattr(class_lm, "exchange", lambda *given: made.append((given[0], *real(*given))) or made[-1][1:])
    class_lm.score(make_docs(*sample(4)), rounds=rounds, least_gain=0.0)
    train, classes, pairs = made[0]
    of = {r.code: r.cls for r in classes.table.collect()}
    want = np.zeros_like(pairs)
    for r in train.collect():
        codes, rare = np.frombuffer(r.codes, np.int32).astype(np.int64), iter(np.frombuffer(r.rare, np.int64).tolist())
        found = [of[c if c >= 0 else next(rare)] for c in codes.tolist()]
        np.add.at(want, ([class_lm.CLASSES, *found[:-1]], found), 1)
    assert (pairs == want).all()
