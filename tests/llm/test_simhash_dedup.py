from __future__ import annotations

import random
from collections import Counter

import numpy as np
import xxhash
from llm_docs import make_docs  # noqa: F401

from branchlore.llm import simhash_dedup
from branchlore.llm.common import components


def slow_fingerprint(text: str | None) -> int:
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        words = words.replace(space, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    counts, total = Counter(), 0
    for s in shingles:
        h = xxhash.xxh64(s.encode(), seed=42).intdigest()
        total += 1
        for bit in range(64):
            counts[bit] += h >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * counts[bit] > total)


def slow_components(rows: list[tuple]) -> dict:
    fps = sorted({f for _, f in rows})
    group = {f: f for f in fps}

    def find(f):
        while group[f] != f:
            f = group[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                group[find(a)] = find(b)
    least: dict = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return {f: least.get(find(f)) for f in fps}


def check(docs, rows):
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash_dedup.near_duplicates(docs).collect()), key=str)
    prints = [(i, slow_fingerprint(t)) for i, t in rows]
    named = slow_components(prints)
    assert got == sorted(((i, f"{f:016x}", named[f]) for i, f in prints), key=str)


def sample_rows(seed: int = 5) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = [f"wörd{i}" for i in range(300)] + ["A", "the", "İx", "K"]
    rows = [(None, "one TWO three four five"), (7, None), (8, ""), (9, " \n\t "), (10, "one word"), (11, "One Word x")]
    for i in range(20, 60):
        words = rng.choices(vocabulary, k=rng.choice([3, 4, 5, 40, 400, 3000]))
        rows.append((i, " ".join(words)))
        if i % 4 == 0:
            rows.append((i, " ".join(words)))  # a repeated row
        if i % 3 == 0:
            words[rng.randrange(len(words))] = "changed"
            rows.append((i + 1000, "\n".join(words)))
    return rows


def test_equals_brute_force(make_docs):
    rows = sample_rows()
    check(make_docs(*rows), rows)


def test_empty_table(make_docs, spark):
    empty = make_docs((1, "x")).where("false")
    assert simhash_dedup.near_duplicates(empty).collect() == []
    assert simhash_dedup.drop_near_duplicates(empty).columns == empty.columns


def test_very_long_text_counts_every_shingle():
    rng = random.Random(1)
    text = " ".join(rng.choices(["a", "b", "c", "dd"], k=90_000))
    assert simhash_dedup.fingerprint(text.encode()) == slow_fingerprint(text)


def test_links_of_a_dense_cluster_are_complete_but_few(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 700:
        fps.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 7]))))
    fps |= {rng.getrandbits(64) for _ in range(300)}
    df = spark.createDataFrame([(simhash_dedup._signed(f),) for f in fps], "fp long")
    for block in (4096, 16):  # in one group each, and split
        links = simhash_dedup.near_links(df, block=block)
        assert links.count() < 700 * 64 * 3
        found = {r.node: r.root for r in components(links).collect()}
        want = slow_components([(f, f) for f in fps])
        groups: dict = {}
        for f in fps:
            groups.setdefault(want[f], set()).add(simhash_dedup._signed(f))
        for members in groups.values():
            assert len({found.get(m, m) for m in members}) == 1
        assert len({found.get(simhash_dedup._signed(f), simhash_dedup._signed(f)) for f in fps}) == len(groups)


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(200)]
    random.Random(2).shuffle(chain)
    star = [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)]
    found = {r.node: r.root for r in components(spark.createDataFrame(chain + star, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1300)}


def test_one_row_of_a_group_stays(make_docs):
    rows = sample_rows()
    docs = make_docs(*rows)
    kept = simhash_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    prints = [(i, slow_fingerprint(t)) for i, t in rows]
    named = slow_components(prints)
    want = {named[f] for i, f in prints if i is not None and named[f] is not None}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(want)


def test_star_labels():
    label = simhash_dedup.star_labels(6, np.array([4, 2, 5]), np.array([2, 0, 5]))
    assert label.tolist() == [0, 1, 0, 3, 0, 5]
