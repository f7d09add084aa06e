from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from llm_docs import make_docs  # noqa: F401
from pyspark.sql import functions as F

from branchlore.llm import merkle


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row: tuple) -> str:
    doc_id, text, lang, source, n_chars = row
    said = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return digest(*["-" if v is None else f"{len(v.encode())}:{v}" for v in said])


def slow_tree(nodes: list[str], fanout: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root and per leaf the siblings left and right on its way up."""
    places, proofs = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for i, at in enumerate(places):
            first = at // fanout * fanout
            proofs[i].append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + fanout])))
            places[i] = at // fanout
        nodes = [digest(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], proofs


def slow(rows: list[tuple], fanout: int = 2) -> list[tuple]:
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[lang] = mine, *slow_tree([leaf_of(r) for r in mine], fanout)
    root, over = slow_tree([trees[lang][1] for lang in langs], fanout)
    found = []
    for lang, last in zip(langs, over, strict=True):
        mine, subroot, proofs = trees[lang]
        found += [(r[0], leaf_of(r), subroot, root, [*p, *last]) for r, p in zip(mine, proofs, strict=True)]
    return found


def full(rows: list[tuple]) -> list[tuple]:
    """(id, text, lang, source) with ``n_chars``, as the fixture makes them."""
    return [(*r, len(r[1]) if r[1] is not None else None) for r in rows]


def random_rows(n: int, langs: list, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    return [(i, rng.choice(["", "é" * 3, "text", f"t{i}"]), rng.choice(langs), rng.choice(["s", "", None])) for i in range(n)]


def by_id(rows) -> list:
    return sorted(rows, key=repr)


@pytest.mark.parametrize(
    ("n", "langs", "fanout", "levels"),
    [(1, ["en"], 2, 6), (3, ["en", None], 2, 6), (700, ["en"] * 9 + [None, "", "fr"], 2, 1), (700, ["en", "de"], 2, 6), (64, ["x"], 2, 2),
     (2300, ["en"] * 20 + ["é", None], 3, 1)],
)
def test_equals_slow_trees(make_docs, n, langs, fanout, levels):
    rows = random_rows(n, langs, n)
    got = merkle.manifest(make_docs(*rows).repartition(5), fanout=fanout, levels=levels).collect()
    said = [(r.doc_id, r.leaf, r.subroot, r.root, [(s.left.hex(), s.right.hex()) for s in r.proof]) for r in got]
    assert by_id(said) == by_id(slow(full(rows), fanout))


def test_missing_values_ties_and_repeated_rows(make_docs):
    rows = [(None, None, None, None), (None, "b", None, "s"), (5, "a", "en", "s"), (5, "a", "en", "s"), (5, "b", "en", "s"), (6, "", "en", None)]
    rows += [(5, "a", "en", "s")] * 200 + [(7, "long " * 50_000, "fr", "s")]
    got = merkle.manifest(make_docs(*rows)).collect()
    said = [(r.doc_id, r.leaf, r.subroot, r.root, [(s.left.hex(), s.right.hex()) for s in r.proof]) for r in got]
    assert by_id(said) == by_id(slow(full(rows)))


def test_many_groups(make_docs):
    rows = [(i, "t", f"l{i % 150}", "s") for i in range(300)]
    got = merkle.manifest(make_docs(*rows), levels=1).collect()
    assert by_id((r.doc_id, r.root, len(r.proof)) for r in got) == by_id((r[0], r[3], len(r[4])) for r in slow(full(rows)))


def test_tampered_rows_fail_and_others_verify(make_docs):
    rows = random_rows(200, ["en", "de", None], 3) + [(None, "x", "en", "s"), (900, None, "en", "s")]
    got = {r.leaf: r for r in merkle.verified_manifest(make_docs(*rows)).collect()}
    for doc_id, leaf, _, root, proof in slow(full(rows)):
        row = next(r for r in full(rows) if leaf_of(r) == leaf)
        struck = doc_id is not None and row[4] is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        node = leaf_of((*row[:4], row[4] + 1)) if struck else leaf
        for left, right in proof:
            node = digest(left, node, right)
        assert got[leaf].folded_root == node
        assert got[leaf].verified is (node == root) is not struck
        assert got[leaf].proof_sha256 == digest(*[a + b for a, b in proof])


def test_largest_count_of_characters_can_be_tampered(make_docs):
    docs = make_docs((33, "x")).withColumn("n_chars", F.lit(2**63 - 1))
    assert zlib.crc32(b"33") % 7 == 0
    row = merkle.verified_manifest(docs).first()
    assert not row.verified and row.folded_root == leaf_of((33, "x", "en", "s", 2**63))


def test_empty_table(make_docs):
    assert merkle.verified_manifest(make_docs((1, "a")).where("false")).collect() == []
