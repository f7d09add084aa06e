from __future__ import annotations

import random

import numpy as np
import pytest
from llm_docs import make_docs  # noqa: F401

from branchlore.llm import token_counts


def slow(docs: list[tuple]) -> list[tuple]:
    encode = token_counts.encoding(token_counts.VOCABULARY, token_counts.read_ranks(token_counts.VOCABULARY)).encode_ordinary
    return sorted(((i, len(encode(t or ""))) for i, t in docs), key=str)


def test_equals_direct_counts(make_docs, spark, tmp_path):
    rng = random.Random(1)
    docs = [(None, "a b"), (1, None), (2, ""), (3, "<|endoftext|> Ä😀"), (4, "long text " * 40_000)]
    docs += [(i, " ".join(rng.choices(["the", "Ä", "x1", "\n", "PÄ"], k=rng.choice([0, 1, 50])))) for i in range(10, 90)]
    docs += docs[-4:]
    path = str(tmp_path / "docs")
    make_docs(*docs).repartition(3).write.parquet(path)
    got = token_counts.token_counts(spark.read.parquet(path)).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=str) == slow(docs)


@pytest.mark.parametrize("block_tokens", [1, 2, 7, 1000])
@pytest.mark.parametrize("width", [2, 4])
def test_blocks_are_stitched(spark, tmp_path, block_tokens, width):
    rng = random.Random(block_tokens)
    want = {}
    for name in ("one", "two", "open", "empty", "only_ends"):
        lengths = [rng.choice([0, 0, 1, 3, 15]) for _ in range(0 if name == "empty" else 25)]
        if name == "only_ends":
            lengths = [0] * 9
        tokens = []
        for n in lengths:
            tokens += [rng.randrange(9, 12) for _ in range(n)] + [8]
        if name == "open":
            tokens += [9, 9]
            lengths.append(2)
        folder = tmp_path / name
        folder.mkdir()
        (folder / "part.txt").write_bytes(np.array(tokens, dtype=f"<u{width}").tobytes())
        want[name] = lengths
    rows = token_counts.flat_file_counts(spark, str(tmp_path), end=8, width=width, block_tokens=block_tokens).collect()
    got: dict = {name: {} for name in want}
    for r in rows:
        got[r.file.split("/")[-2]][r.nth] = (r.start, r.n_tokens)
    for name, lengths in want.items():
        starts = np.cumsum([0] + [n + 1 for n in lengths])
        assert got[name] == {i: (int(starts[i]), n) for i, n in enumerate(lengths)}


def test_empty_table(make_docs, spark, tmp_path):
    path = str(tmp_path / "docs")
    make_docs((1, "x")).where("false").write.parquet(path)
    assert token_counts.token_counts(spark.read.parquet(path)).collect() == []


def test_splits_of_the_scans_need_not_agree(make_docs, spark, tmp_path):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choices(["the", "x1", "PÄ"], k=rng.randrange(300)))) for i in range(2000)]
    path = str(tmp_path / "docs")
    make_docs(*docs).coalesce(1).write.option("parquet.block.size", 4096).option("parquet.page.size.row.check.min", 10).parquet(path)
    conf, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set(conf, 30_000)
        counts = token_counts.token_counts(spark.read.parquet(path))
        spark.conf.set(conf, 47_000)
        got = counts.collect()
    finally:
        spark.conf.set(conf, before)
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=str) == slow(docs)


def test_flat_files_are_bounded(make_docs, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "FILE_TOKENS", 100, raising=False)
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choices(["the", "x1", "PÄ"], k=rng.randrange(30)))) for i in range(200)]
    docs += [(500, "long text " * 300), (501, "a"), (502, None)]
    path, flat = str(tmp_path / "docs"), tmp_path / "flat"
    make_docs(*docs).coalesce(1).write.parquet(path)
    token_counts.write_flat_files(spark.read.parquet(path), str(flat))
    sizes = [f.stat().st_size // token_counts.WIDTH for f in flat.rglob("*.txt")]
    lengths = sorted(n + 1 for _, n in slow(docs))
    assert sum(sizes) == sum(lengths)
    assert sorted(sizes)[-2] < 100 + lengths[-2] and max(sizes) < 100 + lengths[-1]
    got = token_counts.token_counts(spark.read.parquet(path)).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=str) == slow(docs)
