from __future__ import annotations

import random

import corpus_pipeline
from llm import test_decontamination as t3
from llm import test_quality_rules as t5
from llm import test_secret_scan as t1
from llm import test_simhash_dedup as t6
from llm import test_source_mixing as t9

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sample(seed: int = 1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, text(30)) for i in range(5)]
    rows = [(1, None, "en", "a"), (2, "few words", "en", "a"), (3, "a b c d e f " * 20, "en", "b")]
    for i in range(10, 160):
        words = text(rng.choice([30, 200, 600])).split()
        if i % 9 == 0:
            words[5:5] = items[i % 5][1].split()
        if i % 7 == 0:
            words[9:9] = ["token", "=", "abcdefgh12345"]
        if i % 10 == 3:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), rng.choice(["en", "de"]), rng.choice(["a", "a", "b", None])))
        if i % 8 == 0:
            rows.append((i + 1000, " ".join(words[:-1]), "en", "b"))
            rows.append((i + 2000, " ".join(words), "en", None))
    return rows, items


def slow(rows, items):
    kept = {r[0] for r in t5.slow(rows) if r[-1]}
    rows = [r for r in rows if r[0] in kept]
    prints = {r[0]: t6.slow_fingerprint(r[1]) for r in rows}
    named = t6.slow_components(list(prints.items()))
    rows = [r for r in rows if named[prints[r[0]]] == r[0]]
    clean = {r[0] for r in t3.slow([(r[0], r[1]) for r in rows], items) if not r[5]}
    rows = [r for r in rows if r[0] in clean]
    out = []
    for doc, text, lang, source in rows:
        at, marked = 0, ""
        for start, _, end, _ in t1.slow_spans(text):
            if start >= at:
                marked += text[at:start] + "[SECRET]"
            at = max(at, end)
        out.append((doc, marked + text[at:], lang, source))
    copies = {doc: taken // size for doc, size, _, _, taken in t9.slow(out)}
    return sorted((r for r in out for _ in range(copies[r[0]])), key=str)


def test_equals_brute_force(spark, tmp_path):
    rows, items = sample()
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    mixed = corpus_pipeline.run(spark, str(tmp_path))
    want = slow(rows, items)
    got = [(r.doc_id, r.text, r.lang, r.source) for r in mixed.collect()]
    assert sorted(got, key=str) == want
    assert len({r[0] for r in want}) > 50
    assert all(r.n_chars == len(r.text) for r in mixed.collect())


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, step in corpus_pipeline.STAGES:
        made = step(spark, docs, str(tmp_path))
        assert made.collect() == []
        assert made.columns[:5] == docs.columns, name
