"""The stages of the pipeline on odd rows: one id and text in several groups, clashing names, nulls."""

from __future__ import annotations

import pytest
from llm_docs import make_docs  # noqa: F401
from pyspark.sql import functions as F

from branchlore.llm import decontamination, quality_rules, secret_scan, simhash_dedup, source_mixing

KEYS = (quality_rules.KEY, decontamination.KEY, simhash_dedup.STAYS, secret_scan.KEY, source_mixing.KEY, "doc", "spans", "kinds")


def clashing(docs):
    return docs.withColumns({name: F.lit(f"own {name}") for name in KEYS})


def text(n: int, extra: str = "") -> str:
    return " ".join(f"w{(n * 31 + i * 7) % 997}x{i}" for i in range(60)) + extra


def symbolic(n: int) -> str:
    return " ".join(f"a{n}b{i} ##" for i in range(60))


def test_a_row_is_judged_by_its_own_language_and_source(make_docs):
    docs = [(i, text(i), "en", "clean") for i in range(200)] + [(i, symbolic(i), "en", "symbolic") for i in range(200, 400)]
    twice = symbolic(5000)
    docs += [(5000, twice, "en", "clean"), (5000, twice, "en", "symbolic"), (5000, twice, "en", "symbolic")]
    table = clashing(make_docs(*docs))
    verdict = {(r.doc_id, r.source): r.kept for r in quality_rules.judged(table).where("doc_id = 5000").collect()}
    assert verdict == {(5000, "clean"): False, (5000, "symbolic"): True}
    kept = quality_rules.drop_low_quality(table)
    assert kept.columns == table.columns
    assert sorted((r.doc_id, r.source) for r in kept.where("doc_id = 5000").collect()) == [(5000, "symbolic")] * 2
    judged = quality_rules.judged(table)
    assert kept.count() == judged.where("kept").count()


def test_near_dedup_keeps_the_same_row_every_time(make_docs):
    docs = [(1, text(1), "fr", "b"), (1, text(1), "de", "z"), (1, text(1), "de", "a"), (2, text(1), "aa", "a"), (None, text(9), None, None), (3, "", "en", "s")]
    for parts in (1, 2, 5):
        table = clashing(make_docs(*docs).repartition(parts))
        kept = simhash_dedup.drop_near_duplicates(table)
        assert kept.columns == table.columns
        assert sorted(((r.doc_id, r.lang, r.source, r.spans) for r in kept.collect()), key=str) == sorted(
            [(1, "de", "a", "own spans"), (3, "en", "s", "own spans"), (None, None, None, "own spans")], key=str)


def test_decontamination_and_secrets_keep_clashing_columns(make_docs, spark):
    passage = " ".join(f"q{i}" for i in range(30))
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    docs = [(1, text(1), "en", "a"), (2, text(2) + " " + passage, "en", "a"), (3, None, None, None), (4, "token = abcdefgh12345 end", "en", "a"), (4, "token = abcdefgh12345 end", "de", "b")]
    table = clashing(make_docs(*docs))
    clean = decontamination.drop_contaminated(table, bench)
    assert clean.columns == table.columns and sorted(r.doc_id for r in clean.collect()) == [1, 3, 4, 4]
    marked = secret_scan.redact_secrets(table)
    assert marked.columns == table.columns
    got = sorted(((r.doc_id, r.text, r.lang, r.n_chars, r.doc) for r in marked.where("doc_id > 2").collect()), key=str)
    said = "[SECRET] end"
    assert got == sorted([(3, None, None, None, "own doc"), (4, said, "en", len(said), "own doc"), (4, said, "de", len(said), "own doc")], key=str)


@pytest.mark.parametrize("parts", [1, 4])
def test_copies_stay_with_their_source(make_docs, parts):
    docs = [(i, text(i), "en", "a") for i in range(30)] + [(7, text(7), "en", "b"), (7, text(7), "de", "b"), (8, text(8), "en", None)]
    docs += [(100, text(100, " long" * 20_000), "en", "b"), (101, None, "en", "b"), (102, "", "en", "a")]
    table = clashing(make_docs(*docs).repartition(parts))
    sizes = {(r.doc_id, r.source_size): 0 for r in source_mixing.mix(table).collect()}
    taken: dict = dict(sizes)
    for r in source_mixing.mix(table).collect():
        taken[r.doc_id, r.source_size] += r.taken
    of_source = {r.source: r.source_size for r in source_mixing.source_targets(source_mixing.document_sizes(table)).collect()}
    mixed = source_mixing.ordered_mix(table)
    got: dict = dict.fromkeys(taken, 0)
    for r in mixed.collect():
        got[r.doc_id, of_source[r.source]] += len(r.text.split())
    assert got == taken
