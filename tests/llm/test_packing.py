from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_docs import make_docs  # noqa: F401
from tokenizers import Tokenizer

from branchlore.llm import packing

TOKENIZER = Tokenizer.from_file(packing.word_tokenizer())


def ids_of(text: str | None) -> list[int]:
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [1]


def random_text(rng: random.Random, words: int) -> str:
    kinds = ["the", "Naïve", "don't", "3.14", "x", "İz", "ſ", "中文", "<|endoftext|>", "end.", "stop!", "wow?!", "é́", "\n", "\t", "a b", "ÉTÉ,"]
    return " ".join(rng.choices(kinds, k=words))


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet=st.one_of(st.sampled_from("abé.,!?' \n\t\x0b\x1c <|>ÀİſΣ1"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_words_are_encoded_like_the_whole_text(text):
    encoder = packing.encoder_of(packing.word_tokenizer())
    ids, ends = encoder.encode(text.encode())
    assert ids.tolist() == ids_of(text)[:-1]
    assert all(0 <= e <= len(ids) for e in ends)


def test_special_tokens_and_long_words():
    encoder = packing.encoder_of(packing.word_tokenizer())
    for text in ("<|endoftext|> a<|startoftext|>b", "x" * 300 + " " + "é" * 300, "1" * 100, "." * 90 + " a." + "!" * 70, " \n "):
        assert encoder.encode(text.encode())[0].tolist() == ids_of(text)[:-1]


def test_long_texts_are_split_at_white_space(monkeypatch):
    monkeypatch.setattr(packing, "SEGMENT_BYTES", 7)
    encoder = packing.encoder_of(packing.word_tokenizer())
    rng = random.Random(4)
    for _ in range(50):
        text = random_text(rng, 30)
        assert encoder.encode(text.encode())[0].tolist() == ids_of(text)[:-1]


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 3)
    encoder = packing.Encoder(packing.word_tokenizer())
    for seed in range(20):
        text = random_text(random.Random(seed), 20)
        assert encoder.encode(text.encode())[0].tolist() == ids_of(text)[:-1]


def test_texts_together_are_encoded_like_each_alone(monkeypatch):
    rng = random.Random(9)
    texts = [random_text(rng, rng.choice([0, 1, 30])) + rng.choice(["", "&&&", " a###", ' "so."', " …"]) for _ in range(60)]
    want = [packing.Encoder(packing.word_tokenizer()).encode(text.encode()) for text in texts]
    monkeypatch.setattr(packing, "SEGMENT_BYTES", 50)
    for size in (1, 200, 1 << 20):
        monkeypatch.setattr(packing, "GROUP_BYTES", size)
        got = list(packing.Encoder(packing.word_tokenizer()).encode_all((i, text.encode()) for i, text in enumerate(texts)))
        assert [i for i, _, _ in got] == list(range(len(texts)))
        for text, (_, ids, ends), (ids_alone, ends_alone) in zip(texts, got, want, strict=True):
            assert ids.tolist() == ids_alone.tolist() == ids_of(text)[:-1]
            assert set(ends_alone.tolist()) <= set(ends.tolist())


def test_a_word_with_signs_is_known_by_its_parts():
    encoder = packing.Encoder(packing.word_tokenizer())
    learnt = []
    learn = encoder._learn
    encoder._learn = lambda parts: learnt.extend(parts) or learn(parts)
    encoder._whole = None  # no word here takes the tokenizer's whole way
    text = "Straße&&& straße, STRASSE ### straße.&&& strasse!"
    assert encoder.encode(text.encode())[0].tolist() == ids_of(text)[:-1]
    assert len(learnt) == len(set(learnt)) and "straße".encode() in learnt


def least_cost(places: list[int], costs: list[int], size: int) -> int:
    """The same program without a queue: every earlier place is tried."""
    at, best = [0, *places], [0]
    for j in range(1, len(at)):
        options = [best[i] + packing.padding(at[j] - at[i], size) for i in range(j) if at[j] - at[i] <= size]
        best.append(min(options) + costs[j - 1] + packing.SEQUENCE_COST)
    return best[-1]


@settings(deadline=None, max_examples=300)
@given(st.lists(st.tuples(st.integers(1, 40), st.sampled_from([0, 16, 64])), min_size=1, max_size=60), st.sampled_from([64, 128]))
def test_cuts_cost_least(steps, size):
    places = np.cumsum([s for s, _ in steps])
    costs = np.array([c for _, c in steps])
    cuts = packing.best_cuts(places, costs, size)
    assert cuts[-1] == places[-1] and cuts == sorted(set(cuts))
    price = dict(zip(places.tolist(), costs.tolist(), strict=True))
    total = sum(packing.padding(b - a, size) + price[b] + packing.SEQUENCE_COST for a, b in zip([0, *cuts], cuts))
    assert max(b - a for a, b in zip([0, *cuts], cuts)) <= size
    assert total == least_cost(places.tolist(), costs.tolist(), size)


def test_places_are_document_and_sentence_ends_and_strides():
    places, costs = packing.cut_places(np.array([10, 1000]), np.array([5, 10, 400]))
    kind = dict(zip(places.tolist(), costs.tolist(), strict=True))
    assert {p for p, c in kind.items() if c == 0} == {10, 1000}
    assert {p for p, c in kind.items() if c == packing.SENTENCE_COST} == {5, 400}
    rest = sorted(p for p, c in kind.items() if c == packing.STRIDE_COST)
    assert rest[0] == 10 + packing.STRIDE and np.diff([0, *places]).max() <= packing.LONG_STRETCH


def check(rows: list, docs: list[tuple], size: int = 2048) -> dict:
    """Pieces hold every token of every document once; sequences are gapless.  Returns their lengths."""
    want = defaultdict(list)
    for doc_id, text in docs:
        want[doc_id].append(ids_of(text))
    pieces = defaultdict(list)
    sequences = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(want)
    for doc_id, texts in want.items():
        mine = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces[doc_id])
        assert sum(length for _, length, _, _ in mine) == sum(map(len, texts))
        if len(texts) > 1:
            continue
        ids, at = texts[0], 0
        for start, length, crc, tokens in mine:
            assert (start, tokens) == (at, len(ids))
            assert crc == zlib.crc32(np.array(ids[at : at + length], "<u4").tobytes())
            at += length
    lengths = {}
    for number, mine in sequences.items():
        at = 0
        for r in sorted(mine, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= size
        lengths[number] = at
    return lengths


def test_every_token_lies_in_one_piece(make_docs):
    rng = random.Random(2)
    docs = [(i, random_text(rng, rng.choice([0, 1, 20, 300]))) for i in range(150)]
    docs += [(900, None), (901, ""), (None, "no id"), (902, "word " * 30_000), (903, "x" * 20_000), (904, "same text."), (904, "same text.")]
    lengths = check(packing.packed_pieces(make_docs(*docs).repartition(3)).collect(), docs)
    total = sum(lengths.values())
    assert sum(packing.padding(n, 2048) for n in lengths.values()) < 0.02 * total


def test_documents_keep_their_order_and_blocks_end_with_one(make_docs):
    docs = [(i, "word " * (i % 50) + "end.") for i in range(400)]
    got = packing.pack(make_docs(*docs).coalesce(1), size=256, block=1000).orderBy("sequence_id").collect()
    assert [r.sequence_id for r in got] == list(range(len(got)))
    flat = [(p.doc_id, p.start) for r in got for p in r.pieces]
    assert flat == sorted(flat)
    for r in got:
        assert len(r.tokens) == 4 * sum(p.length for p in r.pieces) <= 4 * 256


def test_sizes_and_empty_table(make_docs):
    docs = make_docs((1, "a"))
    with pytest.raises(ValueError):
        packing.pack(docs, size=1000)
    assert packing.packed_pieces(docs.where("false")).collect() == []
