from __future__ import annotations

import random
import re
from llm_docs import make_docs  # noqa: F401

from branchlore.llm import license_scan
from branchlore.llm.license_scan import BASE, TEMPLATES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text: str | None) -> list[str]:
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow(rows: list[tuple]) -> list[tuple]:
    texts = [fold(t) for _, t in rows]
    df = {w: sum(w in t for t in texts) for tpl in TEMPLATES for w in tpl.words}
    out = []
    for (doc, _), words in zip(rows, texts):
        found = []
        for tpl in TEMPLATES:
            t, key = tpl.words, tpl.key.split()
            rare = sorted((df[w], w) for w in set(t) if df[w])[: 1 if tpl in BASE else 4]
            for start in range(-len(t), len(words)):
                at = lambda i: words[i] if 0 <= i < len(words) else None
                agree = sum(at(start + i) == w for i, w in enumerate(t) if w in {r for _, r in rare})
                if not rare or agree < (1 if tpl in BASE else min(2, len(rare))):
                    continue
                if [at(start + tpl.key_at + i) for i in range(len(key))] != key:
                    continue
                score = sum(at(start + i) == w for i, w in enumerate(t)) / len(t)
                if score >= 0.7:
                    found.append((start, tpl, score))
        base = sorted(s for s, tpl, _ in found if tpl in BASE)
        say = lambda labels: ",".join(sorted(set(labels)))
        out.append(
            (
                doc, len(words), len(base), base[0] if base else None, base[-1] if base else None, say(t.label for _, t, _ in found if t in BASE),
                say(t.label for _, t, _ in found), max((s for *_, s in found), default=0.0),
            )
        )
    return sorted(out, key=str)


def sample(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = ["all", "by", "the", "of", "license", "public", "general", "rights", "reserved", "cc", "é", "CC", "K", "2", "0"] + ["w%d" % i for i in range(40)]
    rows = [(None, "CC-BY"), (1, None), (2, ""), (3, "cc ßy CC_by cc"), (4, "All rights-RESERVED all Rights reserved"), (5, "liKense"), (6, "reserved")]
    for i in range(10, 120):
        words = rng.choices(vocabulary, k=rng.choice([2, 20, 150]))
        for _ in range(rng.choice([0, 1, 3])):
            notice = list(rng.choice(TEMPLATES).words)
            for _ in range(rng.choice([0, 0, 1, 4])):
                notice[rng.randrange(len(notice))] = rng.choice(vocabulary)
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.upper() if rng.random() < 0.3 else w for w in notice]
        rows.append((i, "".join(w + rng.choice([" ", ", ", "-", ".\n"]) for w in words)))
    return rows + rows[-3:] + [(500, "word " * 50_000 + "Released under the MIT License. CC BY")]


def test_equals_brute_force(make_docs):
    rows = sample()
    got = license_scan.licences(make_docs(*rows)).collect()
    assert sorted(map(tuple, got), key=str) == slow(rows)


def test_empty_table_and_no_python(make_docs):
    docs = make_docs((1, "nothing here"))
    assert license_scan.licences(docs.where("false")).collect() == []
    assert tuple(license_scan.licences(docs).first()) == (1, 2, 0, None, None, "", "", 0.0)
    found = license_scan.scan(make_docs((1, "released under the mit license")))
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_templates_hold_their_key_phrase():
    assert all(t.words[t.key_at : t.key_at + len(t.key.split())] == t.key.split() for t in TEMPLATES)


def test_altered_rare_words_do_not_hide_a_notice(make_docs):
    notice = "x and use in source and binary forms with or without y are z"
    rows = [(1, notice), (2, "redistribution modification permitted")]
    rows += [(i, "and use in source binary forms with or without are") for i in range(3, 9)]
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.licences(make_docs(*rows)).collect()}
    assert got.pop(1) == ("bsd", 11 / 14)
    assert set(got.values()) == {("", 0.0)}
