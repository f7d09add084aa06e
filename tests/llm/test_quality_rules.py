from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from llm_docs import make_docs  # noqa: F401

from branchlore.llm import quality_rules

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def slow_counts(text: str | None) -> dict:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(inside),
    }


def slow(rows: list[tuple]) -> list[tuple]:
    counts = [slow_counts(r[1]) for r in rows]
    failed = [c["n_words"] < 10 or 100 * c["n_repeat_words"] > 20 * c["n_words"] for c in counts]

    def value(c, m):
        top, bottom, scale, *_ = quality_rules.MEASURES[m]
        return c[top] * scale // c[bottom] if c[bottom] else 0

    def bucket(v):
        drop = max(0, v.bit_length() - 6)
        return v >> drop << drop

    seen = defaultdict(list)
    for r, c, f in zip(rows, counts, failed):
        if not f:
            for m in quality_rules.MEASURES:
                for group in ((r[2], r[3]), (r[2],), ()):
                    seen[group, m].append(bucket(value(c, m)))
    out = []
    for r, c, f in zip(rows, counts, failed):
        keep = not f
        for m, (_, _, _, above, below) in quality_rules.MEASURES.items():
            if f:
                continue
            values = next(v for g in ((r[2], r[3]), (r[2],), ()) if len(v := sorted(seen[g, m])) >= 50 or not g)
            q1, q2, q3 = (values[-(-len(values) * q // 4) - 1] for q in (1, 2, 3))
            keep &= value(c, m) <= max(q3 + 3 * (q3 - q1), q2 + above)
            keep &= below is None or value(c, m) >= min(q1 - 3 * (q3 - q1), q2 - below)
        out.append((r[0], *(c[n] for n in NAMES), f, keep))
    return sorted(out, key=str)


def sample(seed: int = 6):
    rng = random.Random(seed)
    words = ["the", "é", "of", "longerword", "a", "#b", "c|d", "x"] + [f"v{i}" for i in range(60)]
    rows = [(1, None, "en", "s0"), (None, "", None, None), (2, " \t\x0b\n", "en", None), (3, "one\x85two three", "de", "s1")]
    for i in range(10, 260):
        n = rng.choice([3, 9, 10, 30, 200, 900])
        chosen = rng.choices(words, k=n)
        if i % 5 == 0:
            chosen[n // 2 :] = chosen[: n // 4] * 2
        if i % 11 == 0:
            chosen = [w + "###" for w in chosen]
        if i % 13 == 0:
            chosen = [w * 12 for w in chosen]
        text = "".join(w + rng.choice([" ", " ", " ", "\n", "\n\n", "\t", "  "]) for w in chosen)
        if i % 7 == 0:
            text += "\nsame line here\n same line here\nsame line here\n"
        rows.append((i, text, rng.choice(["en", "en", "de", None]), rng.choice(["s0", "s0", "s1", "s2", None])))
    return rows + rows[-5:] + [(900, " ".join(rng.choices(words, k=30_000)), "en", "s0")]


def test_equals_brute_force(make_docs):
    rows = sample()
    got = quality_rules.quality(make_docs(*rows))
    assert sorted(map(tuple, got.collect()), key=str) == slow(rows)


def test_pipeline_form_keeps_columns_and_empty_tables(make_docs):
    rows = sample(9)
    docs = make_docs(*rows)
    kept = quality_rules.drop_low_quality(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in slow(rows) if r[-1])
    assert quality_rules.quality(docs.where("false")).collect() == []


def test_main_path_has_no_python(make_docs):
    plan = quality_rules.measured(make_docs((1, "x")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
