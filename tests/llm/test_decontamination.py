from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from llm_docs import make_docs  # noqa: F401

from branchlore.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text: str | None) -> list[str]:
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def digest_of(items: set) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def is_near(words: list, window: tuple, count: Counter) -> bool:
    rare = sorted((count[w], i, w) for i, w in enumerate(window) if count[w])[:2]
    if len(window) <= 8 or not rare:
        return False
    first, *second = [{at - i for at, w in enumerate(words) if w == word} for _, i, word in rare]
    for start in first:
        if second and not any(abs(start - other) <= 4 for other in second[0]):
            continue
        reach = Counter(words[max(0, start - 4) : max(0, start + len(window) + 4)])
        if sum(min(n, reach[w]) for w, n in Counter(window).items()) >= 8:
            return True
    return False


def slow(docs: list[tuple], items: list[tuple]) -> list[tuple]:
    windows: dict = {}
    for item, text in items:
        words = fold(text)
        for i in range(max(1, len(words) - 9)) if words else ():
            windows.setdefault(tuple(words[i : i + 10]), set()).add("" if item is None else str(item))
    count = Counter(w for _, text in docs for w in fold(text))
    out = []
    for doc, text in docs:
        words, hit, found, close = fold(text), set(), set(), set()
        for window, of in windows.items():
            for i in range(len(words) - len(window) + 1):
                if tuple(words[i : i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    found |= of
            if is_near(words, window, count):
                close |= of
        digest, close = digest_of(found), close - found
        out.append((doc, len(words), len(hit), len(found), digest, bool(hit), len(close), digest_of(close)))
    return sorted(out, key=str)


def sample(seed: int = 4):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(40)] + ["the", "É", "é", "K", "k", "0"]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, text(rng.choice([3, 10, 25, 60]))) for i in range(12)]
    items += [(3, items[3][1]), (100, items[5][1]), (None, text(12)), (50, None), (51, ""), (52, "zebra"), (53, "The")]
    docs = [(1, None), (None, ""), (2, " ,;\n"), (3, "ZEBRA"), (4, items[1][1].upper().replace(" ", ",-\n"))]
    for i in range(10, 50):
        words = text(rng.choice([5, 80, 400])).split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            at = rng.randrange(len(words))
            words[at:at] = (rng.choice(items)[1] or "").split()[: rng.choice([5, 10, 40])]
        docs.append((i, " ".join(words)))
    for i in range(70, 90):  # passages with words altered, moved or left out
        words = (items[2 + i % 10][1] or "").split()
        for _ in range(rng.choice([1, 3, 6])):
            at = rng.randrange(len(words) or 1)
            words[at : at + rng.choice([0, 1])] = rng.choices(vocabulary, k=rng.choice([0, 1, 3]))
        docs.append((i, " ".join(words)))
    items += [(200, items[8][1].replace("w1é", "nowhere")), (201, "nowhere " * 9 + "w1é"), (202, "w2é " * 10)]
    docs += docs[-6:] + [(60, text(20_000) + " " + items[7][1])]
    return docs, items


def items_of(spark, items):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id long, text string, w string, term string")


def test_equals_brute_force(make_docs, spark):
    docs, items = sample()
    got = decontamination.contamination(make_docs(*docs), items_of(spark, items)).collect()
    assert sorted(map(tuple, got), key=str) == slow(docs, items)
    assert sum(r.n_near > 0 for r in got) >= 5


def test_a_word_that_the_corpus_lacks_hides_no_proximity_match(make_docs, spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = make_docs((1, "so " + item.rsplit(" ", 1)[0]), (2, "kap alpha"))
    rows = {r.doc_id: r for r in decontamination.contamination(docs, items_of(spark, [(7, item)])).collect()}
    assert (rows[1].n_near, rows[1].contaminated, rows[2].n_near) == (1, False, 0)
    assert rows[1].near_items_sha256 == digest_of({"7"})


def test_drops_only_contaminated_rows(make_docs, spark):
    docs, items = sample(8)
    items = [x for x in items if len(fold(x[1])) >= 10]
    table = make_docs(*docs)
    kept = decontamination.drop_contaminated(table, items_of(spark, items))
    assert kept.columns == table.columns
    assert sorted((str(r.doc_id) for r in kept.collect())) == sorted(str(r[0]) for r in slow(docs, items) if not r[5])


def test_empty_tables(make_docs, spark):
    docs, items = make_docs((1, "one two")), items_of(spark, [(1, "one two")])
    assert decontamination.contamination(docs.where("false"), items).collect() == []
    row = decontamination.contamination(docs, items.where("false")).first()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (2, 0, 0, False)


def test_proximity_match_needs_most_words_nearby(make_docs, spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    near = "x y alpha beta gamma delta so epsilon zeta eta theta iota kappa z"
    far = "alpha " + "x " * 30 + "kappa beta"
    rows = {r.doc_id: r for r in decontamination.scan(make_docs((1, near), (2, far), (3, item)), items_of(spark, [(1, item)])).collect()}
    assert [s.kind for s in rows[1].spans] == ["proximity"] and rows[1].n_hit == 0
    assert rows[2].spans == []
    assert [tuple(s) for s in rows[3].spans] == [(0, 10, "phrase")]
