from __future__ import annotations

import hashlib
import random
import re
from llm_docs import make_docs  # noqa: F401

from branchlore.llm import source_mixing


def slow(rows: list[tuple]) -> list[tuple]:
    docs = []
    for doc, text, _, source in rows:
        name = str(doc) if doc is not None else text or ""
        h = int(hashlib.md5(f"mix|{name}".encode()).hexdigest()[:15], 16)
        docs.append({"doc": doc, "source": source, "h": h, "size": len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))})
    sources = sorted({d["source"] for d in docs}, key=lambda s: (s is None, s or ""))
    size = {s: sum(d["size"] for d in docs if d["source"] == s) for s in sources}
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sources)}
    total, target, free = sum(size.values()), {}, set(sources)
    while free:  # give out the rest by weight until no source is above its limit
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] >= 3 * size[s]}
        target |= {s: float(3 * size[s]) for s in over} if over else share
        free -= over or free
    queue = []
    for s in sources:
        upto = 0
        for d in sorted((d for d in docs if d["source"] == s), key=lambda d: (d["h"], d["doc"] is not None, d["doc"] or 0, d["size"])):
            upto += d["size"]
            d["copies"] = 0
            if d["size"]:
                queue += [((p * size[s] + upto) / target[s], s is None, s or "", p, d["h"], upto, d) for p in range(3)]
    used = 0
    for *_, d in sorted(queue, key=lambda q: q[:6]):
        used += d["size"]
        if used > total:
            break
        d["copies"] += 1
    return [(d["doc"], d["size"], size[d["source"]], target[d["source"]], d["size"] * d["copies"]) for d in docs]


def sample(seed: int = 3):
    rng = random.Random(seed)
    rows = [(None, "null id one", "en", "a"), (1, None, "en", None), (2, "", "en", "empty"), (3, " \t", "en", "a")]
    for i in range(10, 300):
        source = rng.choice(["big"] * 8 + ["a", "b", "ü", "Z", None])
        rows.append((i, "w " * rng.choice([1, 5, 40, 300]), "en", source))
    return rows + [(700, "tiny one", "en", "tiny")] + rows[-3:]


def test_equals_brute_force(make_docs):
    rows = sample()
    want = slow(rows)
    got = [tuple(r) for r in source_mixing.mix(make_docs(*rows)).collect()]
    close = lambda rs: sorted(((i, s, z, round(t, 6), k) for i, s, z, t, k in rs), key=str)
    assert close(got) == close(want)
    assert all(k <= 3 * s for _, s, _, _, k in got)


def test_reruns_agree_however_rows_are_spread(make_docs):
    docs = make_docs(*sample(5))
    one = sorted(map(str, source_mixing.mix(docs.repartition(7)).collect()))
    assert one == sorted(map(str, source_mixing.mix(docs.coalesce(1)).collect()))


def test_ordered_mix_holds_the_copies_in_queue_order(make_docs):
    docs = make_docs(*sample(7)).withColumnRenamed("n", "mix_pass")
    mixed = source_mixing.ordered_mix(docs)
    assert mixed.columns == [*docs.columns, "_mix_pass", "_mix_finish"]
    rows = mixed.collect()
    assert [r._mix_finish for r in rows] == sorted(r._mix_finish for r in rows)
    taken = source_mixing.mix(docs).selectExpr("sum(taken) t", "sum(if(size > 0, taken div size, 0)) c").first()
    assert (sum(len(r.text.split()) for r in rows), len(rows)) == (taken.t, taken.c)


def test_empty_tables(make_docs):
    docs = make_docs((1, None), (2, " "))
    assert source_mixing.mix(docs.where("false")).collect() == []
    assert [(r.size, r.target, r.taken) for r in source_mixing.mix(docs).collect()] == [(0, 0.0, 0)] * 2
    assert source_mixing.ordered_mix(docs).collect() == []
