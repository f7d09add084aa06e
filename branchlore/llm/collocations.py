"""Phrases whose words occur together more often than apart, from a weighted de Bruijn graph.

Texts fall into pieces at punctuation.  Every place of a piece gives the longest gram that starts
there: five words, or fewer where the piece ends.  Grams of five words are the edges of a graph, from
their first four words to their last four, with counts as weights; the shorter ones correct the
flow of the nodes for the pieces that end there.  Frequent edges that follow each other through a
node with no other traffic are joined into paths; paths, other edges and piece ends are the
compacted graph.  A shorter phrase's count is the flow out of it: what starts with it in that graph.

A phrase is frequent only if all its words and pairs are.  So pieces may also end at rare words
and between rare pairs without changing any count that matters, which keeps the graph small.  Rare
ones are recognised by bit fields of fixed size; a rare one that a bit hides is only counted in vain.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from branchlore.llm.common import kept_columns, whole
from branchlore.staging import release, stage, staging_path, stored

LONGEST = 5
LEAST = 100
TOP = 2000
NO_LANGUAGE = "und"
FIELD_BITS = 24  # bits of a field of frequent words or pairs: 2 MB
PAIR_BITS = 30  # pairs are counted by a hash of so many bits
HELD = 1 << 22  # words a task looks at together
RANK_PARTS = 64

# Bytes of a text to bytes of its pieces: A-Z become a-z, a tab a space, the end of a piece a byte that no text has.
BREAK = b"\xff"
PIECES = bytes(
    byte + 32 if 65 <= byte <= 90 else 255 if byte in b".,;:!?\n\x0b\x0c\r" else 32 if byte == 9 else byte for byte in range(256)
)


class Words(dict):
    """Numbers of the words of one language; rare words and ends of pieces have -1."""

    def __init__(self, lang: str, field: np.ndarray | None):
        import xxhash

        self.hash, self.seed, self.field = xxhash.xxh64_intdigest, xxhash.xxh64_intdigest(lang.encode(), 42), field
        self.forget()

    def forget(self) -> None:
        self.clear()
        self[BREAK] = -1
        self.texts: list[bytes] = []
        self.hashes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        number = -1
        if self.field is None:
            number = len(self.texts)
        else:
            code = self.hash(word, self.seed)
            if _seen(self.field, np.uint64(code)):
                number = len(self.texts)
                self.hashes.append(code)
        if number >= 0:
            self.texts.append(word)
        self[word] = number
        return number

    def numbers(self, text: bytes) -> np.ndarray:
        """A text's words in order, and -1 after every piece."""
        words = (text.translate(PIECES) + BREAK).replace(BREAK, b" \xff ").split()
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def _seen(field: np.ndarray, codes: np.ndarray) -> np.ndarray:
    low = codes & np.uint64((1 << FIELD_BITS) - 1)
    return (field[low >> np.uint64(6)] >> (low & np.uint64(63)) & np.uint64(1)).astype(bool)


def bit_field(codes: DataFrame) -> np.ndarray:
    """One bit for each ``code`` that occurs; at most 2^18 numbers reach the driver, whatever the input."""
    low = F.col("code").bitwiseAND(F.lit((1 << FIELD_BITS) - 1))
    bit = F.expr("shiftleft(1L, cast(code & 63 as int))")
    found = codes.select(low.alias("code")).groupBy(F.shiftright("code", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    field = np.zeros(1 << (FIELD_BITS - 6), np.uint64)
    field[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return field


def _counted(rows: DataFrame, field: Broadcast | None, count: Callable[[str, Words, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """What ``count`` makes of the numbered words of some texts of one language, for all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Words] = {}
        held: dict[str, list[np.ndarray]] = {}
        words = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, numbers in held.items():
                made = count(lang, known[lang], np.concatenate(numbers))
                for at in range(0, made.num_rows, 1 << 16):
                    yield made.slice(at, 1 << 16)

        for batch in batches:
            for at in range(batch.num_rows):
                lang = batch.column(0)[at].as_py()
                if lang not in known:
                    known[lang] = Words(lang, field.value if field else None)
                numbers = known[lang].numbers(batch.column(1)[at].as_py())
                held.setdefault(lang, []).append(numbers)
                words += len(numbers)
                if words >= HELD:
                    yield from flush()
                    held, words = {}, 0
                    if sum(map(len, known.values())) > HELD:
                        known = {}
        yield from flush()

    return rows.mapInArrow(run, schema)


def _of(lang: str, n: int) -> pa.Array:
    return pa.array([lang], pa.string()).take(pa.array(np.zeros(n, np.int32)))


def word_counts(rows: DataFrame) -> DataFrame:
    def count(lang: str, words: Words, numbers: np.ndarray) -> pa.RecordBatch:
        counts = np.bincount(numbers[numbers >= 0], minlength=1)
        found = np.flatnonzero(counts)
        texts = pa.array(words.texts, pa.binary()).take(pa.array(found)).cast(pa.string())
        return pa.RecordBatch.from_arrays([_of(lang, len(found)), texts, pa.array(counts[found])], names=["lang", "phrase", "f"])

    return _summed(_counted(rows, None, count, "lang string, phrase string, f long"))


def _pair_codes(words: Words, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where two frequent words stand side by side, and the pairs' hashes."""
    at = np.flatnonzero((numbers[:-1] >= 0) & (numbers[1:] >= 0))
    hashes = np.array(words.hashes, np.uint64)
    mixed = hashes[numbers[at]] + (hashes[numbers[at + 1]] ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return at, mixed >> np.uint64(64 - PAIR_BITS)


def pair_codes(rows: DataFrame, frequent_words: np.ndarray, least: int = LEAST) -> DataFrame:
    """Hashes that pairs of frequent words have ``least`` times or more, all pairs of a hash together (``code``)."""

    def count(lang: str, words: Words, numbers: np.ndarray) -> pa.RecordBatch:
        codes, counts = np.unique(_pair_codes(words, numbers)[1].astype(np.int64), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts.astype(np.int64))], names=["code", "f"])

    field = rows.sparkSession.sparkContext.broadcast(frequent_words)
    counted = _counted(rows, field, count, "code long, f long").groupBy("code").agg(F.sum("f").alias("f"))
    return counted.where(F.col("f") >= least).select("code")


def gram_counts(rows: DataFrame, frequent_words: np.ndarray, frequent_pairs: np.ndarray) -> DataFrame:
    """Edges and piece ends: grams of ``LONGEST`` words, and shorter ones of two words at least where a piece ends."""
    context = rows.sparkSession.sparkContext
    field, pairs_field = context.broadcast(frequent_words), context.broadcast(frequent_pairs)

    def count(lang: str, words: Words, numbers: np.ndarray) -> pa.RecordBatch:
        at, codes = _pair_codes(words, numbers)
        linked = np.zeros(len(numbers) + LONGEST, bool)
        linked[at] = _seen(pairs_field.value, codes)
        at = at[linked[at]]
        padded = np.concatenate([numbers, np.full(LONGEST, -1, np.int32)])
        grams = [numbers[at], numbers[at + 1]]
        goes_on = np.ones(len(at), bool)
        for step in range(1, LONGEST - 1):
            goes_on = goes_on & linked[at + step]
            grams.append(np.where(goes_on, padded[at + step + 1], np.int32(-1)))
        order = np.lexsort(grams[::-1])
        grams = [g[order] for g in grams]
        new = np.ones(len(order), bool)
        new[1:] = np.any([g[1:] != g[:-1] for g in grams], axis=0)
        first = np.flatnonzero(new)
        counts = np.diff(np.append(first, len(order)))
        grams = [g[first] for g in grams]
        texts = pa.array(words.texts, pa.binary())
        spelled = [texts.take(pa.array(np.maximum(g, 0), mask=g < 0)) for g in grams]
        joined = pc.binary_join_element_wise(*spelled, pa.scalar(b" ", pa.binary()), null_handling="skip").cast(pa.string())
        sizes = np.sum([g >= 0 for g in grams], axis=0).astype(np.int32)
        return pa.RecordBatch.from_arrays([_of(lang, len(first)), joined, pa.array(sizes), pa.array(counts)], names=["lang", "phrase", "k", "f"])

    partial = _counted(rows, field, count, "lang string, phrase string, k int, f long")
    return partial.groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f"))


def _first(phrase: str | Column, k: int) -> Column:
    return F.substring_index(phrase, " ", k)


def _last(phrase: str | Column, k: int) -> Column:
    return F.substring_index(phrase, " ", -k)


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def node_flow(grams: DataFrame) -> DataFrame:
    """Counts of the nodes: the flow out over edges, and the pieces that end there."""
    out = grams.where(F.col("k") == LONGEST).select("lang", _first("phrase", LONGEST - 1).alias("phrase"), "f")
    return _summed(out.unionByName(grams.where(F.col("k") == LONGEST - 1).select("lang", "phrase", "f")))


def compacted(grams: DataFrame, nodes: DataFrame, least: int = LEAST) -> DataFrame:
    """The paths that frequent edges make: ``lang``, ``phrase`` (``LONGEST`` words or more), ``f``.

    A node inside a path has one edge in and one out, each with all its traffic: no piece starts
    or ends there, so the paths have no circles.  Every frequent edge points to the one before
    it, and pointers are doubled until all point to the first edge of their path: as many rounds as
    the longest path's length has binary digits.
    """
    spark = grams.sparkSession
    frequent = grams.where((F.col("k") == LONGEST) & (F.col("f") >= least)).select("lang", "phrase", "f")
    traffic = nodes.where(F.col("f") >= least).select("lang", F.col("phrase").alias("node"), F.col("f").alias("through"))
    leaving = frequent.select("lang", _first("phrase", LONGEST - 1).alias("node"), "phrase", "f").join(traffic, ["lang", "node"])
    arriving = frequent.select("lang", _last("phrase", LONGEST - 1).alias("node"), F.col("phrase").alias("before"), F.col("f").alias("g"))
    links = leaving.where("f = through").join(arriving, ["lang", "node"]).where("g = through").select("lang", "phrase", "before")
    pointers = frequent.join(links, ["lang", "phrase"], "left").select(
        "lang", "phrase", "f", F.coalesce("before", "phrase").alias("at"), F.when(F.col("before").isNull(), 0).otherwise(1).cast("long").alias("steps")
    )
    path = staging_path(spark, "phrase-paths")
    pointers = stored(pointers, path)
    seen = None
    while (now := pointers.agg(F.sum("steps")).first()[0]) != seen:
        seen = now
        ahead = pointers.select("lang", F.col("phrase").alias("at"), F.col("at").alias("further"), F.col("steps").alias("more"))
        done, path_before = pointers.where("steps = 0"), path
        moved = pointers.where("steps > 0").join(ahead, ["lang", "at"]).select(
            "lang", "phrase", "f", F.col("further").alias("at"), (F.col("steps") + F.col("more")).alias("steps")
        )
        path = staging_path(spark, "phrase-paths")
        pointers = stored(done.unionByName(moved), path)
        release(spark, path_before)
    # a path is as long as a piece of a text at most
    joined = pointers.groupBy("lang", "at", "f").agg(F.sort_array(F.collect_list(F.struct("steps", _last("phrase", 1).alias("word")))).alias("words"))
    rest = F.array_join(F.slice(F.col("words.word"), 2, F.size("words")), " ")
    return joined.select("lang", F.when(F.size("words") > 1, F.concat_ws(" ", "at", rest)).otherwise(F.col("at")).alias("phrase"), "f")


def _starts(paths: DataFrame, k: int) -> DataFrame:
    """What of ``k`` words starts at the starts of the edges of paths."""
    words = F.split("phrase", " ")
    spread = paths.select("lang", words.alias("w"), "f")
    first = F.explode(F.sequence(F.lit(1), F.size("w") - (LONGEST - 1)))
    return spread.select("lang", "f", "w", first.alias("i")).select("lang", F.array_join(F.expr(f"slice(w, i, {k})"), " ").alias("phrase"), "f")


def phrase_counts(grams: DataFrame, nodes: DataFrame, paths: DataFrame, least: int = LEAST) -> list[DataFrame]:
    """Counts of phrases of two, three ... ``LONGEST`` words, from the flow of the compacted graph."""
    ends = lambda k: grams.where(F.col("k") == k).select("lang", "phrase", "f")
    node_words = LONGEST - 1
    found = [ends(LONGEST), nodes]
    # the flow into the nodes below: paths and edges, pieces that end at a node, pieces that end at the phrase
    shorter = node_words - 1
    others = grams.where((F.col("k") == node_words) | (F.col("k") == LONGEST) & (F.col("f") < least))
    flow = _starts(paths, shorter).unionByName(others.select("lang", _first("phrase", shorter).alias("phrase"), "f"))
    while True:
        counts = _summed(flow.unionByName(ends(shorter)))
        found.append(counts)
        if shorter == 2:
            return found[::-1]
        shorter -= 1
        flow = counts.select("lang", _first("phrase", shorter).alias("phrase"), "f")


def _within(candidates: DataFrame) -> DataFrame:
    """Phrases that lie inside longer candidates, and the count of the most frequent of these."""
    inner = [
        F.when((F.size("w") > k) & (F.size("w") >= start + k - 1), F.array_join(F.slice(F.col("w"), start, k), " "))
        for k in range(2, LONGEST)
        for start in range(1, LONGEST - k + 2)
    ]
    chosen = F.array_compact(F.array(*inner))
    longer = candidates.where("k > 2").select("lang", "f", F.split("phrase", " ").alias("w"))
    return longer.select("lang", "f", F.explode(F.array_distinct(chosen)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def scored(candidates: DataFrame, parts: DataFrame, totals: DataFrame) -> DataFrame:
    """``a``, ``l``, ``r``, ``n`` and ``score`` of the weakest cut of every candidate; exact beyond 64 bits."""
    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1))
    cuts = candidates.select("lang", "phrase", "k", F.col("f").alias("a"), cut.alias("cut"))
    cuts = cuts.select("*", F.expr("substring_index(phrase, ' ', cut)").alias("left"), F.expr("substring_index(phrase, ' ', cut - k)").alias("right"))
    of = lambda part, f: parts.select("lang", F.col("phrase").alias(part), F.col("f").alias(f))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"]).join(totals, "lang")
    exact = F.expr("cast(a * 1000BD as decimal(19,0)) * cast(n as decimal(18,0)) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    weakest = F.min(F.struct(exact.alias("score"), "cut", "l", "r"))
    return cuts.groupBy("lang", "phrase", "a", "n").agg(weakest.alias("m")).select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score")


def ranked(scores: DataFrame, top: int = TOP) -> DataFrame:
    """Each language's first ``top``; parts of a language are cut to as many before they meet."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    few = scores.withColumn("part", part).withColumn("nth", nth("lang", "part")).where(F.col("nth") <= top).drop("nth", "part")
    return few.withColumn("rank", nth("lang").cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """Per language the ``top`` phrases of two to five words: ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    A phrase counts once for every place where it stands within a piece, ``least`` times or more.
    Its score is that of the cut which explains it best by chance; phrases that
    never stand but inside a longer candidate go.  Rows without a language are of ``und``;
    missing and empty texts have no words; a text of any length is counted whole; repeated
    rows count each; ties are ordered by count and phrase; an empty table gives none; other
    columns are not looked at.
    """
    texts = kept_columns(docs, "lang", "text")
    rows = texts.select(F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"), whole("text").cast("binary").alias("text"))
    words = stage(word_counts(rows), "phrase-words")
    frequent = words.where(F.col("f") >= least)
    word_field = bit_field(frequent.select(F.xxhash64("lang", "phrase").alias("code")))
    grams = stage(gram_counts(rows, word_field, bit_field(pair_codes(rows, word_field, least))), "phrase-grams")
    nodes = stage(node_flow(grams), "phrase-nodes")
    paths = stage(compacted(grams, nodes, least), "phrase-graph")
    counts = phrase_counts(grams, nodes, paths, least)
    candidates = None
    for k, of_k in enumerate(counts, start=2):
        enough = of_k.where(F.col("f") >= least).select("lang", "phrase", "f", F.lit(k).alias("k"))
        candidates = enough if candidates is None else candidates.unionByName(enough)
    candidates = stage(candidates, "phrase-candidates")
    parts = stage(candidates.select("lang", "phrase", "f").unionByName(frequent), "phrase-parts")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    covered = candidates.join(_within(candidates), ["lang", "phrase"], "left")
    kept = covered.where(F.col("most").isNull() | (F.col("most") < F.col("f"))).drop("most")
    return ranked(scored(kept, parts, totals), top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
