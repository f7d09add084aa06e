"""Scores of texts under a class-based bigram model (Brown et al. 1992).

A word's probability is that of its class after the class before, times that of the word within
its class.  Classes come from exchange clustering: in each round every word of one half looks for
the class in which the class bigrams become most likely, all words of a half at once from the
counts of the round before; a round that does not raise the likelihood is taken back.  Rounds over the
dictionary and over all other words take turns until neither gains more than a tolerance.

All words of the training texts are counted and exchanged.  The most frequent ones are numbered by
a dictionary of bounded size that tasks hold; the rest, rare each, have a hash that no two of them
share, and their classes are a table.

Unknown words are a class of their own, for which the words seen once stand: after a class, an unknown
word is as likely as one of these was; what follows an unknown word is what followed these; and all
unknown words are equally likely, as if there were as many as known ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from branchlore.llm.common import kept_columns, whole
from branchlore.staging import release, stage, staging_path, stored

DICTIONARY = 1 << 18  # words that tasks number by themselves
LONGEST = 64  # bytes of such a word; so the dictionary is never above 16 MB
CLASSES = 32  # of words; after them the class of the end and that of unknown words
N_CLASSES = CLASSES + 2
CLASS_BITS = 6
WORDS_AT_ONCE = 1024  # words for which a task seeks classes at a time
SMALL_COUNT = 32  # up to which the gain of a count is looked up
LISTED_AT_ONCE = 1 << 21  # neighbours that a task lists at a time
PART_NEIGHBOURS = 1 << 20  # neighbours of a part of the words, on average and before equal ones are added up
MERGED_AT_ONCE = 1 << 21  # listed neighbours of a part that are held before equal ones are added up
COUNTED_AT_ONCE = 1 << 24  # bytes of texts whose words are told apart together when they are counted,
NUMBERED_AT_ONCE = 1 << 23  # and when they are numbered beside the dictionary
READ_AT_ONCE = 1 << 19  # listed neighbours that a task looks at together, or those of one word
FAN_IN = 256  # lists of one word that are merged at a time
LISTS = "code long, others binary, ns binary"  # int32 and int64 values of a word
BLOCKS = "part int, codes binary, others binary, ns binary"  # int64, int32 and int64 values of many words
LEAST_GAIN = 0.05  # of log likelihood for each token, below which a round counts as gaining nothing; 0 is the exact end
KEY = "class_lm_row_key"
HELD_OUT, FOLDS = 2, 7


def is_held_out(doc_id: str = "doc_id"):
    """Rows that the model does not learn from; a missing id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT


# Bytes of a text to bytes of its words: A-Z become a-z, white space a space.
WORDS = bytes(byte + 32 if 65 <= byte <= 90 else 32 if 9 <= byte <= 13 else byte for byte in range(256))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of some texts, each with a space behind it, the numbers of all their words in order, and how many each text has."""
    found = texts.to_pylist()
    data = np.frombuffer((b" ".join(found) + b" ").translate(WORDS), np.uint8)
    space = data == 32
    ends = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    space[ends] = False  # one stays behind each word
    data = data[~space]
    bounds = np.append(0, np.flatnonzero(data == 32) + 1).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
    upto = np.searchsorted(ends, np.cumsum([len(t) + 1 for t in found]))
    return words.dictionary, words.indices.to_numpy(), np.diff(upto, prepend=0)


@dataclass
class Layout:
    """Codes of tokens: words of the dictionary, then the end; the codes of other words are negative."""

    counts: np.ndarray  # of the dictionary's words, falling

    @property
    def end(self) -> int:
        return len(self.counts)

    @property
    def n_classes(self) -> int:
        return N_CLASSES


@dataclass
class Classes:
    """The class of every training word."""

    table: DataFrame  # ``code``, ``cls`` of all words and the end
    frequent: np.ndarray  # classes of the dictionary's words
    once: np.ndarray  # how often words seen once follow each class, and how often they precede it



def _spelled(words: pa.Array) -> list[bytes]:
    """Words with a space behind each as a list, without it."""
    if not len(words):
        return []
    _, bounds, data = words.buffers()
    last = int(np.frombuffer(bounds, np.int32, len(words) + 1)[-1])
    return data.slice(0, last).to_pybytes().split(b" ")[:-1]


def rare_code(word: Column, seed: int) -> Column:
    """A negative code for a word that the dictionary does not hold."""
    return F.xxhash64(word, F.lit(seed)).bitwiseOR(F.lit(-(1 << 63)))


def rare_codes(words: list[bytes], seed: int) -> np.ndarray:
    """What ``rare_code`` gives, in a task."""
    import xxhash

    hashed, last = xxhash.xxh64_intdigest, seed.to_bytes(4, "little")
    return np.array([hashed(last, hashed(w, 42)) for w in words], np.uint64).view(np.int64) | np.int64(-(1 << 63))


def free_seed(counts: DataFrame) -> int:
    """A seed with which no two words have one code."""
    seed = 0
    while True:
        words, codes = counts.agg(F.count(F.lit(1)), F.count_distinct(rare_code(F.col("word"), seed))).first()
        if words == codes:
            return seed
        seed += 1


def count_words(texts: DataFrame) -> DataFrame:
    """``word``, ``n`` over all texts; words that only texts ``held_out`` have count nothing and are there."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(batches, COUNTED_AT_ONCE):
            words, number, sizes = words_of(part.column("text"))
            words = pc.binary_slice(words, 0, -1)
            counted = np.repeat(part.column("learnt").to_numpy(zero_copy_only=False), sizes)
            n = np.bincount(number[counted], minlength=len(words))
            for at in range(0, len(words), 1 << 16):
                columns = [words.slice(at, 1 << 16), pa.array(n[at : at + (1 << 16)])]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "n"])

    learnt = ~F.col("held_out") if "held_out" in texts.columns else F.lit(True)
    counted = texts.select(learnt.alias("learnt"), F.col("text").cast("binary")).mapInArrow(count, "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int) -> tuple[list[bytes], np.ndarray]:
    """At most so many of the most frequent words, none above ``LONGEST`` bytes, and their counts, falling.

    Counts are kept to eight significant bits and words counted by these, a bounded table; the
    last value that fits decides, so no task and no driver ever ranks the words.
    """
    rounding = F.greatest(F.length(F.bin("n")) - 8, F.lit(0))
    words = counts.where(F.octet_length("word") <= LONGEST).withColumn("drop", rounding)
    words = words.select("word", "n", F.expr("shiftleft(shiftright(n, drop), drop)").alias("about"))
    sizes = words.groupBy("about").agg(F.count(F.lit(1)).alias("words"))
    upto = sizes.withColumn("upto", F.sum("words").over(Window.orderBy(F.desc("about"))))
    least = upto.where(F.col("upto") <= most).agg(F.min("about")).first()[0]
    if least is None:
        return [], np.zeros(0, dtype=np.int64)
    table = words.where(F.col("about") >= least).select("word", "n").toArrow()
    found, n = table.column("word").to_pylist(), table.column("n").to_numpy()
    order = sorted(range(len(found)), key=lambda i: (-n[i], found[i]))
    return [found[i] for i in order], n[order].astype(np.int64)


def numbered(texts: DataFrame, dictionary: list[bytes], layout: Layout, seed: int) -> DataFrame:
    """Every text as ``codes`` (int32), its end last and -1 for words outside the dictionary, whose codes are ``rare`` (int64) in order."""
    numbers = texts.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(dictionary)})
    end, kept = layout.end, [c for c in texts.columns if c != "text"]
    kinds = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in kept)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = numbers.value
        for part in _pieces(batches, NUMBERED_AT_ONCE):
            words, at, sizes = words_of(part.column("text"))
            words = _spelled(words)
            of = np.fromiter(map(known.get, words, repeat(-1)), dtype=np.int32, count=len(words))
            outside = np.flatnonzero(of < 0)
            hashed = np.zeros(len(words), dtype=np.int64)
            hashed[outside] = rare_codes([words[i] for i in outside], seed)
            ends = np.cumsum(sizes + 1)
            codes = np.full(len(at) + len(sizes), end, dtype=np.int32)
            inside = np.ones(len(codes), dtype=bool)
            inside[ends - 1] = False
            codes[inside] = of[at]
            gaps = codes < 0
            rare = np.append(0, np.cumsum(gaps))[ends]
            made = [_packed(codes, np.append(0, ends), np.int32), _packed(hashed[at[of[at] < 0]], np.append(0, rare), np.int64)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *made], names=[*kept, "codes", "rare"])

    sent = texts.select(*kept, F.col("text").cast("binary").alias("text"))
    return stage(sent.mapInArrow(number, f"{kinds}, codes binary, rare binary"), "lm-numbered")


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """So many bytes of ``text`` together, or one text that has more."""
    for batch in batches:
        sizes = np.array([len(x.as_buffer()) for x in batch.column("text")], dtype=np.int64)
        upto, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            stop = max(int(np.searchsorted(upto, upto[start] - sizes[start] + most, "right")), start + 1)
            yield batch.slice(start, stop - start)
            start = stop


def listed_rare(train: DataFrame, *kept: str) -> DataFrame:
    """``nth`` and ``code`` of the words of each text that the dictionary lacks."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            code, starts = _flat(part.column("rare"), np.int64)
            text = np.repeat(np.arange(part.num_rows), np.diff(np.append(starts, len(code))))
            columns = [*(part.column(c).take(pa.array(text)) for c in kept), pa.array((np.arange(len(code)) - starts[text]).astype(np.int32)), pa.array(code)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "nth", "code"])

    kinds = "".join(f"{c} {train.schema[c].dataType.simpleString()}, " for c in kept)
    return train.select(*kept, "rare").mapInArrow(spread, f"{kinds}nth int, code long")


def with_places(texts: DataFrame, words: DataFrame, parts: int) -> DataFrame:
    """Numbered texts with ``places``, counts and classes of their rare words in order (int64; ``_place``)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in (KEY, "nth", "place")])
            size += batch.num_rows
            if size >= LISTED_AT_ONCE:
                yield _dealt(*map(np.concatenate, zip(*held)), parts)
                held, size = [], 0
        if held:
            yield _dealt(*map(np.concatenate, zip(*held)), parts)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for at, part in enumerate(batch.column("part").to_pylist()):
                if part != now and held:
                    yield texts_of(held)
                    held = []
                now = part
                held.append(_block(batch.slice(at, 1)))
        if held:
            yield texts_of(held)

    def texts_of(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, nth, place = map(np.concatenate, zip(*held))
        order = np.lexsort((nth, key))
        key = key[order]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        columns = [pa.array(key[starts]), _packed(place[order], np.append(starts, len(key)), np.int64)]
        return pa.RecordBatch.from_arrays(columns, names=[KEY, "places"])

    found = listed_rare(texts.where("octet_length(rare) > 0"), KEY).join(words, "code", "left").select(KEY, "nth", _place().alias("place"))
    found = found.mapInArrow(deal, BLOCKS).repartition("part").sortWithinPartitions("part").mapInArrow(gather, f"{KEY} long, places binary")
    return texts.drop("rare").join(found, KEY, "left").withColumn("places", F.coalesce("places", F.expr("X''")))


def _place() -> Column:
    """Count and class of a word as one number; of an unknown word the last class."""
    return F.expr(f"shiftleft(coalesce(n, 0L), {CLASS_BITS}) + coalesce(cls, {CLASSES + 1})")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, so that what a task holds does not depend on the batch size."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            yield batch.slice(start, 256)


def _flat(column: pa.Array, kind: type = np.int32) -> tuple[np.ndarray, np.ndarray]:
    """The codes of a batch in a row, and where each text begins."""
    if pa.types.is_binary(column.type):
        row, codes = _unpacked(column, kind)
        lengths = np.bincount(row, minlength=len(column))
    else:
        lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        codes = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return codes, np.cumsum(lengths) - lengths


def _after(codes: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
    """What stands before each token; a text begins after an end."""
    before = np.empty_like(codes)
    before[1:] = codes[:-1]
    before[starts] = end
    return before


def rare_bigrams(train: DataFrame, layout: Layout) -> DataFrame:
    """``left``, ``right``, ``n`` of neighbours that the dictionary both lacks."""

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            left, right = _neighbours(part, layout.end)
            both = (left < 0) & (right < 0)
            yield pa.RecordBatch.from_arrays([pa.array(left[both]), pa.array(right[both])], names=["left", "right"])

    pairs = train.select("codes", "rare").mapInArrow(pair, "left long, right long")
    return pairs.groupBy("left", "right").agg(F.count(F.lit(1)).alias("n"))


def _neighbours(part: pa.RecordBatch, end: int) -> tuple[np.ndarray, np.ndarray]:
    """All tokens, negative codes for words outside the dictionary, and what stands before each."""
    codes, starts = _flat(part.column("codes"))
    codes[codes < 0] = _flat(part.column("rare"), np.int64)[0]
    return _after(codes, starts, end), codes


def parts_of(layout: Layout) -> int:
    """Into how many parts lists are dealt."""
    return 1 + int(layout.counts.sum()) * 2 // PART_NEIGHBOURS


def neighbour_lists(train: DataFrame, layout: Layout) -> DataFrame:
    """Per word ``code`` its neighbours of the dictionary: ``others`` and ``ns``, how often each.

    A neighbour is twice its code, and one more where it follows the word.  Tasks list the words of so
    many tokens at a time; lists of one word are merged by ``FAN_IN`` at a time, so a word that is
    everywhere never meets in one task at its full length, and a merged list is no longer than the dictionary.
    """
    end, parts = layout.end, parts_of(layout)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for part in _parts(batches):
            left, right = _neighbours(part, end)
            held.append((left, right))
            size += 2 * len(left)
            if size >= LISTED_AT_ONCE:
                yield from lists(held)
                held, size = [], 0
        yield from lists(held)

    def lists(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        left, right = (np.concatenate(x) for x in zip(*held))
        both = (left >= 0) & (right >= 0)
        key = np.sort(left[both] << 20 | right[both])
        first = np.flatnonzero(np.diff(key, prepend=-1))
        ns = np.diff(np.append(first, len(key)))
        before, after = key[first] >> 20, key[first] & ((1 << 20) - 1)
        follows, precedes = (left >= 0) & ~both, (right >= 0) & ~both
        ones = np.ones(len(left), dtype=np.int64)
        for word, other, n in (
            (after, before * 2, ns),
            (before, after * 2 + 1, ns),
            (right[follows], left[follows] * 2, ones[follows]),
            (left[precedes], right[precedes] * 2 + 1, ones[precedes]),
        ):
            yield _dealt(word, other, n, parts)

    found = train.select("codes", "rare").mapInArrow(listed, BLOCKS)
    salts = -(-(int(layout.counts.sum()) * 2) // (LISTED_AT_ONCE * FAN_IN))
    while salts > 1:
        salt = F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt")
        found = stage(merged(found.withColumn("salt", salt).repartition("part", "salt")), "lm-lists")
        salts = -(-salts // FAN_IN)
    return merged(found.repartition("part"))


def _dealt(words: np.ndarray, others: np.ndarray, ns: np.ndarray, parts: int) -> pa.RecordBatch:
    """A row per part of the words, which a shuffle moves faster than a row per word; others than the dictionary's have parts of their own."""
    part = words % parts * 2 + (words < 0)
    order = np.argsort(part.astype(np.min_scalar_type(2 * parts)), kind="stable")
    part = part[order]
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    bounds = np.append(starts, len(part))
    lists = [_packed(x[order], bounds, kind) for x, kind in ((words, np.int64), (others, np.int32), (ns, np.int64))]
    return pa.RecordBatch.from_arrays([pa.array(part[starts], pa.int32()), *lists], names=["part", "codes", "others", "ns"])


def _block(row: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    return tuple(_unpacked(row.column(c), kind)[1] for c, kind in (("codes", np.int64), ("others", np.int32), ("ns", np.int64)))


def merged(blocks: DataFrame) -> DataFrame:
    """One list per word of each partition, which holds all blocks that are to be merged; with salts, a block per part."""
    again = "salt" in blocks.columns  # the sums of a word are complete one merge later

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size, most = None, [], 0, MERGED_AT_ONCE
        for batch in batches:
            parts, salts = batch.column("part").to_pylist(), batch.column("salt").to_pylist() if again else repeat(0)
            for at, key in enumerate(zip(parts, salts)):
                if key != now and held:
                    yield from lists(now[0], held)
                    held, size, most = [], 0, MERGED_AT_ONCE
                now = key
                held.append(_block(batch.slice(at, 1)))
                size += len(held[-1][0])
                if size > most:
                    held = [_summed(*map(np.concatenate, zip(*held)))]
                    size = len(held[0][0])
                    most = max(most, 2 * size)
        if held:
            yield from lists(now[0], held)

    def lists(part: int, held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        words, others, ns = map(np.concatenate, zip(*held))
        if again:
            words, others, ns = _summed(words, others, ns)
            # of a bounded size each, as what the next merge reads
            for at in range(0, len(words), MERGED_AT_ONCE):
                some = slice(at, at + MERGED_AT_ONCE)
                bounds = np.array([0, len(words[some])])
                packed = [_packed(x[some], bounds, kind) for x, kind in ((words, np.int64), (others, np.int32), (ns, np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *packed], names=["part", "codes", "others", "ns"])
        else:
            made = _word_lists(words, others, ns)
            for at in range(0, made.num_rows, 1 << 14):
                yield made.slice(at, 1 << 14)

    keys = ["part", "salt"] if again else ["part"]
    return blocks.sortWithinPartitions(*keys).mapInArrow(merge, BLOCKS if again else LISTS)


def _summed(words: np.ndarray, others: np.ndarray, ns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each neighbour of a word once, words and neighbours in order."""
    number, kinds = words, None
    if len(words) and words.min() < 0:
        kinds, number = np.unique(words, return_inverse=True)
    key = (number << 20) | others  # a neighbour has 20 bits at most, as the dictionary has 18
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    ns = np.add.reduceat(ns[order], first) if len(first) else ns
    key = key[first]
    number = key >> 20
    return number if kinds is None else kinds[number], key & ((1 << 20) - 1), ns


def _word_lists(words: np.ndarray, others: np.ndarray, ns: np.ndarray) -> pa.RecordBatch:
    """A row per word with its neighbours in order, each once."""
    words, others, ns = _summed(words, others, ns)
    starts = np.flatnonzero(np.append(True, words[1:] != words[:-1])) if len(words) else np.zeros(0, dtype=np.int64)
    bounds = np.append(starts, len(words))
    columns = [pa.array(words[starts], pa.int64()), _packed(others, bounds, np.int32), _packed(ns, bounds, np.int64)]
    return pa.RecordBatch.from_arrays(columns, names=["code", "others", "ns"])


def _packed(values: np.ndarray, bounds: np.ndarray, kind: type) -> pa.Array:
    """The values between each two bounds as bytes, which pass between Spark and Python faster than arrays do."""
    offsets = (bounds * np.dtype(kind).itemsize).astype(np.int32)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values, dtype=kind))]
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, buffers)


def _unpacked(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The number of the row of each value, and all values."""
    if not len(column):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    _, offsets, data = column.buffers()
    size = np.dtype(kind).itemsize
    bounds = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4) // size
    row = np.repeat(np.arange(len(column)), np.diff(bounds))
    if not len(row):
        return row, np.zeros(0, dtype=np.int64)
    return row, np.frombuffer(data, kind, bounds[-1] - bounds[0], int(bounds[0]) * size).astype(np.int64)


def class_counts(pairs: DataFrame, classes: DataFrame, parts: int) -> DataFrame:
    """Per word ``code`` and ``cells``: how often it follows and (from ``N_CLASSES`` on) precedes each class."""

    def beside(known: str, word: str, first: int) -> DataFrame:
        cell = (F.col("cls") + first).alias("cell")
        met = pairs.join(classes.select(F.col("code").alias(known), "cls"), known)
        return met.select(F.col(word).alias("code"), cell, "n")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _dealt(*(x.to_numpy().astype(np.int64) for x in batch.columns), parts)

    counts = beside("left", "right", 0).unionByName(beside("right", "left", N_CLASSES))
    return _gathered(counts.select("code", "cell", "n").mapInArrow(listed, BLOCKS))


def _gathered(blocks: DataFrame) -> DataFrame:
    """``cells`` and ``cell_ns`` per word: its cells, at most two for each class, and how often each."""
    return merged(blocks.repartition("part")).withColumnsRenamed({"others": "cells", "ns": "cell_ns"})


def rare_beside(rare: DataFrame, parts: int = 1) -> DataFrame:
    """Per word of the dictionary ``cells``: how often it stands beside words outside it, by their classes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, 1 << 17):
            word, other, n = _near(part)
            cls = part.column("cls").to_numpy()
            # what precedes the rare word has it behind itself
            key = (other >> 1) * (2 * N_CLASSES) + cls[word] + N_CLASSES * (1 - (other & 1))
            found, at = np.unique(key, return_inverse=True)
            sums = np.bincount(at, weights=n, minlength=len(found)).astype(np.int64)
            # dealt here: a second function in the stage would have its own workers, which stay
            yield _dealt(found // (2 * N_CLASSES), found % (2 * N_CLASSES), sums, parts)

    return _gathered(rare.select("cls", "others", "ns").mapInArrow(count, BLOCKS))


def _near(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the row, neighbour and count, for all neighbours of the dictionary."""
    return *_unpacked(part.column("others"), np.int32), _unpacked(part.column("ns"), np.int64)[1]


def _far(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the row, cell and count, for all neighbours outside the dictionary."""
    return *_unpacked(part.column("cells"), np.int32), _unpacked(part.column("cell_ns"), np.int64)[1]


def _cells(part: pa.RecordBatch, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the row, cell and count, for all neighbours; ``of`` has the classes of the dictionary."""
    sums = sum(_cell_counts(part, np.arange(part.num_rows), part.num_rows, of))
    at = np.flatnonzero(sums)
    return at // (2 * N_CLASSES), at % (2 * N_CLASSES), sums[at].astype(np.int64)


def _cell_counts(part: pa.RecordBatch, groups: np.ndarray, n_groups: int, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each cell stands beside the words of each group, of the dictionary and outside it; a row is in one group."""
    beside = (of[:, None] + [0, N_CLASSES]).ravel()  # the cell of every neighbour of the dictionary
    word, other, n = _near(part)
    first, size = groups * 2 * N_CLASSES, n_groups * 2 * N_CLASSES
    near = np.bincount(first[word] + beside[other], n, size)
    word, cell, n = _far(part)
    return near, np.bincount(first[word] + cell, n, size)


def _own(part: pa.RecordBatch, of: np.ndarray) -> np.ndarray:
    """The classes of the rows' own words; rows of the dictionary have no ``cls``."""
    return part.column("cls").to_numpy() if "cls" in part.schema.names else of[part.column("code").to_numpy()]


def class_pairs(rows: DataFrame, of: np.ndarray) -> np.ndarray:
    """How often each class follows each class, as the rows see it, in four tables.

    Neighbours of the dictionary that precede a row's word, those that follow it, and the same outside the dictionary.
    """
    sent = rows.sparkSession.sparkContext.broadcast(of)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, k = sent.value, N_CLASSES
        cells = np.zeros((2, k * 2 * k))
        for part in _slices(batches, 1 << 16):
            cells += _cell_counts(part, _own(part, of), k, of)
        preceding, following = np.moveaxis(cells.reshape(2, k, 2, k), 2, 0)  # by near or far, own class, class beside
        total = np.stack([preceding.swapaxes(1, 2), following], 1).ravel()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], names=["at", "n"])

    return _tables(rows.mapInArrow(count, "at long, n long"))


def changed_pairs(rows: DataFrame, was: np.ndarray, of: np.ndarray) -> np.ndarray:
    """What changes in ``class_pairs`` of the dictionary when its words' classes change; ``rows`` has all words that move.

    Neighbours of the dictionary are all in the first table.  Where both have moved, the row of the second one counts.
    """
    sent = rows.sparkSession.sparkContext.broadcast((was, of))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, (was, of) = N_CLASSES, sent.value
        moves, total = was != of, np.zeros(4 * k * k)
        for part in _slices(batches, 1 << 16):
            part = part.filter(pa.array(moves[part.column("code").to_numpy()]))
            own = part.column("code").to_numpy()
            word, other, n = _near(part)
            beside, follows = other >> 1, (other & 1).astype(bool)
            n = n * ~(follows & moves[beside])
            far_word, cell, far_n = _far(part)
            for classes, sign in ((of, 1), (was, -1)):
                mine, others = classes[own][word], classes[beside]
                near = np.where(follows, mine * k + others, others * k + mine)
                mine = classes[own][far_word]
                far = np.where(cell < k, (2 * k + cell) * k + mine, (3 * k + mine) * k + cell - k)
                total += sign * (np.bincount(near, n, len(total)) + np.bincount(far, far_n, len(total)))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], names=["at", "n"])

    return _tables(rows.mapInArrow(count, "at long, n long"))


def _tables(counted: DataFrame) -> np.ndarray:
    tables = np.zeros(4 * N_CLASSES * N_CLASSES, dtype=np.int64)
    for r in counted.groupBy("at").agg(F.sum("n").alias("n")).collect():  # bounded by the classes
        tables[r["at"]] = r.n
    return tables.reshape(4, N_CLASSES, N_CLASSES)


def seen_once(rows: DataFrame, of: np.ndarray, end: int) -> np.ndarray:
    """How often words that occur once follow each class, and how often they precede each."""
    sent = rows.sparkSession.sparkContext.broadcast(of)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = sent.value, np.zeros(2 * N_CLASSES)
        for part in _slices(batches, 1 << 16):
            word, other, n = _near(part)
            cell = of[other >> 1] + N_CLASSES * (other & 1)
            word, cell, n = map(np.concatenate, zip((word, cell, n), _far(part)))
            times = np.bincount(word, n * (cell < N_CLASSES), part.num_rows)
            single = (times == 1) & (part.column("code").to_numpy() != end)
            total += np.bincount(cell, n * single[word], 2 * N_CLASSES)
        columns = [pa.array(np.arange(2 * N_CLASSES)), pa.array(total.astype(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=["cell", "n"])

    once = np.zeros(2 * N_CLASSES, dtype=np.int64)
    for r in rows.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # a row per cell
        once[r.cell] = r.n
    return once.reshape(2, N_CLASSES)


def _slices(batches: Iterator[pa.RecordBatch], most: int = WORDS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """So many words at most, and together ``READ_AT_ONCE`` neighbours or the last word alone has more."""
    for batch in batches:
        lists = batch.column("others")
        upto = np.frombuffer(lists.buffers()[1], np.int32, len(lists) + 1, lists.offset * 4)[1:] if len(lists) else np.zeros(0, np.int32)
        start = 0
        while start < batch.num_rows:
            before = int(upto[start - 1]) if start else int(upto[0]) - len(lists[0].as_buffer())
            fit = int(np.searchsorted(upto, before + READ_AT_ONCE * np.dtype(np.int32).itemsize, "right"))
            stop = min(max(fit, start + 1), start + most)
            yield batch.slice(start, stop - start)
            start = stop


def _xlogx(n: np.ndarray) -> np.ndarray:
    return n * np.log(np.maximum(n, 1))


def likelihood(pairs: np.ndarray) -> float:
    """The part of the training texts' log likelihood that depends on the classes."""
    return float(_xlogx(pairs).sum() - _xlogx(pairs.sum(0)).sum() - _xlogx(pairs.sum(1)).sum())


def best_classes(own: np.ndarray, of: np.ndarray, cell: np.ndarray, n: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The exchange classes in which words make the class bigrams likeliest, each word by itself.

    Word ``of[i]``, now in class ``own[of[i]]``, has the count ``n[i]`` in the cell ``cell[i]``.
    """
    n_words, k, pairs = len(own), len(pairs), pairs.astype(float)
    words = np.arange(n_words)
    counts = np.zeros((n_words, 2 * k))
    counts[of, cell] = n
    after, before = counts[:, :k], counts[:, k:]
    gain = np.zeros((n_words, CLASSES))
    # a word that follows itself is twice in its class's own pair
    twice = np.maximum(after[words, own] + before[words, own] - pairs[own, own], 0)
    # a table of class pairs or its transpose, without the word; only cells beside its contexts change
    for side, (table, mine, others) in enumerate(((pairs, after, before), (pairs.T, before, after))):
        at = np.flatnonzero((cell >= k) == bool(side))
        w, beside, more = of[at], cell[at] - side * k, n[at].astype(float)
        part = np.empty((len(at), CLASSES))
        # small counts are looked up, but for the word's own class and for contexts of that class
        same = beside == own[w]
        fast = (more <= SMALL_COUNT) & ~same
        f, slow = np.flatnonzero(fast), np.flatnonzero(~fast)
        part[f] = _rises(table[:, :CLASSES])[more[f].astype(int), beside[f]]
        rest = np.maximum(table[beside[f], own[w[f]]] - more[f], 0)
        part[f, own[w[f]]] = _xlogx(rest + more[f]) - _xlogx(rest)
        rest = table[beside[slow], :CLASSES]
        rest[np.arange(len(slow)), own[w[slow]]] -= more[slow]
        again = np.flatnonzero(same[slow])
        rest[again] -= others[w[slow[again]], :CLASSES]
        rest = np.maximum(rest, 0)
        part[slow] = _xlogx(rest + more[slow, None]) - _xlogx(rest)
        order = np.argsort(w, kind="stable")
        if len(order):
            starts = np.flatnonzero(np.diff(w[order], prepend=-1))
            gain[w[order][starts]] += np.add.reduceat(part[order], starts)
        # the classes' own frequencies, which the word's contexts change as well
        sums, total = table.sum(0)[:CLASSES], mine.sum(1)
        few = total <= SMALL_COUNT
        loss = np.empty((n_words, CLASSES))
        loss[few] = _rises(sums[None])[total[few].astype(int), 0]
        beside_word, beside_class = np.nonzero((others[:, :CLASSES] > 0) & few[:, None])
        rest = sums[beside_class] - others[beside_word, beside_class]
        loss[beside_word, beside_class] = _xlogx(rest + total[beside_word]) - _xlogx(rest)
        rest = sums[own] - others[words, own] + twice - total
        loss[words, own] = _xlogx(rest + total) - _xlogx(rest)
        many = np.flatnonzero(~few)
        rest = sums - others[many, :CLASSES]
        rest[np.arange(len(many)), own[many]] += twice[many] - total[many]
        loss[many] = _xlogx(rest + total[many, None]) - _xlogx(rest)
        gain -= loss
    best = gain.argmax(1)
    return np.where(gain[words, best] > gain[words, own] + 1e-9, best, own)


_made: dict[bytes, np.ndarray] = {}


def _rises(table: np.ndarray) -> np.ndarray:
    """By how much n log n rises in each cell when a small count is added: by count, then as the table."""
    key = table.tobytes()
    if key not in _made:
        if len(_made) > 8:  # two tables and two sums of a round
            _made.clear()
        more = np.arange(SMALL_COUNT + 1)[:, None, None]
        _made[key] = _xlogx(table + more) - _xlogx(table)
    return _made[key]


def moved(rows: DataFrame, of: np.ndarray, pairs: np.ndarray, half: int, end: int) -> DataFrame:
    """``code``, ``cls`` and ``was`` of every word of one half after it has chosen its class.

    Rows without a ``code`` have what that changes beside words of the dictionary, ``n`` at a place ``at`` of the first
    two tables of ``class_pairs``, if these words keep their classes.
    """
    sent = rows.sparkSession.sparkContext.broadcast((of, pairs))
    names = ["code", "cls", "was", "at", "n"]

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (of, pairs), k = sent.value, N_CLASSES
        changes = np.zeros(2 * k * k)
        for part in _slices(batches):
            code = part.column("code").to_numpy()
            part = part.filter(pa.array((code & 1 == half) & (code != end)))
            if not part.num_rows:
                continue
            was = _own(part, of)
            new = best_classes(was, *_cells(part, of), pairs)
            changed = part.filter(pa.array(new != was))
            word, other, n = _near(changed)
            beside, follows = of[other >> 1], other & 1
            for own, sign in ((new[new != was], 1), (was[new != was], -1)):
                own = own[word]
                at = np.where(follows, (k + own) * k + beside, beside * k + own)
                changes += sign * np.bincount(at, n, len(changes))
            columns = [part.column("code"), pa.array(new, pa.int32()), pa.array(was, pa.int32())]
            nothing = [pa.nulls(part.num_rows, pa.int32()), pa.nulls(part.num_rows, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + nothing, names=names)
        at = np.flatnonzero(changes)
        nothing = [pa.nulls(len(at), kind) for kind in (pa.int64(), pa.int32(), pa.int32())]
        counted = [pa.array(at, pa.int32()), pa.array(changes[at].astype(np.int64))]
        yield pa.RecordBatch.from_arrays(nothing + counted, names=names)

    return rows.mapInArrow(move, "code long, cls int, was int, at int, n long")


def exchange(
    train: DataFrame, layout: Layout, rounds: int | None = None, least_gain: float = 0.0
) -> tuple[Classes, np.ndarray]:
    """Classes of all training words and the class bigrams they give, after so many rounds at most.

    The halves of the dictionary take turns until two rounds gain nothing, then the halves of the
    other words, one round each, and so on until all of this gains nothing.  Rounds that gain no more than
    ``least_gain`` for each token count as gaining nothing; 0 is the exact end.

    The neighbours of a word lie in its row.  Those of the dictionary get their classes in the task, so a
    round reads the rows and shuffles nothing; only where words outside the dictionary have
    moved, they are added up anew for the words beside them.  The driver holds a class per word of the
    dictionary and the table of class pairs.
    """
    spark, end, parts = train.sparkSession, layout.end, parts_of(layout)
    if "rare" not in train.columns:
        train = train.withColumn("rare", F.expr("X''"))
    tables: dict[str, tuple[str, DataFrame]] = {}

    def keep(name: str, df: DataFrame) -> DataFrame:
        """Write a table in place of the one of this name."""
        path = staging_path(spark, f"lm-{name}")
        before, tables[name] = tables.get(name), (path, in_halves(df, path) if name == "frequent" else stored(df, path))
        if before:
            release(spark, before[0])
        return tables[name][1]

    def in_halves(rows: DataFrame, path: str) -> DataFrame:
        """Stored so that a round reads only the half that moves."""
        rows = rows.withColumn("half", F.col("code").bitwiseAND(1).cast("int"))
        rows.write.partitionBy("half").parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    def forget(name: str) -> None:
        release(spark, tables.pop(name)[0])

    def with_cells(rows: DataFrame, cells: DataFrame) -> DataFrame:
        return filled(rows.join(cells, "code", "left"), "cells", "cell_ns")

    def with_lists(words: DataFrame, lists: DataFrame) -> DataFrame:
        """A word that has no neighbour of the dictionary gets empty lists."""
        return filled(words.join(lists, "code", "left"), "others", "ns")

    def filled(rows: DataFrame, *columns: str) -> DataFrame:
        return rows.withColumns({c: F.coalesce(c, F.expr("X''")) for c in columns})

    lists = keep("lists", neighbour_lists(train, layout))
    between = keep("rare-bigrams", rare_bigrams(train, layout))
    of = np.append(np.arange(end) % CLASSES, CLASSES)
    rare = listed_rare(train).select("code").distinct().withColumn("cls", F.pmod("code", F.lit(CLASSES)).cast("int"))
    rare = keep("rare-classes", rare)
    rare_rows = keep("rare", with_cells(with_lists(rare, lists.where("code < 0")), class_counts(between, rare, parts)))
    dictionary = with_lists(spark.range(end + 1).toDF("code"), lists.where("code >= 0"))
    frequent = keep("frequent", with_cells(dictionary, rare_beside(rare_rows, parts)))
    forget("lists")
    any_rare = not rare.isEmpty()

    seen, rare_seen = class_pairs(frequent, of), class_pairs(rare_rows, of)
    pairs = seen[0] + seen[2] + seen[3] + rare_seen[2]
    least = least_gain * pairs.sum()
    done = 0

    def more() -> bool:
        return rounds is None or done < rounds

    while True:
        begun, idle = likelihood(pairs), 0
        while end and idle < 2 and more():
            half, done = done % 2, done + 1
            changes = moved(frequent.where(F.col("half") == half), of, pairs, half, end).where("cls <> was").toArrow()  # words of the dictionary at most
            idle += 1
            if changes.num_rows:
                new = of.copy()
                new[changes.column("code").to_numpy()] = changes.column("cls").to_numpy()
                new_seen = seen + changed_pairs(frequent.where(F.col("half") == half), of, new)
                new_pairs = new_seen[0] + new_seen[2] + new_seen[3] + rare_seen[2]
                gain = likelihood(new_pairs) - likelihood(pairs)
                if gain > 0:
                    of, seen, pairs = new, new_seen, new_pairs
                    idle = 0 if gain > least else idle
        rare_moved = False
        rare_seen[0], rare_seen[1] = seen[3], seen[2]  # the same neighbours, seen from the other side
        for half in (0, 1):
            if not any_rare or not more():
                break
            done += 1
            path = staging_path(spark, "lm-moved")
            of_half = F.col("code").bitwiseAND(1) == half
            new = stored(moved(rare_rows.where(of_half), of, pairs, half, end), path)
            if not new.where("cls <> was").isEmpty():
                stay = rare_rows.where(~of_half).select("code", "cls")
                classes = new.where("code IS NOT NULL").select("code", "cls").unionByName(stay)
                rows = with_cells(rare_rows.select("code", "others", "ns").join(classes, "code"), class_counts(between, classes, parts))
                new_path = staging_path(spark, "lm-rare")
                new_rows = stored(rows, new_path)
                far = new_rows.where("octet_length(cells) > 0").withColumns({c: F.expr("X''") for c in ("others", "ns")})
                new_seen = rare_seen + _tables(new.where("code IS NULL").select("at", "n"))
                new_seen[2:] = class_pairs(far, of)[2:]
                new_pairs = seen[0] + new_seen[0] + new_seen[1] + new_seen[2]
                if likelihood(new_pairs) > likelihood(pairs):
                    release(spark, tables["rare"][0])
                    tables["rare"] = new_path, new_rows
                    rare_rows, rare_seen, pairs, rare_moved = new_rows, new_seen, new_pairs, True
                else:
                    release(spark, new_path)
            release(spark, path)
        if rare_moved:
            frequent = keep("frequent", with_cells(frequent.select("code", "others", "ns"), rare_beside(rare_rows, parts)))
            seen[2], seen[3] = rare_seen[1], rare_seen[0]
        if not more() or not any_rare or likelihood(pairs) - begun <= least:
            break
    once = seen_once(frequent, of, end) + seen_once(rare_rows, of, end)
    classes = keep("rare-classes", rare_rows.select("code", "cls"))
    for name in ("rare", "frequent", "rare-bigrams"):
        forget(name)
    trained = np.flatnonzero(np.append(layout.counts > 0, pairs[CLASSES].sum() > 0))
    own = pa.table({"code": pa.array(trained, pa.int64()), "cls": pa.array(of[trained], pa.int32())})
    return Classes(classes.unionByName(spark.createDataFrame(own)), of[:end], once), pairs


def class_follows(pairs: np.ndarray, once: np.ndarray, new: float) -> np.ndarray:
    """log10 of the probability of each class after each; the last class is that of unknown words.

    ``new`` is the share of tokens whose word was seen once: by Good and Turing, the share of
    unknown ones to expect.  Where little is known of a class, it and the classes' own frequencies decide.
    """
    n_classes = unknown = len(pairs) - 1
    weight = len(pairs)  # of the classes' own frequencies against what follows a class
    in_class = pairs.sum(0).astype(float)
    alone = (in_class + 1) / (in_class.sum() + weight)
    after = pairs.astype(float)
    after[unknown] = once[1]
    total = after.sum(1)
    unseen = (once[0] + weight * new) / (total + weight)
    unseen[unknown] = new
    known = (after + weight * alone) / (total + weight)[:, None] * (1 - unseen)[:, None]
    return np.log10(np.concatenate([known[:, :n_classes], unseen[:, None]], axis=1))


def score(docs: DataFrame, rounds: int | None = None, least_gain: float = LEAST_GAIN) -> DataFrame:
    """Per document row ``doc_id``, ``held_out``, token counts, ``base_score`` and ``score`` (both log10).

    Learns from the rows that are not held out.  Missing and empty texts are one end; repeated
    rows stay and are learnt from as often; without any training text every word is unknown; an
    empty table gives none; other columns are not looked at.
    """
    rows = kept_columns(docs, "doc_id", "text")
    texts = rows.select("doc_id", is_held_out().alias("held_out"), F.monotonically_increasing_id().alias(KEY), whole("text").alias("text"))
    counts = stage(count_words(texts), "lm-counts")
    seed, counts = free_seed(counts), counts.where("n > 0")
    dictionary, frequent = most_frequent(counts, DICTIONARY)
    layout = Layout(frequent)
    end = layout.end
    coded = numbered(texts, dictionary, layout, seed)
    train = coded.where("NOT held_out")
    sums = [F.sum("n"), F.count(F.lit(1)), F.count_if(F.col("n") == 1)]
    n_docs, (n_words, n_kinds, once) = train.count(), counts.agg(*sums).first()
    tokens, kinds = (n_words or 0) + n_docs, n_kinds + (n_docs > 0)

    classes, pairs = exchange(train.select("codes", "rare"), layout, rounds, least_gain)
    words = counts.select(rare_code(F.col("word"), seed).alias("code"), "n").join(classes.table, "code").select("code", "n", "cls")
    in_class = pairs.sum(0).astype(float)
    follow = class_follows(pairs, classes.once, (once + 1) / (tokens + 2))
    new = -float(np.log10(kinds + 1))
    of = np.append(classes.frequent, CLASSES)
    n_of = np.append(layout.counts, n_docs)
    per_token = float(np.log10(tokens + kinds + 1))
    tables = docs.sparkSession.sparkContext.broadcast((of, n_of, follow, np.log10(np.maximum(in_class, 1))))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, n_of, follow, in_class = tables.value
        for part in _parts(batches):
            code, starts = _flat(part.column("codes"))
            classes, n = of[code], n_of[code]
            gaps = code < 0
            places = _unpacked(part.column("places"), np.int64)[1]
            classes[gaps] = places & ((1 << CLASS_BITS) - 1)
            n[gaps] = places >> CLASS_BITS
            emit = np.where(n > 0, np.log10(np.maximum(n, 1)) - in_class[classes], new)
            emit[code == end] = 0.0  # the end is alone in its class
            logs = follow[_after(classes, starts, CLASSES), classes] + emit
            sums = [np.add.reduceat(x, starts) for x in (logs, np.log10(n + 1), (n > 0).astype(np.int64))]
            size = np.diff(np.append(starts, len(code)))
            columns = [
                part.column("doc_id"),
                part.column("held_out"),
                pa.array(size),
                pa.array(sums[2]),
                pa.array(np.full(len(size), tokens, dtype=np.int64)),
                pa.array(sums[1] - size * per_token),
                pa.array(sums[0]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return with_places(coded, words, 1 + tokens * 2 // PART_NEIGHBOURS).mapInArrow(measure, schema)
