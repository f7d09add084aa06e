"""Benchmark passages in training documents, found with a distributed positional inverted index.

A window is ten consecutive words of a benchmark item.  The corpus is counted once, so each
window knows its rarest terms.  Only those terms are ever looked up, so the stored index holds
their postings (term, document, positions) and no others.  A window's lists are fetched from
the rarest term on and shifted by the term's place in the window; where the shifted positions
agree, or lie within a slack, the document's words are compared: all ten in place are a phrase
match, most of them nearby a proximity match.  A window whose words the corpus has in part is
looked up by the rarest it has.

Terms that tasks need to know are sent as a bitmap of fixed size over their CRC-32, whatever
the size of the benchmark; terms let through by chance fall out at the join.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from branchlore.llm.common import FOLD, free_names, kept_columns, map_rows, row_key, whole
from branchlore.staging import stage

WINDOW = 10
LISTS = 2  # rarest terms of a window whose lists are intersected
SLACK = 4  # words by which shifted positions may differ in a proximity match
CELL = 32  # positions that share a cell of the intersection
NEAR_WORDS = 8  # of a window's words that a proximity match has within reach
BITMAP_BITS = 1 << 22
KEY = "decontamination_row_key"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def windows_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: ``w`` (words joined by spaces) and ``items`` (ids of its items as text, sorted)."""

    def cut(text: bytes) -> tuple[list[bytes]]:
        words = words_of(text)
        cuts = [b" ".join(words[i : i + window]).decode() for i in range(max(1, len(words) - window + 1))]
        return (cuts if words else [],)

    items = kept_columns(benchmark, "item_id", "text").select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), whole("text").alias("text")
    )
    cuts = map_rows(items, cut, "cuts array<string>", "text").select("item", F.explode("cuts").alias("w"))
    return cuts.distinct().groupBy("w").agg(F.sort_array(F.collect_list("item")).alias("items"))


def window_key() -> Column:
    """A short name of a window for the lists.  Windows that share one by chance are both compared in full later."""
    return F.xxhash64("w")


def _bitmap(terms: DataFrame) -> bytes:
    """One bit per CRC-32 modulo the bitmap's size; collects at most that many numbers."""
    bits = np.zeros(BITMAP_BITS, dtype=bool)
    slots = terms.select(F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(BITMAP_BITS)).cast("int").alias("s")).distinct()
    bits[[r.s for r in slots.toLocalIterator()]] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _wanted(bits: bytes, term: bytes) -> bool:
    slot = zlib.crc32(term) % BITMAP_BITS
    return bool(bits[slot >> 3] >> (slot & 7) & 1)


def term_counts(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """How often each of the ``term`` rows occurs in all texts (``n``); terms that never occur are left out."""
    bits = texts.sparkSession.sparkContext.broadcast(_bitmap(terms))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        known: dict[bytes, bool] = {}
        for batch in batches:
            for value in batch.column(0):
                for term, n in Counter(words_of(value.as_py())).items():
                    take = known.get(term)
                    if take is None:
                        take = known[term] = _wanted(bits.value, term)
                    if take:
                        total[term] += n
            if len(known) > 1_000_000:
                known.clear()
            if len(total) > 200_000:  # bounded memory; the sums follow after the shuffle
                yield _pairs(total)
                total.clear()
        yield _pairs(total)

    counted = texts.select(F.col("text").cast("binary")).mapInArrow(count, "term binary, n long")
    counted = counted.groupBy(F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"))
    return counted.join(terms, "term", "left_semi")


def _pairs(total: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(total.keys()), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["term", "n"]
    )


def rarest_terms(windows: DataFrame, texts: DataFrame, lists: int = LISTS) -> DataFrame:
    """The rarest terms of every window: ``window``, ``rank`` (from 1), ``shift``, ``term``, ``of`` (how many there are).

    Words that the corpus lacks have no postings; the rarest of the others are taken.  A window of
    which the corpus has one word has one list, one of which it has none cannot occur.
    """
    spelled = windows.select("w", F.posexplode(F.split("w", " ")).alias("shift", "term"))
    counts = term_counts(texts, spelled.select("term").distinct())
    ranked = spelled.join(counts, "term").groupBy("w").agg(F.sort_array(F.collect_list(F.struct("n", "shift", "term"))).alias("by_n"))
    ranked = ranked.select("w", F.slice("by_n", 1, lists).alias("by_n"))
    ranked = ranked.select(window_key().alias("window"), F.size("by_n").alias("of"), F.posexplode("by_n").alias("rank", "t"))
    return ranked.select("window", "of", (F.col("rank") + 1).alias("rank"), F.col("t.shift").alias("shift"), F.col("t.term").alias("term"))


def postings(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """The positional index of the wanted terms: ``term``, ``doc`` (row key), ``positions``."""
    bits = texts.sparkSession.sparkContext.broadcast(_bitmap(terms))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bool] = {}
        for batch in batches:
            docs, names, places = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found: dict[bytes, list[int]] = {}
                for position, term in enumerate(words_of(text.as_py())):
                    take = known.get(term)
                    if take is None:
                        take = known[term] = _wanted(bits.value, term)
                    if take:
                        found.setdefault(term, []).append(position)
                docs += [doc] * len(found)
                names += found.keys()
                places += found.values()
            if len(known) > 1_000_000:
                known.clear()
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.binary()), pa.array(docs, pa.int64()), pa.array(places, pa.list_(pa.int32()))],
                names=["term", "doc", "positions"],
            )

    rows = texts.select(KEY, F.col("text").cast("binary")).mapInArrow(index, "term binary, doc long, positions array<int>")
    return rows.withColumn("term", F.col("term").cast("string"))


def candidates(index: DataFrame, rarest: DataFrame, slack: int = SLACK, lists: int = LISTS) -> DataFrame:
    """Where the shifted lists of a window's rarest terms agree within the slack: ``doc``, ``window``, ``start``."""
    places = index.join(rarest, "term").select("window", "rank", "of", "doc", F.explode("positions").alias("p"), "shift")
    places = places.select("window", "rank", "of", "doc", (F.col("p") - F.col("shift")).alias("start"))
    cell = lambda at: F.floor(at / F.lit(CELL)).cast("int")
    found = places.where("rank = 1").select("window", "of", "doc", "start")
    for rank in range(2, lists + 1):
        # the rarest list is the shortest: its places visit every cell that may hold an agreeing one
        near = F.explode(F.sequence(cell(F.col("start") - slack), cell(F.col("start") + slack))).alias("cell")
        visits = found.where(F.col("of") >= rank).select("window", "of", "doc", "start", near)
        others = places.where(F.col("rank") == rank).select(
            F.col("window").alias("window2"), F.col("doc").alias("doc2"), F.col("start").alias("start2"), cell(F.col("start")).alias("cell2")
        )
        met = (
            (F.col("window") == F.col("window2")) & (F.col("doc") == F.col("doc2")) & (F.col("cell") == F.col("cell2"))
            & (F.abs(F.col("start") - F.col("start2")) <= slack)
        )
        agreed = visits.join(others, met, "left_semi").select("window", "of", "doc", "start").distinct()
        found = found.where(F.col("of") < rank).unionByName(agreed)
    return found.select("doc", "window", "start").distinct()


def _judge(text: bytes, found: list[dict] | None, slack: int, near_words: int) -> tuple:
    """The words of one document against its candidate windows."""
    words = words_of(text)
    hit = bytearray(len(words))
    items: set[str] = set()
    near: set[str] = set()
    spans = set()
    for c in found or ():
        window = c["w"].encode().split(b" ")
        start, end = c["start"], c["start"] + len(window)
        if start >= 0 and words[start:end] == window:
            hit[start:end] = b"\x01" * len(window)
            items.update(c["items"])
            spans.add((start, end, "phrase"))
        elif len(window) > near_words:
            low, high = max(0, start - slack), min(len(words), end + slack)
            around = Counter(words[low:high])
            if sum((around & Counter(window)).values()) >= near_words:
                near.update(c["items"])
                spans.add((low, high, "proximity"))
    spans = [{"start": s, "end": e, "kind": k} for s, e, k in sorted(spans)]
    return len(words), sum(hit), sorted(items), sorted(near - items), spans


def scan(docs: DataFrame, benchmark: DataFrame, slack: int = SLACK, near_words: int = NEAR_WORDS) -> DataFrame:
    """Per document row: ``doc_id``, its row key, ``n_words``, ``n_hit``, ``items``, ``near_items`` and ``spans`` (in words).

    ``n_hit`` counts the words inside phrase matches and ``items`` the items these come from.
    A proximity match is a place where the two rarest words of a window that the corpus has (one,
    if it has one only) stand as far apart as in the window, give or take ``slack`` words, and at
    least ``near_words`` of the window's words, repeats counted, stand from ``slack`` words before
    the window's place to ``slack`` words behind it; the rarest word tells the place.  Words rank
    by their count in the corpus, then by their place in the window.  ``near_items`` are the items
    with such a match and no phrase match in the document, and ``spans`` has both kinds.  Missing and empty texts have no words and no hits; an
    item without words has no window, one without an id has the id ''; repeated rows stay, each
    with its result; empty tables give no rows or no hits; other columns are not looked at.
    """
    texts = kept_columns(docs, "doc_id", "text").select(
        "doc_id", row_key(docs, "doc_id", "text").alias(KEY), whole("text").alias("text")
    )
    windows = stage(windows_of(benchmark), "benchmark-windows")
    rarest = stage(rarest_terms(windows, texts), "benchmark-terms")
    index = stage(postings(texts, rarest.select("term").distinct()), "benchmark-postings")
    found = candidates(index, rarest, slack).join(windows.withColumn("window", window_key()), "window")
    per_doc = found.groupBy(F.col("doc").alias(KEY)).agg(F.collect_list(F.struct("start", "w", "items")).alias("found"))
    return map_rows(
        texts.join(per_doc, KEY, "left"),
        lambda text, c: _judge(text, c, slack, near_words),
        "n_words long, n_hit long, items array<string>, near_items array<string>, spans array<struct<start: int, end: int, kind: string>>",
        "text",
        "found",
    )


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest per document: counts, the items found, whether any benchmark window occurs, and the items only near."""
    items, near = F.col("items"), F.col("near_items")
    return scan(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size(near).cast("long").alias("n_near"),
        F.sha2(F.array_join(near, ","), 256).alias("near_items_sha256"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark window occurs, with all their columns.

    The text alone decides, so equal texts share their fate.  Missing and empty texts stay; texts of any
    length are searched whole; without benchmark items all rows stay; an empty table gives none;
    columns of any name stay as they are.
    """
    (key,) = free_names(docs, KEY)
    bad = scan(docs, benchmark).where("n_hit > 0").select(F.col(KEY).alias(key)).distinct()
    return docs.withColumn(key, row_key(docs, "doc_id", "text")).join(bad, key, "left_anti").select(*docs.columns)
