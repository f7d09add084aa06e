"""Near duplicates by SimHash and multi-index hashing.

A fingerprint has 64 bits.  Cut into three segments, two fingerprints that differ in at most
four bits differ in at most one bit of some segment.  So every fingerprint stands in three
tables under its segments, and looks up the Hamming ball of radius one around each segment:
the segment itself and the segment with one zero bit set (of two fingerprints one bit apart
one has the zero, so the other half of the ball is not needed).  What meets under one table
key is verified on all 64 bits.  Equal fingerprints are one before this, so copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from branchlore.llm.common import components, free_names, kept_columns, map_rows, row_key, star_labels, whole
from branchlore.staging import stage

WORDS = 4
DISTANCE = 4
SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, number of bits
BLOCK = 4096  # table entries of one key that one group holds; more are split
PAIRS_AT_ONCE = 1 << 21
STAYS = "simhash_dedup_row_key"

_LANES = np.uint64(0x0101010101010101)
_SHIFTS = np.arange(8, dtype=np.uint64)


def fingerprint(text: bytes) -> int:
    """The SimHash of a text's 4-word shingles; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < WORDS:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(WORDS)), strict=False))
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], dtype=np.uint64)
    n = len(hashes)
    ones = np.zeros((8, 8), dtype=np.int64)
    for start in range(0, n, 255 * 64):  # byte lanes hold up to 255
        part = hashes[start : start + 255 * 64]
        part = np.pad(part, (0, -len(part) % 255)).reshape(-1, 255)
        for s in range(8):
            lanes = ((part >> _SHIFTS[s]) & _LANES).sum(axis=1, dtype=np.uint64)
            ones[:, s] += lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    bits = (2 * ones > n).reshape(64)  # bit 8 * byte + shift
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``row_key`` and ``fp`` (the fingerprint as a signed long) of every row."""
    texts = kept_columns(docs, "doc_id", "text").select("doc_id", row_key(docs, "doc_id", "text").alias("row_key"), whole("text").alias("text"))
    return map_rows(texts, lambda text: (_signed(fingerprint(text)),), "fp long", "text")


def probes(fps: DataFrame) -> DataFrame:
    """Table entries and look-ups: ``key``, ``probe`` (false: entry of the table), ``fp``."""
    ball = F.explode(F.sequence(F.lit(-2 * len(SEGMENTS)), F.lit(63))).alias("i")
    bit = F.expr("shiftleft(1L, greatest(i, 0))")
    rows = fps.select("fp", ball).where((F.col("i") < 0) | (F.col("fp").bitwiseAND(bit) == 0))
    seen = F.when(F.col("i") < 0, F.col("fp")).otherwise(F.col("fp").bitwiseOR(bit))
    table = F.when(F.col("i") < 0, F.pmod(-F.col("i") - 1, F.lit(len(SEGMENTS))))
    for k, (first, _) in enumerate(SEGMENTS[1:], 1):
        table = table.when(F.col("i") < first, F.lit(k - 1))
    table = table.otherwise(F.lit(len(SEGMENTS) - 1))
    key = F.lit(None).cast("long")
    for k, (first, size) in enumerate(SEGMENTS):
        segment = F.shiftrightunsigned(F.col("seen"), first).bitwiseAND(F.lit((1 << size) - 1))
        key = F.when(F.col("t") == k, segment + F.lit(k << 22)).otherwise(key)
    return (
        rows.select("fp", seen.alias("seen"), table.alias("t"), (F.col("i") >= -len(SEGMENTS)).alias("probe"))
        .select(key.alias("key"), "probe", "fp")
    )


def blocked(entries: DataFrame, block: int) -> DataFrame:
    """Adds ``block``: a key with more than so many entries has them split, and look-ups visit all parts."""
    wide = (
        entries.where("NOT probe").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
        .select("key", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    )
    own = F.array(F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    parts = F.when(F.col("parts").isNull(), F.array(F.lit(0))).when(F.col("probe"), every).otherwise(own)
    return entries.join(wide, "key", "left").select("key", F.explode(parts).alias("block"), "probe", "fp")


def _verified(table_fp: np.ndarray, first: np.ndarray, count: np.ndarray, probe_fp: np.ndarray, distance: int) -> Iterator[tuple]:
    """Pairs (probe, entry) within the distance; probe i meets entries first[i] .. first[i]+count[i]-1."""
    ends = np.cumsum(count)
    start = 0
    while start < len(count):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + PAIRS_AT_ONCE, side="right")))
        c = count[start:stop]
        who = np.repeat(np.arange(start, stop), c)
        at = np.arange(len(who)) - np.repeat(ends[start:stop] - c - base, c) + np.repeat(first[start:stop], c)
        a, b = probe_fp[who], table_fp[at]
        near = (np.bitwise_count(a ^ b) <= distance) & (a != b)
        yield a[near], b[near]
        start = stop


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As many links as join what the given links join: each node to the smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = star_labels(len(nodes), at[: len(a)], at[len(a) :])
    leaf = label != np.arange(len(nodes))
    return nodes[label[leaf]], nodes[leaf]


def _links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Links among rows sorted by key and block, a table's entries before its look-ups.

    Holds the entries of one group (at most a block) and one batch.
    """
    names = ("key", "block", "probe", "fp")
    held = [np.empty(0, t) for t in (np.int64, np.int64, bool, np.uint64)]
    for batch in batches:
        new = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        new = [x.view(np.uint64) if c == "fp" else x.astype(h.dtype) for x, c, h in zip(new, names, held, strict=True)]
        key, block, probe, fp = (np.concatenate([h, x]) for h, x in zip(held, new, strict=True))
        if not len(key):
            continue
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (block[1:] != block[:-1])
        group = np.cumsum(fresh) - 1
        table, look = np.flatnonzero(~probe), np.flatnonzero(probe)
        entries = np.bincount(group[table], minlength=group[-1] + 1)
        first = np.cumsum(entries) - entries
        look = look[entries[group[look]] > 0]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for pair in _verified(fp[table], first[group[look]], entries[group[look]], fp[look], distance):
            found.append(_forest(*pair))
        if found:
            u, v = _forest(*(np.concatenate(x) for x in zip(*found, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])
        last = (group == group[-1]) & ~probe
        held = [x[last] for x in (key, block, probe, fp)]


def near_links(fps: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Links (``u``, ``v``) that join all distinct fingerprints ``fp`` within the distance.

    Among the fingerprints of one table key only a spanning forest is kept, never all pairs.
    """
    spark = fps.sparkSession
    if distance > 2 * len(SEGMENTS) - 1:
        raise ValueError("the segments' balls of radius one do not reach so far")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = blocked(probes(fps), block).repartition(parts, "key", "block").sortWithinPartitions("key", "block", "probe")
    return met.mapInArrow(lambda batches: _links(batches, distance), "u long, v long")


def classified(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``doc_id``, ``row_key``, ``fp``, the component's ``root`` fingerprint and ``component_id`` of every row."""
    prints = stage(fingerprints(docs), "fingerprints")
    classes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "fingerprint-classes")
    member = components(near_links(classes.select("fp"), distance))
    rooted = stage(
        classes.join(member.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")),
        "fingerprint-roots",
    )
    reached = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return prints.join(rooted.select("fp", "root").join(reached, "root"), "fp")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Every row's ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``.

    The component is the smallest id reachable over links of at most ``distance`` bits (null if
    all its ids are null).  A missing or empty text has fingerprint zero, which links like any
    other; fewer than four words are one shingle; repeated rows stay, each with its result; an
    empty table gives none; other columns are not looked at.
    """
    return classified(docs, distance).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The documents with one of each component left: the smallest id, of equal ids one row.

    Ids that are null come last; of rows with one id and text the least by language, source and
    length stays, whichever way the rows are spread.  Texts without words are copies of each
    other; texts of any length count whole; an empty table gives none; columns of any name stay
    as they are.
    """
    (stays,) = free_names(docs, STAYS)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    stay = classified(docs, distance).groupBy("root").agg(F.min(order)["row_key"].alias(stays)).select(stays)
    keyed = docs.select(row_key(docs, "doc_id", "text").alias(stays), F.struct("*").alias("doc"))
    first = F.struct(*[F.col(f"doc.{c}") for c in ("lang", "source", "n_chars") if c in docs.columns], F.lit(0))
    kept = keyed.join(stay, stays, "left_semi").groupBy("doc.doc_id", stays).agg(F.min_by("doc", first).alias("doc"))
    return kept.select("doc.*")
