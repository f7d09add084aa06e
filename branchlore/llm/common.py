"""Pieces that several operators share: words, row keys, digests, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from branchlore.staging import release, staging_path, stored

SPACES = "[\\x20\\x09-\\x0D]+"
NOT_IN_WORDS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

# Bytes of UTF-8 text to bytes of its words: A-Z become a-z, every other ASCII sign a space.
FOLD = bytes(
    byte + 32 if 65 <= byte <= 90 else byte if 48 <= byte <= 57 or 97 <= byte <= 122 or byte >= 128 else 32
    for byte in range(256)
)


def whole(column: str | Column) -> Column:
    """The text, with a missing one as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Small letters for A-Z, for finding ASCII words.

    Other letters may change too, but none becomes an ASCII letter: the Kelvin sign, the
    only one whose small form is ASCII, is replaced by another small letter before.
    """
    return F.lower(F.replace(text, F.lit("K"), F.lit("ĸ")))


def space_words(text: Column) -> Column:
    """The words between ASCII white space, in order."""
    return F.array_remove(F.split(text, SPACES), "")


def folded_words(text: Column) -> Column:
    """The words of letters, digits and non-ASCII characters of a text in small letters."""
    return F.array_remove(F.split(ascii_lower(text), NOT_IN_WORDS), "")


def row_key(df: DataFrame, *columns: str) -> Column:
    """A key of the row's content: equal rows share it, different rows without an id do not."""
    return F.xxhash64(*[df[c] for c in columns])


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front of those that the table has already."""
    found = []
    for name in names:
        while name in df.columns:
            name = f"_{name}"
        found.append(name)
    return found


def kept_columns(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that whatever else a table holds cannot clash."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*columns)


def map_rows(df: DataFrame, function: Callable[..., tuple], schema: str, *columns: str) -> DataFrame:
    """One output row per input row, made in Arrow batches.

    ``function`` gets the values of ``columns`` (texts as UTF-8 bytes) and returns the values
    of the fields that ``schema`` adds; the other columns of ``df`` pass through unchanged.
    """
    names = [c for c in df.columns if c not in columns]
    fields = T.StructType([df.schema[c] for c in names] + _parsed(schema).fields)
    kinds = [df.schema[c].dataType for c in columns]
    sent = df.select(
        *names,
        *[F.col(c).cast("binary") if isinstance(k, T.StringType) else F.col(c) for c, k in zip(columns, kinds, strict=True)],
    )
    n_made = len(_parsed(schema).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(fields)
        for batch in batches:
            # few rows at a time: what a task holds does not depend on the batch size
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                made = [function(*row) for row in zip(*(part.column(c).to_pylist() for c in columns), strict=True)]
                arrays = [part.column(c) for c in names]
                for i in range(n_made):
                    arrays.append(pa.array([m[i] for m in made], target.field(len(names) + i).type))
                yield pa.RecordBatch.from_arrays(
                    [a.cast(f.type) if a.type != f.type else a for a, f in zip(arrays, target, strict=True)], schema=target
                )

    return sent.mapInArrow(run, fields)


def _parsed(schema: str) -> T.StructType:
    return T.StructType.fromDDL(schema)


def star_labels(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 the smallest node each is connected to."""
    label = np.arange(n)
    while True:
        a, b = label[left], label[right]
        low, high = np.minimum(a, b), np.maximum(a, b)
        open_ = low != high
        if not open_.any():
            return label
        np.minimum.at(label, high[open_], low[open_])
        while True:
            shorter = label[label]
            if np.array_equal(shorter, label):
                break
            label = shorter


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (``u``, ``v``: long) as rows (``node``, ``root``).

    Alternating large and small stars (Kiveris et al. 2014): every round hangs neighbours on
    the smallest one and is written to the shared folder, so lineage stays short and lost
    executors cost one round.  Neighbour lists are never gathered: a node's smallest
    neighbour is a partial aggregate, joined back to its links.  A root names itself too.
    """
    spark = links.sparkSession
    path = staging_path(spark, "links")
    links = stored(links.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), path)
    seen = None
    while True:
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # each link now points down; hang a node and its lower neighbours on the lowest one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        before, path = path, staging_path(spark, "links")
        links = stored(small.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v")).distinct(), path)
        release(spark, before)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    leaves = links.select(F.col("v").alias("node"), F.col("u").alias("root"))
    roots = links.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    return leaves.unionByName(roots)
