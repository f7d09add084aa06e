"""Rows whose key is, or is not, in another table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def having_key(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in ``keys``; a NULL key occurs nowhere."""
    return _join(rows, keys, key, "left_semi")


def lacking_key(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key does not occur in ``keys``; rows without a key are kept (NOT EXISTS)."""
    return _join(rows, keys, key, "left_anti")


def _join(rows: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    # Keys are made distinct with a map-side combine, so copies collapse early.  The hash
    # as a second join key gives both sides an exchange of their own right under the
    # join, which is what lets the adaptive planner split the task of a hot key, or of
    # rows without a key, on the row side.
    distinct = keys.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_hash", F.xxhash64(key))
    joined = rows.withColumn("_hash", F.xxhash64(key)).join(distinct, [key, "_hash"], how)
    return joined.select(*rows.columns)
