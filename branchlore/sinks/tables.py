"""Stored facts and session views."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from branchlore.sinks import snapshots


def write_facts(df: DataFrame, path: str, clustered_by: str) -> DataFrame:
    """Replace a fact stored by branch, and read it back.

    Rows are rebalanced by branch: small branches make one file each, not one per task, and
    the adaptive planner splits a large one over tasks.  Ordering each file by date lets
    range filters skip row groups.
    """
    together = df.hint("rebalance", "branch")
    together.sortWithinPartitions("branch", clustered_by).write.mode("overwrite").partitionBy("branch").parquet(path)
    return _stored(df, path)


def store_facts(df: DataFrame, path: str, clustered_by: str | None = None, source: DataFrame | None = None) -> DataFrame:
    """Store a relation as the next version of what is under ``path``, and read that version.

    The version before stays for its readers, older ones go.  ``source`` holds the rows
    whose fingerprints tell which branches changed.
    """
    spark = df.sparkSession
    version = snapshots.refresh(df, path, clustered_by, source)
    snapshots.expire(spark, path)
    return snapshots.read_version(spark, path, df.schema, version)


def write_rollup(df: DataFrame, path: str) -> DataFrame:
    """Replace a rollup, and read it back."""
    df.write.mode("overwrite").parquet(path)
    return _stored(df, path)


def _stored(like: DataFrame, path: str) -> DataFrame:
    return like.sparkSession.read.schema(like.schema).parquet(path).select(*like.columns)


def save_table(df: DataFrame, name: str) -> DataFrame:
    """Replace a catalog table partitioned by branch (refresh is a recompute)."""
    df.write.mode("overwrite").partitionBy("branch").saveAsTable(name)
    return df.sparkSession.table(name).select(*df.columns)


def save_bucketed(df: DataFrame, name: str, buckets: int, key: str = "commit_id") -> DataFrame:
    """Replace a catalog table that lies in buckets of ``key``, one file each and sorted.

    Tables with as many buckets of the same key meet without a shuffle.  Rows of one key are in one bucket.
    """
    laid = df.repartition(buckets, key)
    laid.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return df.sparkSession.table(name)


def publish_views(spark: SparkSession, relations: Mapping[str, DataFrame]) -> tuple[str, ...]:
    """Create or replace a session view per relation."""
    for name, df in relations.items():
        df.createOrReplaceTempView(name)
    return tuple(relations)
