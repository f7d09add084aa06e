"""Session settings the results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Pin the settings that change results; leave sizing to the cluster.

    Days and ISO text are UTC, sums must fail rather than wrap, and runtime
    re-planning is what splits a hot shuffle partition.  Where the id side of a join
    turns out to have no partition above 64 MB it is hashed, which saves sorting the
    rows with the messages.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.ansi.enabled", "true")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m")
    return spark


PARTITION_BYTES = 128 * 1024 * 1024
SHUFFLED_SHARE = 0.05  # of the commit tables: ids and group keys; messages stay where they are


def size_shuffles(spark: SparkSession, input_bytes: int, shuffled: float = SHUFFLED_SHARE) -> int:
    """Start shuffles with a part per 128 MB of what is shuffled; the adaptive planner merges and splits.

    Returns the number set, which is never below ``spark.sql.shuffle.partitions``.
    """
    parts = -(-int(input_bytes * shuffled) // PARTITION_BYTES)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(parts))
    return parts


def new_session(app_name: str = "branchlore", master: str | None = None, **conf: str) -> SparkSession:
    """A configured session; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return configure(builder.getOrCreate())
