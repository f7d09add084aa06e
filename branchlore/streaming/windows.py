"""The daily series as a stateful stream: windows of event time behind a watermark.

State holds a row per branch and open day, so it stays small however long the stream runs.  A day
that lies behind the watermark is closed; commits that arrive later still are not added to
it.  Their number is known all the same: the stateless sums of ``streaming.commits`` count
every arrival, and what a window lacks of them came late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from branchlore.operators.rollups import TOTALS, as_facts, measures
from branchlore.streaming.commits import read_daily_sums

LATENESS = "30 days"
SUMS = ("commit_count", *TOTALS)


def daily_windows(commits: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Running sums per branch and day of the author date; rows without a date are in no window.

    ``lateness`` is how far an author date may lie behind the newest one seen.
    """
    seen = commits.withWatermark("author_date", lateness)
    facts = as_facts(seen).withColumnRenamed("first_commit_at", "at")
    sums = facts.groupBy("branch", F.window("at", "1 day").alias("day")).agg(*measures(*SUMS))
    return sums.select("branch", F.to_date("day.start").alias("commit_day"), *SUMS)


def store_daily_windows(
    commits: DataFrame, path: str, checkpoint: str, lateness: str = LATENESS, **trigger
) -> StreamingQuery:
    """Write each batch's changed windows as they stand; a batch that is run again replaces its own rows."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = daily_windows(commits, lateness).writeStream.outputMode("update").foreachBatch(put)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_daily_windows(spark: SparkSession, path: str) -> DataFrame:
    """Every window as it stood last."""
    changes = spark.read.parquet(path)
    last = F.max_by(F.struct(*SUMS), "batch").alias("last")
    return changes.groupBy("branch", "commit_day").agg(last).select("branch", "commit_day", "last.*")


def daily_with_late(spark: SparkSession, windows_path: str, sums_path: str) -> DataFrame:
    """The windows with ``late_count``: commits that arrived after their day was closed, or without a date.

    Days of which nothing arrived in time have zeros.  Both streams must have read the same arrivals.
    """
    windows, every = read_daily_windows(spark, windows_path), read_daily_sums(spark, sums_path)
    same = (every.branch == windows.branch) & every.commit_day.eqNullSafe(windows.commit_day)
    sums = [F.coalesce(windows[c], F.lit(0)).alias(c) for c in SUMS]
    late = every.commit_count - F.coalesce(windows.commit_count, F.lit(0))
    return every.join(windows, same, "left").select(every.branch, every.commit_day, *sums, late.alias("late_count"))


def compact_daily_windows(spark: SparkSession, path: str, target: str) -> None:
    """Write the windows as they stand to a folder of the same layout, as one batch."""
    last = spark.read.parquet(path).agg(F.max("batch")).first()[0]
    read_daily_windows(spark, path).write.mode("overwrite").parquet(f"{target}/batch={last}")
