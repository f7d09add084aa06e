"""Commits that keep arriving: append, enrich, and count days incrementally.

A commit may reach the root after it reached another branch, so the stream stores
every branch's rows and reconciliation stays a join at read time
(``operators.reconcile.reconcile_table``).  Enrichment works row by row and is the
batch function itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from branchlore.operators.enrich import enrich
from branchlore.operators.rollups import TOTALS, daily_activity, measures
from branchlore.schema import COMMIT_SCHEMA

ARRIVAL_SCHEMA = T.StructType([T.StructField("branch", T.StringType()), *COMMIT_SCHEMA.fields])


def read_commit_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files of branch-labelled commits as they land in a folder."""
    return (
        spark.readStream.schema(ARRIVAL_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    )


def store_commits(arrivals: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append enriched commits by branch; the file sink commits each batch exactly once."""
    return (
        enrich(arrivals)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy("branch")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def store_daily_sums(arrivals: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append each batch's sums per branch and day, however late its commits are.

    Author dates can be years older than their arrival (a rebase keeps them), so no day is ever
    closed.  A batch that is run again replaces its own sums.
    """

    def append(batch: DataFrame, number: int) -> None:
        daily_activity(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = arrivals.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_daily_sums(spark: SparkSession, path: str) -> DataFrame:
    """The batches' sums added up: the same as the batch rollup over all that arrived."""
    sums = spark.read.parquet(path)
    return sums.groupBy("branch", "commit_day").agg(*measures("commit_count", *TOTALS))
