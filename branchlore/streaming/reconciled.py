"""The unified relation kept up to date while commits of all branches arrive.

A batch appends the rows that the relation gains and retracts the ones it loses: commits of
other branches that have now reached the root.  Three tables are kept under one path,
each in folders by batch:

``rows``         commits of the root, and those of other branches that the root lacked on arrival
``root_ids``     the ids that reached the root with the batch
``retractions``  ids of stored rows of other branches that reached the root with the batch

Deciding reads ids only, never messages.  A batch sees what earlier batches wrote and replaces what
an earlier attempt at itself wrote, so running it again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from branchlore.config import BuildConfig
from branchlore.operators.membership import having_key, lacking_key
from branchlore.streaming.commits import ARRIVAL_SCHEMA

ROWS, ROOT_IDS, RETRACTIONS = "rows", "root_ids", "retractions"
ID_SCHEMA = T.StructType([ARRIVAL_SCHEMA["commit_id"]])


def _before(spark: SparkSession, path: str, table: str, schema: T.StructType, number: int | None = None) -> DataFrame:
    """What batches below ``number`` (all for None) wrote to a table; nothing yet is an empty table."""
    folder = f"{path}/{table}"
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    stored = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(folder)
    return (stored if number is None else stored.where(F.col("batch") < number)).drop("batch")


def merge_batch(arrivals: DataFrame, number: int, path: str, config: BuildConfig) -> None:
    """Bring one batch of branch-labelled commits into the relation.

    Rows of branches that are not configured are left out; rows without an id are never retracted.
    """
    spark, root = arrivals.sparkSession, config.root_branch
    if config.branches is not None:
        arrivals = arrivals.where(F.col("branch").isin(*{root, *config.branches}))
    put = lambda df, table: df.write.mode("overwrite").parquet(f"{path}/{table}/batch={number}")
    of_root = arrivals.where(F.col("branch") == root)
    ids = of_root.select("commit_id").where(F.col("commit_id").isNotNull()).distinct()
    known = _before(spark, path, ROOT_IDS, ID_SCHEMA, number)
    put(lacking_key(ids, known, "commit_id"), ROOT_IDS)
    new_ids = spark.read.schema(ID_SCHEMA).parquet(f"{path}/{ROOT_IDS}/batch={number}")
    stored = _before(spark, path, ROWS, ARRIVAL_SCHEMA, number).where(F.col("branch") != root).select("commit_id")
    put(having_key(stored.distinct(), new_ids, "commit_id"), RETRACTIONS)
    others = lacking_key(arrivals.where(F.col("branch") != root), known.unionByName(new_ids), "commit_id")
    put(of_root.unionByName(others), ROWS)


def store_reconciled(arrivals: DataFrame, path: str, checkpoint: str, config: BuildConfig, **trigger) -> StreamingQuery:
    """Keep the relation of a stream of branch-labelled commits under ``path``."""
    writer = arrivals.writeStream.foreachBatch(lambda batch, number: merge_batch(batch, number, path, config))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_reconciled(spark: SparkSession, path: str, config: BuildConfig) -> DataFrame:
    """The relation as it stands: the stored rows without the retracted ones.

    Retractions are few: ids of commits that were seen on another branch before they reached the root.
    """
    rows = _before(spark, path, ROWS, ARRIVAL_SCHEMA)
    retracted = _before(spark, path, RETRACTIONS, ID_SCHEMA)
    root = F.col("branch") == config.root_branch
    return rows.where(root).unionByName(lacking_key(rows.where(~root), retracted, "commit_id"))


def compact_reconciled(spark: SparkSession, path: str, target: str, config: BuildConfig) -> None:
    """Write the relation to a folder of the same layout without its retracted rows; the stream goes on from there.

    The stream must rest meanwhile, and keeps its checkpoint.
    """
    last = spark.read.parquet(f"{path}/{ROWS}").agg(F.max("batch")).first()[0]
    put = lambda df, table: df.write.mode("overwrite").parquet(f"{target}/{table}/batch={last}")
    put(read_reconciled(spark, path, config), ROWS)
    put(_before(spark, path, ROOT_IDS, ID_SCHEMA), ROOT_IDS)
    put(spark.createDataFrame([], ID_SCHEMA), RETRACTIONS)
