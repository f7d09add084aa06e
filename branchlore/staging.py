"""Intermediate tables in the shared folder of the session."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

_default: list[str] = []


def use_folder(folder: str) -> None:
    """Stage in this folder wherever a session names none; all executors must reach it."""
    _default[:] = [folder]


def staging_dir(spark: SparkSession) -> str:
    """The folder the cluster names, else the one given to ``use_folder``."""
    folder = spark.conf.get(CHECKPOINT_CONF, None) or next(iter(_default), None)
    if not folder:
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors can reach")
    return folder.rstrip("/")


def staging_path(spark: SparkSession, label: str) -> str:
    return f"{staging_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a DataFrame and read it back: lineage ends here and its size is known."""
    return stored(df, staging_path(df.sparkSession, label))


def stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, path: str) -> None:
    """Empty a staged table that nothing reads any more, on whatever store holds it."""
    spark.range(0).write.mode("overwrite").parquet(path)
