"""From raw documents to a training mix: the operators on text, one after the other.

Each stage works on all rows that the one before kept.  Stages are written as Parquet to the
shared folder and read again, so a lost executor costs one stage at most.  All stages take nulls in
any column, empty and very long texts (which are read whole), repeated rows and further columns of
any name, which they hand on; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from branchlore.llm import decontamination, quality_rules, secret_scan, simhash_dedup, source_mixing
from branchlore.session import configure
from branchlore.staging import stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, missing and empty texts among them.

    A row is judged by its own text, language and source; equal rows have one verdict.
    """
    configure(spark)
    return quality_rules.drop_low_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the smallest id, a missing one last.

    Of rows with one id and text the least by language, source and length stays; texts without words
    are copies of each other.
    """
    configure(spark)
    return simhash_dedup.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go; missing and empty texts have none, equal texts share their fate."""
    configure(spark)
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by marks; every document stays, a missing text missing.

    Overlapping secrets get one mark; equal rows are marked alike.
    """
    configure(spark)
    return secret_scan.redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: one row per copy of a document, in order; documents without words are in none.

    Ties of finish time go by source, pass, shuffle key and id; equal rows are queued one after the other.
    """
    configure(spark)
    return source_mixing.ordered_mix(docs)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("mixing", mixing),
]

# Shingle fingerprints need a hash that DuckDB lacks; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of the ``documents`` in a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
