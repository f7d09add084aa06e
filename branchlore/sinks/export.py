"""Ordered JSON exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from branchlore.operators.ordering import order_by, rank_struct
from branchlore.operators.quality import counted, counts_of
from branchlore.staging import stage

TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"
JSON_OPTIONS = {"ignoreNullFields": "false", "timestampFormat": TIMESTAMP_FORMAT}


def write_dataset(df: DataFrame, path: str, keys: Sequence[str], root: str) -> list[tuple[str, int, int]]:
    """Replace a dataset by its rows in key order, as JSON lines; returns what ``counts_of`` says was written.

    The sort is by ranges over the full key, so part files follow each other in order
    and a branch or value with many rows is spread over several.  The random last key
    does the same for rows that agree in all the others, such as copies.
    """
    ordered = df.orderBy(*order_by(*keys, root=root), F.rand(0))
    observation = Observation()
    counted(ordered, observation).write.mode("overwrite").options(**JSON_OPTIONS).json(path)
    return counts_of(df.columns, observation)


def write_array(df: DataFrame, path: str, keys: Sequence[str], root: str, one_file: bool = True) -> None:
    """Replace a dataset by one JSON array of its rows in key order; empty is ``[]``.

    Rows are sorted and turned into text in parallel and staged with their places.  The brackets
    and commas are put by place: the array is what the part files say one after the other.
    ``one_file`` has one task write the lines through to a single file, as a page that loads
    it wants; nothing is held there.
    """
    place = F.monotonically_increasing_id().alias("place")
    said = F.to_json(F.struct(*df.columns), JSON_OPTIONS).alias("value")
    lines = stage(df.orderBy(*order_by(*keys, root=root), F.rand(0)).select(said).select("value", place), "json-array")
    first, last = lines.agg(F.min("place"), F.max("place")).first()
    spark = df.sparkSession
    ends = spark.range(1).select(F.inline(F.array(
        F.struct(F.lit("[").alias("value"), F.lit(-1).cast("long").alias("place")),
        F.struct(F.lit("]").alias("value"), F.lit(0 if last is None else last + 1).cast("long").alias("place")),
    )))
    if first is not None:
        comma = F.when(F.col("place") == first, F.col("value")).otherwise(F.concat(F.lit(","), F.col("value")))
        lines = lines.withColumn("value", comma)
    ordered = lines.unionByName(ends).orderBy("place").select("value")
    (ordered.coalesce(1) if one_file else ordered).write.mode("overwrite").text(path)


def as_array(df: DataFrame, keys: Sequence[str], root: str) -> Column:
    """All rows as one ordered array of structs, for the sections of fixed size; empty is ``[]``."""
    rank = rank_struct(df, *keys, root=root).alias("rank")
    pairs = df.select(F.struct(rank, F.struct(*df.columns).alias("row")).alias("p"))
    return pairs.agg(F.sort_array(F.collect_list("p"))["row"].alias("rows")).scalar()
