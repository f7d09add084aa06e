"""Exported JSON read back: datasets, documents and their sections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("root_branch", T.StringType()),
        T.StructField("branches", T.ArrayType(T.StringType())),
        T.StructField("include_diff", T.BooleanType()),
        T.StructField("max_commits", T.LongType()),
        T.StructField("repository_path", T.StringType()),
    ]
)


def read_dataset(spark: SparkSession, path: str, schema: T.StructType, whole: bool = False) -> DataFrame:
    """A dataset as JSON lines, or with ``whole`` as one array or object per file.

    Times may have any number of fraction digits and any offset.
    """
    return spark.read.schema(schema).json(path, multiLine=whole, mode="FAILFAST")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return read_dataset(spark, path, MANIFEST_SCHEMA, whole=True)


def read_sections(
    spark: SparkSession, path: str, schemas: Mapping[str, T.StructType], position: str | None = None
) -> dict[str, DataFrame]:
    """Every section of a written document as rows, whether inside it or in a dataset beside it.

    ``schemas`` names the sections wanted; one that the document does not have is left out.
    ``position`` names a column to add for a row's place in its section, from 1.
    """
    inside = [T.StructField(name, T.ArrayType(schema)) for name, schema in schemas.items()]
    outside = T.StructField("external_sections", T.MapType(T.StringType(), T.StringType()))
    document = read_dataset(spark, path, T.StructType([*inside, outside]), whole=True)
    present = document.select("external_sections", *[F.col(n).isNotNull().alias(n) for n in schemas]).first()
    sections = {}
    for name, schema in schemas.items():
        if present[name]:
            numbered = document.select(F.posexplode(name).alias("_nth", "_row"))
            place = [(F.col("_nth") + 1).cast("long").alias(position)] if position else []
            sections[name] = numbered.select("_row.*", *place)
        elif beside := (present["external_sections"] or {}).get(name):
            rows = read_dataset(spark, beside, schema)
            sections[name] = with_positions(rows, position) if position else rows
    return sections


def with_positions(dataset: DataFrame, position: str = "position") -> DataFrame:
    """A dataset read from files with each row's place in it, from 1, as part files follow each other.

    Rows of a part of a file follow each other where it is read, so a row's place in its part is how
    far it is from the part's first row; only the parts' sizes and first rows are gathered, and no row moves.
    """
    part = F.struct(F.col("_metadata.file_name"), F.col("_metadata.file_block_start"))
    read = dataset.select("*", part.alias("_part"), F.monotonically_increasing_id().alias("_id"))
    parts = read.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_id").alias("_first"))
    ahead = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("_part", (F.coalesce(ahead, F.lit(0)) - F.col("_first")).alias("_ahead"))
    numbered = read.join(F.broadcast(parts), "_part")
    return numbered.select(*dataset.columns, (F.col("_ahead") + F.col("_id") + 1).alias(position))


class Selector(NamedTuple):
    selector: str
    text: str
    type: str


SELECTOR_TYPES = {"timestamp": "timestamp", "string": "string", "number": "double"}


def select_section(document: DataFrame, root: str, columns: Sequence[Selector]) -> DataFrame:
    """Rows of one section of a document, as typed and renamed columns."""
    rows = document.select(F.explode(root).alias("row"))
    return rows.select(
        *[F.col(f"row.{c.selector}").cast(SELECTOR_TYPES[c.type]).alias(c.text) for c in columns]
    )
