"""Base commit schema and the trailer catalog."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMIT_SCHEMA = T.StructType(
    [
        T.StructField("commit_id", T.StringType()),
        T.StructField("author_name", T.StringType()),
        T.StructField("author_email", T.StringType()),
        T.StructField("author_date", T.TimestampType()),
        T.StructField("committer_name", T.StringType()),
        T.StructField("committer_email", T.StringType()),
        T.StructField("commit_date", T.TimestampType()),
        T.StructField("summary", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("deltas", T.LongType()),
        T.StructField("insertions", T.LongType()),
        T.StructField("deletions", T.LongType()),
        T.StructField("changed_files", T.LongType()),
    ]
)

CHURN_COLUMNS = ("deltas", "insertions", "deletions", "changed_files")


class TrailerField(NamedTuple):
    ordinality: int
    trailer_field: str
    column_name: str
    category: str


# The allowed trailer fields, their columns and categories, in catalog order.
TRAILER_CATALOG = (
    TrailerField(1, "Reported-by", "reported_by", "person"),
    TrailerField(2, "Suggested-by", "suggested_by", "person"),
    TrailerField(3, "Diagnosed-by", "diagnosed_by", "person"),
    TrailerField(4, "Author", "trailer_author", "person"),
    TrailerField(5, "Co-authored-by", "co_authored_by", "person"),
    TrailerField(6, "Reviewed-by", "reviewed_by", "person"),
    TrailerField(7, "Tested-by", "tested_by", "person"),
    TrailerField(8, "Bug", "bug", "reference"),
    TrailerField(9, "Discussion", "discussion", "reference"),
    TrailerField(10, "Backpatch-through", "backpatch_through", "reference"),
)

FIELD_NAMES = tuple(f.trailer_field for f in TRAILER_CATALOG)
PERSON_FIELDS = tuple(f.trailer_field for f in TRAILER_CATALOG if f.category == "person")
TRAILER_COLUMNS = tuple(f.column_name for f in TRAILER_CATALOG)
PERSON_COLUMNS = tuple(f.column_name for f in TRAILER_CATALOG if f.category == "person")


def trailer_field_catalog(spark: SparkSession) -> DataFrame:
    """The catalog as a ten-row literal table, whose size the planner knows."""
    rows = ", ".join(
        f"({ordinality}, '{name}', '{column}', '{kind}')"
        for ordinality, name, column, kind in TRAILER_CATALOG
    )
    return spark.sql(f"SELECT * FROM VALUES {rows} AS catalog({', '.join(TrailerField._fields)})")


def conform(df: DataFrame) -> DataFrame:
    """Check a commit table against the base schema and cast it column by column.

    A missing column is an error; zone-less timestamps become instants in the session zone.
    """
    missing = [f.name for f in COMMIT_SCHEMA if f.name not in df.columns]
    if missing:
        raise ValueError(f"commit table lacks columns: {', '.join(missing)}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in COMMIT_SCHEMA])
