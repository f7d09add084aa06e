"""Commit logs exported as text, one dump or many, to the base schema.

Records are separated by ``\\x1e`` and hold ten fields separated by ``\\x1f``: the nine
text columns of a commit in schema order, then a numstat block of
``added<TAB>removed<TAB>path`` lines with ``-`` for binary files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from branchlore.schema import COMMIT_SCHEMA

RECORD_SEPARATOR = "\x1e"
FIELD_SEPARATOR = "\x1f"
FIELDS = 10
NUMSTAT = r"(?m)^(\d+|-)\t(\d+|-)\t"


def read_log_dump(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Dump files are cut at record ends, so one large file is read by many tasks."""
    return parse_log_records(spark.read.text(paths, lineSep=RECORD_SEPARATOR))


def parse_log_records(records: DataFrame, column: str = "value") -> DataFrame:
    """Records to base columns; a record with another number of fields is an error.

    Empty fields are NULL, and a date that is no date is an error too.  Churn is added up inside the record, without a shuffle, and
    is NULL where the numstat block is empty.
    """
    text = F.ltrim(F.col(column), F.lit("\r\n"))
    parts = F.split(text, FIELD_SEPARATOR)
    checked = F.when(F.size(parts) == FIELDS, parts).otherwise(
        F.raise_error(F.concat(F.lit("log record with "), F.size(parts), F.lit(" fields"))).cast("array<string>")
    )
    # what follows the last separator of a file is blank, and no record
    fields = records.where(text.rlike(r"\S")).select(checked.alias("f"))
    texts = [
        F.nullif(F.col("f")[i], F.lit("")).cast(field.dataType).alias(field.name)
        for i, field in enumerate(COMMIT_SCHEMA.fields[: FIELDS - 1])
    ]
    block = F.col("f")[FIELDS - 1]
    entries = F.nullif(F.size(_numstat(block, 1)).cast("long"), F.lit(0).cast("long"))
    return fields.select(
        *texts,
        entries.alias("deltas"),
        F.when(entries.isNotNull(), _total(_numstat(block, 1))).alias("insertions"),
        F.when(entries.isNotNull(), _total(_numstat(block, 2))).alias("deletions"),
        entries.alias("changed_files"),
    )


def numstat_rollup(lines: DataFrame) -> DataFrame:
    """Churn per commit from a table of numstat lines (commit_id, additions, removals, path)."""
    return lines.groupBy("commit_id").agg(
        F.count(F.lit(1)).alias("deltas"),
        F.coalesce(F.sum("additions"), F.lit(0)).alias("insertions"),
        F.coalesce(F.sum("removals"), F.lit(0)).alias("deletions"),
        F.count(F.lit(1)).alias("changed_files"),
    )


def _numstat(block: Column, group: int) -> Column:
    return F.regexp_extract_all(block, F.lit(NUMSTAT), F.lit(group))


def _total(counts: Column) -> Column:
    return F.aggregate(
        counts,
        F.lit(0).cast("long"),
        lambda total, count: total + F.coalesce(count.try_cast("long"), F.lit(0)),
    )


def render_log_records(commits: DataFrame, numstat_block: str = "numstat_block") -> DataFrame:
    """The inverse: base columns plus a numstat text column to one record per row."""
    parts = []
    for field in COMMIT_SCHEMA.fields[: FIELDS - 1]:
        column = F.col(field.name)
        if field.dataType.typeName() == "timestamp":
            column = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
        parts.append(F.coalesce(column, F.lit("")))
    parts.append(F.coalesce(F.col(numstat_block), F.lit("")))
    return commits.select(F.concat_ws(FIELD_SEPARATOR, *parts).alias("value"))
