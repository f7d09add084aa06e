"""The enriched ``commits`` fact and its exploded form ``commit_trailers``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from branchlore.functions import text
from branchlore.schema import (
    CHURN_COLUMNS,
    COMMIT_SCHEMA,
    PERSON_COLUMNS,
    TRAILER_CATALOG,
    TRAILER_COLUMNS,
)

COMMIT_COLUMNS = (
    "branch",
    *COMMIT_SCHEMA.fieldNames(),
    *TRAILER_COLUMNS,
    "mentioned_people",
    "mentioned_urls",
)


def churn_defaults(commits: DataFrame) -> DataFrame:
    """Unknown churn counts as 0."""
    return commits.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in CHURN_COLUMNS})


def with_trailers(commits: DataFrame) -> DataFrame:
    """One array column per catalogued trailer field."""
    lines = commits.withColumn("_trailer_lines", text.trailer_lines("message"))
    return lines.withColumns(
        {f.column_name: text.extract_field("_trailer_lines", f.trailer_field) for f in TRAILER_CATALOG}
    ).drop("_trailer_lines")


def with_mentions(commits: DataFrame) -> DataFrame:
    """Distinct people in catalog order, and distinct URLs of all fields."""
    # trailer values are already trimmed and never blank, so distinct is enough
    return commits.withColumns(
        {
            "mentioned_people": F.array_distinct(F.concat(*PERSON_COLUMNS)),
            "mentioned_urls": text.extract_urls(F.concat(*TRAILER_COLUMNS)),
        }
    )


def enrich(git_log_all: DataFrame) -> DataFrame:
    """The ``commits`` fact: row by row, no shuffle; unused parts are pruned."""
    return with_mentions(with_trailers(churn_defaults(git_log_all))).select(*COMMIT_COLUMNS)


def commit_trailers(commits: DataFrame) -> DataFrame:
    """One row per trailer occurrence; duplicates kept, commits without trailers dropped."""
    by_field = F.array(
        *[
            F.struct(
                F.lit(f.trailer_field).alias("trailer_field"),
                F.lit(f.category).alias("trailer_category"),
                F.col(f.column_name).alias("trailer_values"),
            )
            for f in TRAILER_CATALOG
        ]
    )
    kept = ("branch", "commit_id", "summary", "author_name", "author_date")
    value = F.col("trailer_value")
    return (
        commits.select(*kept, F.inline(by_field))
        .select(*kept, "trailer_field", "trailer_category", F.explode("trailer_values").alias("trailer_value"))
        .select(
            "branch",
            "commit_id",
            "summary",
            "trailer_field",
            "trailer_category",
            "trailer_value",
            F.when(F.col("trailer_category") == "person", F.array(value))
            .otherwise(F.array().cast("array<string>"))
            .alias("people"),
            text.extract_urls(F.array(value)).alias("urls"),
            "author_name",
            "author_date",
        )
    )
