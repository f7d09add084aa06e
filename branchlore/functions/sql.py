"""The text functions as temporary SQL functions, for use from ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import SparkSession

from branchlore.functions.text import FIELD_PREFIX, FIELD_VALUE, URL_PATTERN
from branchlore.schema import COMMIT_SCHEMA, FIELD_NAMES, PERSON_FIELDS


def _texts(names) -> str:
    return "array(" + ", ".join(f"'{name}'" for name in names) + ")"


# Parameter names differ from any likely column name: an argument that is a column of
# the parameter's own name is inlined as an alias the optimizer takes for redundant, and
# two such calls over a union then fail to plan (seen on 4.1.2).
SQL_FUNCTIONS = {
    "branch_suffix": r"""
        (branch_arg STRING) RETURNS STRING
        RETURN coalesce(nullif(substring(regexp_replace(
            translate(coalesce(branch_arg, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^a-z0-9]', '_'), 1, 40), ''), 'head')""",
    "is_person_trailer": f"""
        (field_arg STRING) RETURNS BOOLEAN
        RETURN array_contains({_texts(PERSON_FIELDS)}, field_arg)""",
    "unique_text_array": r"""
        (items_arg ARRAY<STRING>) RETURNS ARRAY<STRING>
        RETURN array_distinct(filter(
            transform(coalesce(items_arg, array()), v -> trim(v)), v -> v <> ''))""",
    "extract_urls": f"""
        (items_arg ARRAY<STRING>) RETURNS ARRAY<STRING>
        RETURN array_distinct(regexp_extract_all(
            array_join(coalesce(items_arg, array()), char(10)), r'{URL_PATTERN}', 1))""",
    "extract_field": f"""
        (message_arg STRING, field_arg STRING) RETURNS ARRAY<STRING>
        RETURN CASE
            WHEN field_arg IS NULL THEN array()
            WHEN array_contains({_texts(FIELD_NAMES)}, field_arg) THEN regexp_extract_all(
                coalesce(message_arg, ''), concat(r'{FIELD_PREFIX}', field_arg, r'{FIELD_VALUE}'), 1)
            ELSE raise_error(concat('unknown trailer field: ', field_arg)) END""",
}


def register_functions(spark: SparkSession) -> tuple[str, ...]:
    """Create or replace every function in the session; returns their names."""
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return tuple(SQL_FUNCTIONS)


# Measures of the daily panel.
DAILY_MEASURES = ("commit_count", "total_insertions", "total_deletions", "total_changed_files")


def register_panels(spark: SparkSession) -> None:
    """Table functions over the published views: panels with their range, and one branch of the relation.

    ``panel_daily(measure, time_from, time_to, days)``  sums per branch and run of days from the epoch on
    ``panel_branches(time_from, time_to)``              the branch summary of a range
    ``git_log_of(branch)``                              the relation's rows of a branch; NULL for all

    A bound that is NULL is open.  Sessions without the views ``daily_activity``, ``commits`` and
    ``git_log_all`` (``sinks.tables.publish_views``) cannot register them.
    """
    chosen = " ".join(f"WHEN '{name}' THEN {name}" for name in DAILY_MEASURES)
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION panel_daily(measure STRING, time_from TIMESTAMP, time_to TIMESTAMP, days INT DEFAULT 1)
        RETURNS TABLE(time TIMESTAMP, value BIGINT, metric STRING)
        RETURN SELECT bucket, sum(asked), branch
          FROM (
            SELECT branch, CAST(date_from_unix_date(CAST(floor(unix_date(commit_day) / days) * days AS INT)) AS TIMESTAMP) AS bucket,
              CASE measure {chosen} ELSE raise_error(concat('no measure ', measure)) END AS asked
            FROM daily_activity
            WHERE commit_day IS NOT NULL AND (time_from IS NULL OR CAST(commit_day AS TIMESTAMP) >= time_from)
              AND (time_to IS NULL OR CAST(commit_day AS TIMESTAMP) <= time_to))
          GROUP BY bucket, branch""")
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION panel_branches(time_from TIMESTAMP, time_to TIMESTAMP)
        RETURNS TABLE(branch STRING, commit_count BIGINT, author_count BIGINT, first_commit_at TIMESTAMP, last_commit_at TIMESTAMP,
          total_insertions BIGINT, total_deletions BIGINT, total_changed_files BIGINT)
        RETURN SELECT branch, count(*), count(DISTINCT author_email), min(author_date), max(author_date),
            sum(insertions), sum(deletions), sum(changed_files)
          FROM commits
          WHERE (time_from IS NULL OR author_date >= time_from) AND (time_to IS NULL OR author_date <= time_to)
          GROUP BY branch""")
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in COMMIT_SCHEMA)
    names = ", ".join(COMMIT_SCHEMA.fieldNames())
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION git_log_of(wanted STRING)
        RETURNS TABLE(branch STRING, {columns})
        RETURN SELECT branch, {names} FROM git_log_all WHERE wanted IS NULL OR branch = wanted""")
