"""Rollups of the commit facts.

Every function over ``facts`` takes either ``commits`` or the ``activity`` table, which
is ``commits`` already added up per branch, day and author.  Sums, minima and maxima add
up the same from both, so a build scans the commits once and rolls up the small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from branchlore.functions.branches import root_first
from branchlore.functions.times import commit_day, day_to_iso, epoch_millis
from branchlore.schema import PERSON_FIELDS

TOTALS = ("total_insertions", "total_deletions", "total_changed_files")


def as_facts(facts: DataFrame) -> DataFrame:
    """Measures under common names, one row per commit or per activity group."""
    if "commit_count" in facts.columns:
        return facts
    return facts.select(
        "branch",
        commit_day().alias("commit_day"),
        "author_name",
        "author_email",
        F.lit(1).cast("long").alias("commit_count"),
        F.col("insertions").alias("total_insertions"),
        F.col("deletions").alias("total_deletions"),
        F.col("changed_files").alias("total_changed_files"),
        F.col("author_date").alias("first_commit_at"),
        F.col("author_date").alias("last_commit_at"),
    )


def measures(*names: str) -> list[Column]:
    how = {"first_commit_at": F.min, "last_commit_at": F.max}
    return [how.get(name, F.sum)(name).alias(name) for name in names]


def activity(commits: DataFrame) -> DataFrame:
    """Commits added up per branch, day and author: the table the explorer reads.

    Only numbers and times are aggregated, so commits are hashed and never sorted.
    """
    return (
        as_facts(commits)
        .groupBy("branch", "commit_day", "author_name", "author_email")
        .agg(*measures("commit_count", *TOTALS, "first_commit_at", "last_commit_at"))
    )


def authors(facts: DataFrame) -> DataFrame:
    return (
        as_facts(facts)
        .groupBy("branch", "author_name", "author_email")
        .agg(*measures("commit_count", "first_commit_at", "last_commit_at"))
    )


def author_activity(facts: DataFrame) -> DataFrame:
    return (
        as_facts(facts)
        .groupBy("branch", "author_name", "author_email")
        .agg(*measures("commit_count", *TOTALS, "last_commit_at"))
    )


def daily_activity(facts: DataFrame) -> DataFrame:
    return as_facts(facts).groupBy("branch", "commit_day").agg(*measures("commit_count", *TOTALS))


def with_day_times(daily: DataFrame) -> DataFrame:
    """The dashboard form: the day also as ISO text and epoch milliseconds."""
    return daily.select(
        "branch",
        "commit_day",
        day_to_iso("commit_day").alias("time"),
        epoch_millis("commit_day").alias("time_unix_ms"),
        "commit_count",
        *TOTALS,
    )


def branch_summary(facts: DataFrame) -> DataFrame:
    """Per branch; ``author_count`` counts known e-mail addresses."""
    return (
        as_facts(facts)
        .groupBy("branch")
        .agg(
            *measures("commit_count"),
            F.count_distinct("author_email").alias("author_count"),
            *measures("first_commit_at", "last_commit_at", *TOTALS),
        )
    )


SKETCH_BITS = 14  # a sketch is 16 kB at most; the standard error of its estimate is below 1 %


def author_sketches(commits: DataFrame) -> DataFrame:
    """Per branch and day a mergeable sketch of the known e-mail addresses, and the commits.

    Sketches of any days and branches can be merged, so distinct authors of a filter come
    without the people being counted again.
    """
    return (
        commits.groupBy("branch", commit_day().alias("commit_day"))
        .agg(F.count(F.lit(1)).alias("commit_count"), F.hll_sketch_agg("author_email", F.lit(SKETCH_BITS)).alias("authors_sketch"))
    )


def branch_authors_approx(sketches: DataFrame, *by: str) -> DataFrame:
    """``commit_count`` and ``approx_author_count`` of sketches, per branch or what ``by`` names; () for all."""
    return sketches.groupBy(*by).agg(
        F.sum("commit_count").alias("commit_count"),
        F.hll_sketch_estimate(F.hll_union_agg("authors_sketch")).alias("approx_author_count"),
    )


def trailer_summary(trailers: DataFrame) -> DataFrame:
    return trailers.groupBy("branch", "trailer_field", "trailer_category", "trailer_value").agg(
        F.count(F.lit(1)).alias("entry_count"),
        F.count_distinct("commit_id").alias("commit_count"),
        F.min("author_date").alias("first_commit_at"),
        F.max("author_date").alias("last_commit_at"),
    )


def trailer_people_summary(trailers: DataFrame) -> DataFrame:
    """Per person; reference trailers mention nobody.  ``trailer_fields`` is sorted."""
    fields = sorted(PERSON_FIELDS)
    # seven possible fields fit in the bits of one number, which keeps the hash aggregate
    bit = F.element_at(
        F.create_map(*[F.lit(x) for i, field in enumerate(fields) for x in (field, 1 << i)]),
        F.col("trailer_field"),
    )
    present = F.filter(
        F.array(*[F.when(F.col("_fields").bitwiseAND(1 << i) != 0, field) for i, field in enumerate(fields)]),
        lambda field: field.isNotNull(),
    )
    return (
        trailers.select("branch", F.explode("people").alias("person"), "commit_id", bit.alias("_bit"), "author_date")
        .groupBy("branch", "person")
        .agg(
            F.count(F.lit(1)).alias("mention_count"),
            F.count_distinct("commit_id").alias("commit_count"),
            F.bit_or("_bit").alias("_fields"),
            F.min("author_date").alias("first_commit_at"),
            F.max("author_date").alias("last_commit_at"),
        )
        .select(
            "branch",
            "person",
            "mention_count",
            "commit_count",
            present.alias("trailer_fields"),
            "first_commit_at",
            "last_commit_at",
        )
    )


def branch_names(facts: DataFrame) -> DataFrame:
    return facts.select("branch").distinct()


def sorted_branch_names(facts: DataFrame, root: str) -> DataFrame:
    """One row: the branches present, root first (a handful of names)."""
    ranked = branch_names(facts).select(F.struct(root_first("branch", root).alias("rank"), "branch").alias("b"))
    return ranked.agg(F.sort_array(F.collect_list("b")).alias("b")).select(
        F.col("b.branch").alias("branches")
    )


def date_bounds(facts: DataFrame) -> DataFrame:
    """First and last day with commits, over known dates."""
    return as_facts(facts).agg(
        F.min("commit_day").alias("min_day"), F.max("commit_day").alias("max_day")
    )


def share_of_largest(rows: DataFrame, metric: str) -> DataFrame:
    """Adds ``relative_value``: the metric over its largest value, which is at least 1."""
    largest = rows.agg(F.greatest(F.coalesce(F.max(metric), F.lit(0)), F.lit(1)).alias("m"))
    return rows.withColumn("relative_value", F.col(metric) / largest.scalar())
