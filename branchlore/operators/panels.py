"""Dashboard panels over ``commits`` (or the ``activity`` table), with optional range and limit."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from branchlore.functions.times import epoch_millis
from branchlore.operators import rollups
from branchlore.operators.enrich import enrich
from branchlore.operators.ordering import newest, order_by
from branchlore.schema import TRAILER_COLUMNS

PANEL_ROWS = 250

RECENT_COLUMNS = (
    "branch",
    "commit_id",
    "author_name",
    "author_email",
    "time",
    "time_unix_ms",
    "summary",
    *TRAILER_COLUMNS,
    "mentioned_people",
    "mentioned_urls",
    "insertions",
    "deletions",
    "changed_files",
)


def in_range(df: DataFrame, column: str, start: dt.datetime | None, end: dt.datetime | None) -> DataFrame:
    """Inclusive range on a timestamp column, bounds in UTC; either may be open."""
    if start is not None:
        df = df.where(F.col(column) >= _instant(start))
    if end is not None:
        df = df.where(F.col(column) <= _instant(end))
    return df


def _utc(moment: dt.datetime) -> dt.datetime:
    """The moment in UTC; without a zone it is UTC already, whatever the driver's zone."""
    return moment.astimezone(dt.timezone.utc) if moment.tzinfo else moment.replace(tzinfo=dt.timezone.utc)


def _instant(moment: dt.datetime):
    return F.lit(_utc(moment))


def daily_panel(
    daily: DataFrame,
    metric: str,
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
    interval: str = "1 day",
) -> DataFrame:
    """Sum of one ``daily_activity`` measure per epoch-aligned interval and branch.

    The range tests the midnight of each day, so a first day cut by the range drops out.
    It is put as a range of days, which reaches the scan as a range of author dates.
    """
    if start is not None:
        start = _utc(start)
        first = start.date() + dt.timedelta(days=start.time() != dt.time())
        daily = daily.where(F.col("commit_day") >= F.lit(first))
    if end is not None:
        daily = daily.where(F.col("commit_day") <= F.lit(_utc(end).date()))
    midnight = F.col("commit_day").cast("timestamp")
    return (
        daily.where(F.col("commit_day").isNotNull())
        .groupBy(F.window(midnight, interval).alias("_bucket"), "branch")
        .agg(F.sum(metric).alias("value"))
        .select(F.col("_bucket.start").alias("time"), "value", F.col("branch").alias("metric"))
        .orderBy(*order_by("time", "metric"))
    )


def branch_panel(commits: DataFrame, start: dt.datetime | None = None, end: dt.datetime | None = None) -> DataFrame:
    summary = rollups.branch_summary(in_range(commits, "author_date", start, end))
    return summary.orderBy(*order_by("-commit_count", "branch"))


def authors_panel(
    commits: DataFrame,
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
    limit: int | None = PANEL_ROWS,
) -> DataFrame:
    ordered = rollups.author_activity(in_range(commits, "author_date", start, end)).orderBy(
        *order_by("-commit_count", "-last_commit_at", "author_email", "branch", "author_name")
    )
    return ordered if limit is None else ordered.limit(limit)


def recent_panel(
    commits: DataFrame,
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
    limit: int = PANEL_ROWS,
) -> DataFrame:
    rows = newest(in_range(commits, "author_date", start, end), limit, "commit_id", "branch")
    return rows.select(
        F.col("author_date").alias("time"),
        "branch",
        "author_name",
        "summary",
        "insertions",
        "deletions",
        "changed_files",
    )


def facts_in_range(commits: DataFrame, activity: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """The facts of a range: whole days from the activity table, the two cut days from the commits."""
    start, end = _utc(start), _utc(end)
    whole = activity.where(F.col("commit_day") > F.lit(start.date())).where(F.col("commit_day") < F.lit(end.date()))
    first_ends = dt.datetime.combine(start.date(), dt.time.max, dt.timezone.utc)
    last_begins = max(dt.datetime.combine(end.date(), dt.time.min, dt.timezone.utc), first_ends)
    date = F.col("author_date")
    first = in_range(commits, "author_date", start, min(first_ends, end))
    last = in_range(commits.where(date > _instant(first_ends)), "author_date", last_begins, end)
    return whole.unionByName(rollups.as_facts(first)).unionByName(rollups.as_facts(last))


def live_panels(
    commits: DataFrame, activity: DataFrame, start: dt.datetime | None = None, end: dt.datetime | None = None
) -> dict[str, DataFrame]:
    """The dashboard's panel queries by title, over the activity table as far as days are whole.

    The range has both bounds or none.
    """
    daily = rollups.daily_activity(activity)
    facts = facts_in_range(commits, activity, start, end) if start and end else activity
    return {
        "Daily Commit Count By Branch": daily_panel(daily, "commit_count", start, end),
        "Daily Insertions By Branch": daily_panel(daily, "total_insertions", start, end),
        "Branch Summary": branch_panel(facts),
        "Top Authors": authors_panel(facts),
        "Recent Commits": recent_panel(commits, start, end),
    }


def timed(commits: DataFrame) -> DataFrame:
    """``author_date`` as ``time`` and as epoch milliseconds."""
    return commits.withColumn("time_unix_ms", epoch_millis("author_date")).withColumnRenamed(
        "author_date", "time"
    )


def recent_commits(git_log_all: DataFrame, limit: int = PANEL_ROWS) -> DataFrame:
    """The newest commits of all branches, with their trailers.

    Enrichment works row by row, so the newest rows are picked first and only they are
    parsed.  Also takes the stored ``commits`` table, whose parsed columns are used.
    """
    # without a node in between, the optimizer moves the parsing below the limit and then
    # sorts all rows instead of keeping the top ones per task
    rows = newest(git_log_all, limit, "commit_id", "branch").coalesce(1)
    parsed = rows if "mentioned_people" in rows.columns else enrich(rows)
    return timed(parsed).select(*RECENT_COLUMNS)
