"""The explorer: one filter selection, five derived tables.

``facts`` is ``commits`` or the ``activity`` table of ``rollups``; filters touch only
columns both have, so an interactive session runs on the small table and reads commits
for the list of recent ones alone.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from branchlore.config import BuildConfig, Filters
from branchlore.functions.branches import configured_position, short_label
from branchlore.functions.times import commit_day
from branchlore.operators import rollups
from branchlore.operators.membership import having_key
from branchlore.operators.ordering import newest, order_by
from branchlore.staging import stage

AUTHOR_ORDER = ("-commit_count", "-last_commit_at", "first_seen")
RECENT = 25
TABLE_AUTHORS, CHART_AUTHORS, PICKER_AUTHORS = 15, 10, 60


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def in_scope(facts: DataFrame, filters: Filters) -> DataFrame:
    """Branch and day filters; a row without a date passes only when no bound is set."""
    day = F.col("commit_day") if "commit_day" in facts.columns else commit_day()
    conditions = [F.col("branch").isin(*filters.branches)]
    if filters.start:
        conditions.append(day >= F.lit(filters.start))
    if filters.end:
        conditions.append(day <= F.lit(filters.end))
    return facts.where(_all(conditions))


def apply_filters(facts: DataFrame, filters: Filters) -> DataFrame:
    scope = in_scope(facts, filters)
    return scope.where(F.col("author_email").isin(*filters.authors)) if filters.authors else scope


def keep_authors(facts: DataFrame, authors: DataFrame) -> DataFrame:
    """Author filter from a table of ``author_email``, for sets too large to list."""
    return having_key(facts, authors, "author_email")


def author_summaries(facts: DataFrame) -> DataFrame:
    """Per (e-mail, name) across branches."""
    return (
        rollups.as_facts(facts)
        .groupBy("author_email", "author_name")
        .agg(*rollups.measures("commit_count", *rollups.TOTALS, "last_commit_at"))
    )


def with_branches(authors: DataFrame, facts: DataFrame) -> DataFrame:
    """Adds the sorted set of branches that an author has commits on in ``facts``."""
    pairs = facts.select("author_email", "author_name", "branch").distinct()
    sets = pairs.groupBy("author_email", "author_name").agg(F.sort_array(F.collect_list("branch")).alias("branches"))
    return _with_author(authors, sets, "branches")


def _with_author(authors: DataFrame, more: DataFrame, *columns: str) -> DataFrame:
    """The authors with columns of another table of them; unknown e-mails and names match each other."""
    named = more.select(F.col("author_email").alias("_email"), F.col("author_name").alias("_name"), *columns)
    same = F.col("author_email").eqNullSafe(F.col("_email")) & F.col("author_name").eqNullSafe(F.col("_name"))
    return authors.join(named, same).select(*authors.columns, *columns)


def matching(authors: DataFrame, search: str) -> DataFrame:
    """Case-insensitive substring of name or e-mail; a blank term matches all."""
    term = search.strip().lower()
    if not term:
        return authors
    return authors.where(
        F.coalesce(F.lower("author_name").contains(term), F.lit(False))
        | F.coalesce(F.lower("author_email").contains(term), F.lit(False))
    )


def top_authors(authors: DataFrame, count: int, commits: DataFrame) -> DataFrame:
    """Most commits, then latest commit, then first appearance in the commit order, with their branches.

    Counts and dates alone find the last author wanted; ``commits``, under the same filters,
    is then read only for the authors not behind that one, which breaks ties exactly.
    """
    # an unknown latest date is the greatest
    place = F.struct("commit_count", F.col("last_commit_at").isNull().alias("unknown"), "last_commit_at")
    ahead = authors.select(place.alias("place")).orderBy(F.desc("place")).limit(count)
    wanted = authors.where(place >= ahead.agg(F.min("place")).scalar())
    theirs = _with_author(
        commits.select("author_email", "author_name", "branch", "author_date", "commit_id"),
        wanted.select("author_email", "author_name"),
    )
    seen = theirs.groupBy("author_email", "author_name").agg(
        F.min(_appearance()).alias("first_seen"), F.sort_array(F.collect_set("branch")).alias("branches")
    )
    return _with_author(wanted, seen, "first_seen", "branches").orderBy(*order_by(*AUTHOR_ORDER)).limit(count)


def _appearance() -> Column:
    """Position in the order (branch, newest first, commit_id), used to break ties."""
    return F.struct(
        F.col("branch"),
        F.col("author_date").isNotNull().alias("dated"),
        (-F.unix_micros("author_date")).alias("age"),
        F.col("commit_id").isNull().alias("anonymous"),
        F.col("commit_id"),
    )


def scope_authors(facts: DataFrame, filters: Filters) -> DataFrame:
    """Authors the picker offers: branch, days and search apply, chosen authors do not."""
    return matching(author_summaries(in_scope(facts, filters)), filters.search)


def picker(facts: DataFrame, filters: Filters, commits: DataFrame | None = None) -> DataFrame:
    """The authors offered; pass the ``commits`` where ``facts`` is the activity table."""
    commits = in_scope(facts if commits is None else commits, filters)
    return top_authors(scope_authors(facts, filters), PICKER_AUTHORS, commits)


def sync_authors(facts: DataFrame, filters: Filters) -> Filters:
    """Drop chosen authors that left the scope; reads at most as many rows as were chosen."""
    if not filters.authors:
        return filters
    chosen = scope_authors(facts, filters).where(F.col("author_email").isin(*filters.authors))
    valid = {row[0] for row in chosen.select("author_email").distinct().limit(len(filters.authors)).collect()}
    return replace(filters, authors=tuple(a for a in filters.authors if a in valid))


def select_visible_authors(facts: DataFrame, filters: Filters, commits: DataFrame | None = None) -> Filters:
    """Choose every author the picker shows (at most 60 rows are read)."""
    shown = [row[0] for row in picker(facts, filters, commits).select("author_email").collect()]
    return replace(filters, authors=tuple(dict.fromkeys(e for e in shown if e is not None)))


def branch_summaries(facts: DataFrame, config: BuildConfig) -> DataFrame:
    """Per branch in configured order (``position``); an unknown e-mail counts as one author."""
    return (
        rollups.as_facts(facts)
        .groupBy("branch")
        .agg(
            *rollups.measures("commit_count"),
            F.count_distinct(F.struct("author_email")).alias("author_count"),
            *rollups.measures("first_commit_at", "last_commit_at", *rollups.TOTALS),
        )
        .withColumn("position", configured_position("branch", config.branches))
    )


def daily_series(facts: DataFrame) -> DataFrame:
    """Per branch and known day."""
    return rollups.daily_activity(facts).where(F.col("commit_day").isNotNull())


def dense_series(facts: DataFrame, filters: Filters, config: BuildConfig) -> DataFrame:
    """The metric for every selected branch on every day any of them was active, 0 where idle.

    Added up per day and branch first; a day's few sums then become a map that is read once
    per selected branch.  Work per commit does not grow with the branches.
    """
    selected = [b for b in config.branches if b in filters.branches]
    daily = rollups.as_facts(facts).where(F.col("commit_day").isNotNull() & F.col("branch").isin(*selected))
    sums = daily.groupBy("commit_day", "branch").agg(F.sum(filters.metric).alias("value"))
    days = sums.groupBy("commit_day").agg(F.map_from_entries(F.collect_list(F.struct("branch", "value"))).alias("sums"))
    points = F.transform(
        F.array(*map(F.lit, selected)).cast("array<string>"),
        lambda b: F.struct(b.alias("branch"), F.coalesce(F.element_at("sums", b), F.lit(0)).alias("value")),
    )
    return days.select("commit_day", F.inline(points))


def headline(facts: DataFrame, filters: Filters) -> DataFrame:
    """One row; ``author_count`` counts (e-mail, name) pairs."""
    return rollups.as_facts(facts).agg(
        F.coalesce(F.sum("commit_count"), F.lit(0)).alias("commit_count"),
        F.count_distinct(F.struct("author_email", "author_name")).alias("author_count"),
        F.lit(len(filters.branches)).cast("long").alias("branch_count"),
        *[F.coalesce(F.sum(total), F.lit(0)).alias(total) for total in rollups.TOTALS],
        F.max("last_commit_at").alias("latest_commit_at"),
    )


def recent(commits: DataFrame, count: int = RECENT) -> DataFrame:
    """Newest commits; ties by branch, then commit_id."""
    return newest(commits, count, "branch", "commit_id")


def explore(
    commits: DataFrame, filters: Filters, config: BuildConfig, facts: DataFrame | None = None
) -> dict[str, DataFrame]:
    """All panels of one selection; pass the activity table as ``facts`` where there is one.

    Without it the commits in scope are added up once, staged, and all panels derive from that.
    """
    filters = filters.normalized(config)
    if facts is None:
        facts = stage(rollups.activity(in_scope(commits, filters)), "explorer-activity")
    filters = sync_authors(facts, filters)
    chosen, chosen_commits = apply_filters(facts, filters), apply_filters(commits, filters)
    authors = author_summaries(chosen)
    branches = branch_summaries(chosen, config)
    chart = branches.select("position", short_label("branch").alias("label"), "commit_count")
    return {
        "stats": headline(chosen, filters),
        "branches": branches.orderBy("position"),
        "branch_chart": rollups.share_of_largest(chart, "commit_count").orderBy("position"),
        "daily": daily_series(chosen).orderBy("commit_day", "branch"),
        "series": rollups.share_of_largest(dense_series(chosen, filters, config), "value"),
        "authors": top_authors(authors, TABLE_AUTHORS, chosen_commits),
        "author_chart": rollups.share_of_largest(top_authors(authors, CHART_AUTHORS, chosen_commits), "commit_count"),
        "picker": picker(facts, filters, commits),
        "recent": recent(chosen_commits),
    }
