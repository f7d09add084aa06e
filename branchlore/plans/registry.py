"""Named queries over the commit tables derived from a test-data folder.

Results are put in an engine-neutral form: arrays as text joined by U+0001, dates and
timestamps as text, counts as long.  Numbers that may be NULL are text too, since tools
differ in what a NULL makes of a whole number.
"""

from __future__ import annotations

import contextlib
import datetime as dt
import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from branchlore.config import Filters, last_days
from branchlore.functions import branches, text, times
from branchlore.functions.sql import register_functions, register_panels
from branchlore.operators import explore, panels, quality, rollups
from branchlore.operators.enrich import churn_defaults, commit_trailers, enrich, with_trailers
from branchlore.operators.ordering import DATASET_ORDERS, ROOT_FIRST
from branchlore.operators.reconcile import (
    drop_churn,
    newest_commits,
    reconcile,
    reconcile_bucketed,
    reconcile_keys_first,
    reconcile_table,
    root_view,
    union_branches,
)
from branchlore.operators.repositories import read_repositories, reconcile_repositories
from branchlore.plans.build import (
    EXPORTS,
    SECTION_EXPORTS,
    document_sections,
    publish_from_catalog,
    relations,
    write_dashboard,
    write_exports,
)
from branchlore.schema import CHURN_COLUMNS, TRAILER_COLUMNS, trailer_field_catalog
from branchlore.session import configure
from branchlore.sinks import document as doc
from branchlore.sinks import snapshots
from branchlore.sinks.export import JSON_OPTIONS, TIMESTAMP_FORMAT, write_array, write_dataset
from branchlore.sinks.tables import publish_views, save_bucketed
from branchlore.sources import frames, log_dump, testdata
from branchlore.sources.branch_tables import load_catalog_branches, read_branches, relation_of
from branchlore.sources.datasets import read_dataset, read_sections, select_section, with_positions
from branchlore.staging import stage, staging_path
from branchlore.streaming.commits import ARRIVAL_SCHEMA, read_commit_stream, store_commits, store_daily_sums
from branchlore.streaming.reconciled import read_reconciled, store_reconciled
from branchlore.streaming.windows import daily_with_late, store_daily_windows

Query = Callable[[SparkSession, str], DataFrame]

CONFIG = testdata.FIXTURE_CONFIG
AS_OF = dt.datetime(2024, 1, 31, 6)
RANGE = last_days(AS_OF, 21)
JOINER = "\u0001"
BUCKETS = 8
CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "timestampFormat": TIMESTAMP_FORMAT,
}

ALL = Filters(branches=CONFIG.preset("all"))
STABLE = Filters(branches=CONFIG.preset("stable"), start="2024-01-05", metric="total_insertions")
TWO_AUTHORS = Filters(branches=CONFIG.preset("all"), authors=("u12@example.org", "u7@example.org"))
WINDOWED = Filters(branches=CONFIG.preset("all"), start="2024-01-08", end="2024-01-20")
SEARCH = Filters(branches=CONFIG.preset("all"), search=" USER 12")
EVERYTHING = Filters(
    branches=CONFIG.preset("all"), start="2024-01-03", end="2024-01-25", metric="total_insertions", search="user 1"
)
SYNCED = Filters(
    branches=CONFIG.preset("stable"), authors=("u12@example.org", "u7@example.org", "nobody@example.org"), end="2024-01-10"
)
ROOT_ONLY = Filters(start="2024-01-20", end="2024-01-10")  # no branch, crossed days
NO_MATCH = Filters(branches=CONFIG.preset("all"), start="1999-01-01", end="1999-12-31")

_QUERIES: dict[str, Query] = {}


def _register(function: Query, name: str = "") -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return neutral(function(configure(spark), sf_dir))

    _QUERIES[name or function.__name__] = run
    return function


def _named(name: str) -> Callable[[Query], Query]:
    return lambda function: _register(function, name)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def neutral(df: DataFrame) -> DataFrame:
    """Arrays, dates and timestamps as text, so that any engine's rows compare."""

    def put(field: T.StructField) -> Column:
        column = F.col(field.name)
        if isinstance(field.dataType, T.ArrayType):
            column = F.array_join(column, JOINER)
        elif isinstance(field.dataType, T.TimestampType):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(field.dataType, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(field.dataType, T.IntegerType):
            column = column.cast("long")
        return column.alias(field.name)

    return df.select(*[put(field) for field in df.schema.fields])


def tables_of(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return testdata.branch_tables(spark, sf_dir)


def as_text(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def log_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile(tables_of(spark, sf_dir), CONFIG)


def commits_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich(log_of(spark, sf_dir))


def trailers_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commit_trailers(commits_of(spark, sf_dir))


# --- branch model -----------------------------------------------------------------


@_register
def git_log_all(spark, sf_dir):
    return as_text(log_of(spark, sf_dir), *CHURN_COLUMNS)


@_register
def git_log_all_keys_first(spark, sf_dir):
    return as_text(reconcile_keys_first(tables_of(spark, sf_dir), CONFIG), *CHURN_COLUMNS)


@_register
def git_log_all_one_table(spark, sf_dir):
    together = union_branches(tables_of(spark, sf_dir), CONFIG.branches)
    return as_text(reconcile_table(together, CONFIG), *CHURN_COLUMNS)


@_register
def git_log_all_bucketed(spark, sf_dir):
    """Branch tables stored in buckets of the id, joined where they lie."""
    with _schema(spark) as schema:
        tables = {
            branch: save_bucketed(table, f"{schema}.{relation_of(branch)}", BUCKETS)
            for branch, table in tables_of(spark, sf_dir).items()
        }
        unified = stage(reconcile_bucketed(tables, CONFIG), "bucketed")  # the tables go away
    return as_text(unified, *CHURN_COLUMNS)


# Repository to root branch; all share the ids of their commits.
REPOSITORY_ROOTS = {"core": "master", "fork": "REL_18_STABLE", "mirror": "master"}
REPOSITORY_BRANCHES = {"core": CONFIG.branches, "fork": CONFIG.branches, "mirror": ("master", "REL_17_STABLE")}


@_register
def git_log_all_repositories(spark, sf_dir):
    stored = {}
    for branch, table in tables_of(spark, sf_dir).items():
        stored[branch] = staging_path(spark, "repository")
        table.write.parquet(stored[branch])
    paths = {repository: {b: stored[b] for b in held} for repository, held in REPOSITORY_BRANCHES.items()}
    return as_text(reconcile_repositories(read_repositories(spark, paths), REPOSITORY_ROOTS), *CHURN_COLUMNS)


@_register
def git_log_root(spark, sf_dir):
    return as_text(root_view(log_of(spark, sf_dir), CONFIG), *CHURN_COLUMNS)


@_register
def max_commits(spark, sf_dir):
    newest = newest_commits(tables_of(spark, sf_dir), 300)
    return union_branches(newest, CONFIG.branches).select("branch", "commit_id", "commit_date")


@_register
def no_diff_commits(spark, sf_dir):
    tables = {b: drop_churn(t) for b, t in tables_of(spark, sf_dir).items()}
    return rollups.branch_summary(enrich(reconcile(tables, CONFIG)))


@_register
def branch_suffix(spark, sf_dir):
    names = testdata.branch_names(spark, sf_dir)
    return names.select("eid", "branch_name", branches.branch_suffix("branch_name").alias("suffix"))


@_register
def branch_list_normalized(spark, sf_dir):
    listed = testdata.branch_lists(spark, sf_dir)
    normalized = branches.branch_list("branches_csv", F.lit(" master "))
    return listed.select("eid", branches.join_list(normalized).alias("branches"))


@_register
def branch_list_items(spark, sf_dir):
    items = F.posexplode(branches.branch_list("branches_csv", F.lit("master"))).alias("ordinality", "branch")
    return testdata.branch_lists(spark, sf_dir).select("eid", items)


@_register
def branch_labels(spark, sf_dir):
    name = F.col("branch_name")
    return testdata.branch_names(spark, sf_dir).select(
        "eid",
        branches.short_label(name).alias("label"),
        branches.root_first(name, CONFIG.root_branch).alias("root_rank"),
        branches.configured_position(name, CONFIG.branches).cast("string").alias("position"),
        branches.suffix_of_relation(F.concat(F.lit("git_log_"), branches.branch_suffix(name))).alias("inferred"),
    )


@_register
def branch_list(spark, sf_dir):
    return rollups.sorted_branch_names(log_of(spark, sf_dir), CONFIG.root_branch)


# --- enriched facts ---------------------------------------------------------------


@_register
def commits(spark, sf_dir):
    return commits_of(spark, sf_dir)


@_register
def commits_churn(spark, sf_dir):
    churn = churn_defaults(log_of(spark, sf_dir))
    return churn.select("branch", "commit_id", "deltas", "insertions", "deletions", "changed_files")


@_register
def commits_trailers_arrays(spark, sf_dir):
    return with_trailers(log_of(spark, sf_dir)).select("branch", "commit_id", *TRAILER_COLUMNS)


@_register
def commits_mentions(spark, sf_dir):
    return commits_of(spark, sf_dir).select("branch", "commit_id", "mentioned_people", "mentioned_urls")


@_named("commit_trailers")
def commit_trailer_rows(spark, sf_dir):
    return trailers_of(spark, sf_dir)


@_register
def trailer_url_rows(spark, sf_dir):
    urls = F.posexplode("urls").alias("position", "url")
    return trailers_of(spark, sf_dir).select("branch", "commit_id", "trailer_field", "trailer_value", urls)


@_register
def message_lines(spark, sf_dir):
    lines = F.posexplode(text.message_lines("message")).alias("line_number", "line")
    return log_of(spark, sf_dir).select("branch", "commit_id", lines)


@_register
def unique_message_lines(spark, sf_dir):
    unique = text.unique_text_array(text.message_lines("message"))
    return log_of(spark, sf_dir).select("branch", "commit_id", unique.alias("unique_lines"))


@_register
def sql_extract_field(spark, sf_dir):
    register_functions(spark)
    return spark.sql(
        """SELECT branch, commit_id,
               extract_field(message, 'Reviewed-by') AS reviewed_by,
               extract_field(message, 'Bug') AS bug,
               extract_urls(extract_field(message, 'Discussion')) AS urls,
               unique_text_array(extract_field(message, 'Reported-by')) AS reporters,
               branch_suffix(branch) AS suffix,
               is_person_trailer('Bug') AS bug_is_person
           FROM {log}""",
        log=log_of(spark, sf_dir),
    )


@_named("trailer_field_catalog")
def trailer_catalog_entries(spark, sf_dir):
    entries = trailers_of(spark, sf_dir).groupBy("trailer_field").agg(F.count(F.lit(1)).alias("entry_count"))
    catalog = trailer_field_catalog(spark).join(entries, "trailer_field", "left")
    return catalog.select(
        "ordinality",
        "trailer_field",
        "column_name",
        "category",
        text.is_person_trailer("trailer_field").alias("is_person"),
        F.coalesce("entry_count", F.lit(0)).alias("entry_count"),
    )


# --- rollups ----------------------------------------------------------------------


@_register
def authors(spark, sf_dir):
    return rollups.authors(log_of(spark, sf_dir))


@_register
def author_activity(spark, sf_dir):
    return rollups.author_activity(commits_of(spark, sf_dir))


@_register
def daily_activity(spark, sf_dir):
    return rollups.daily_activity(commits_of(spark, sf_dir))


@_register
def daily_activity_dashboard(spark, sf_dir):
    daily = rollups.daily_activity(commits_of(spark, sf_dir))
    return as_text(rollups.with_day_times(daily), "time_unix_ms")


@_register
def branch_summary(spark, sf_dir):
    return rollups.branch_summary(commits_of(spark, sf_dir))


@_register
def branch_summary_from_activity(spark, sf_dir):
    return rollups.branch_summary(rollups.activity(commits_of(spark, sf_dir)))


@_register
def branch_summary_approx(spark, sf_dir):
    """Distinct authors from stored sketches, of all days and of some, beside the exact counts."""
    commits = commits_of(spark, sf_dir)
    sketches = stage(rollups.author_sketches(commits), "author-sketches")
    found = []
    for scope, filters in (("all", ALL), ("window", WINDOWED)):
        days = [F.col("commit_day") >= filters.start] if filters.start else []
        days += [F.col("commit_day") <= filters.end] if filters.end else []
        chosen = reduce(DataFrame.where, days, sketches)
        approx = rollups.branch_authors_approx(chosen, "branch")
        exact = rollups.branch_summary(explore.apply_filters(commits, filters)).select("branch", "author_count")
        near = F.abs(F.col("approx_author_count") - F.col("author_count")) <= 0.03 * F.col("author_count")
        joined = approx.join(exact, "branch")
        found.append(joined.select(F.lit(scope).alias("scope"), "branch", "commit_count", "author_count", near.alias("within_3_percent")))
    return found[0].unionByName(found[1])


@_register
def trailer_summary(spark, sf_dir):
    return rollups.trailer_summary(trailers_of(spark, sf_dir))


@_register
def trailer_people_summary(spark, sf_dir):
    return rollups.trailer_people_summary(trailers_of(spark, sf_dir))


@_register
def date_bounds(spark, sf_dir):
    return rollups.date_bounds(commits_of(spark, sf_dir))


@_register
def branch_display(spark, sf_dir):
    return rollups.branch_summary(commits_of(spark, sf_dir)).select(
        "branch",
        times.display_number("total_insertions").alias("insertions"),
        times.display_instant("last_commit_at").alias("last_commit"),
        times.instant_to_iso("last_commit_at").alias("last_commit_iso"),
        times.iso_day(times.instant_to_iso("first_commit_at")).alias("first_day"),
    )


# --- panels -----------------------------------------------------------------------


@_register
def recent_commits(spark, sf_dir):
    return as_text(panels.recent_commits(log_of(spark, sf_dir)), "time_unix_ms")


@_register
def commits_timed(spark, sf_dir):
    timed = panels.timed(commits_of(spark, sf_dir))
    return as_text(timed.select("branch", "commit_id", "time", "time_unix_ms", "message"), "time_unix_ms")


@_register
def panel_daily_commits(spark, sf_dir):
    daily = rollups.daily_activity(commits_of(spark, sf_dir))
    return panels.daily_panel(daily, "commit_count", *RANGE)


@_register
def panel_daily_insertions(spark, sf_dir):
    daily = rollups.daily_activity(commits_of(spark, sf_dir))
    return panels.daily_panel(daily, "total_insertions", *RANGE, interval="7 days")


@_register
def panel_branch_summary(spark, sf_dir):
    return panels.branch_panel(commits_of(spark, sf_dir), *RANGE)


@_register
def panel_top_authors(spark, sf_dir):
    return panels.authors_panel(commits_of(spark, sf_dir), *RANGE)


@_register
def panel_recent_commits(spark, sf_dir):
    return panels.recent_panel(commits_of(spark, sf_dir), *RANGE)


# --- explorer ---------------------------------------------------------------------


def _facts(spark, sf_dir):
    return commits_of(spark, sf_dir)


@_register
def explore_stats(spark, sf_dir):
    return explore.headline(explore.apply_filters(_facts(spark, sf_dir), WINDOWED), WINDOWED)


@_register
def explore_stats_no_match(spark, sf_dir):
    return explore.headline(explore.apply_filters(_facts(spark, sf_dir), NO_MATCH), NO_MATCH)


@_register
def explore_stats_root_default(spark, sf_dir):
    filters = ROOT_ONLY.normalized(CONFIG)
    return explore.headline(explore.apply_filters(_facts(spark, sf_dir), filters), filters)


@_register
def explore_authors(spark, sf_dir):
    chosen = explore.apply_filters(_facts(spark, sf_dir), ALL)
    top = explore.top_authors(explore.author_summaries(chosen), explore.TABLE_AUTHORS, chosen)
    return top.drop("first_seen")


@_register
def explore_authors_chosen(spark, sf_dir):
    chosen = explore.apply_filters(_facts(spark, sf_dir), TWO_AUTHORS)
    return explore.with_branches(explore.author_summaries(chosen), chosen)


@_register
def explore_authors_semi_join(spark, sf_dir):
    offered = explore.scope_authors(_facts(spark, sf_dir), SEARCH)
    kept = explore.keep_authors(explore.apply_filters(_facts(spark, sf_dir), ALL), offered)
    return explore.branch_summaries(kept, CONFIG)


@_register
def explore_branches(spark, sf_dir):
    return explore.branch_summaries(explore.apply_filters(_facts(spark, sf_dir), WINDOWED), CONFIG)


@_register
def explore_daily(spark, sf_dir):
    return explore.daily_series(explore.apply_filters(_facts(spark, sf_dir), WINDOWED))


@_register
def explore_daily_zero_filled(spark, sf_dir):
    chosen = explore.apply_filters(_facts(spark, sf_dir), STABLE)
    return explore.dense_series(chosen, STABLE, CONFIG)


@_register
def explore_share_of_max(spark, sf_dir):
    chosen = explore.apply_filters(_facts(spark, sf_dir), STABLE)
    return rollups.share_of_largest(explore.dense_series(chosen, STABLE, CONFIG), "value")


@_register
def explore_recent(spark, sf_dir):
    chosen = explore.apply_filters(commits_of(spark, sf_dir), WINDOWED)
    return explore.recent(chosen).select("branch", "commit_id", "author_date", "author_name", "summary")


@_register
def explore_author_search(spark, sf_dir):
    return explore.picker(_facts(spark, sf_dir), SEARCH).drop("first_seen")


@_register
def explore_from_activity(spark, sf_dir):
    commits = commits_of(spark, sf_dir)
    authors = explore.author_summaries(explore.apply_filters(rollups.activity(commits), WINDOWED))
    top = explore.top_authors(authors, explore.CHART_AUTHORS, explore.apply_filters(commits, WINDOWED))
    return top.drop("first_seen")


def _as_lines(df: DataFrame, panel: str) -> DataFrame:
    """Rows of any panel as text: the values joined, shares in millionths."""
    shown = neutral(df.drop("first_seen"))
    values = [
        F.round(F.col(c) * 1_000_000).cast("long").cast("string") if t == "double" else F.col(c).cast("string")
        for c, t in shown.dtypes
    ]
    line = F.concat_ws("|", *[F.coalesce(v, F.lit("")) for v in values])
    return shown.select(F.lit(panel).alias("panel"), line.alias("line"))


@_register
def explore_all(spark, sf_dir):
    panels_ = explore.explore(commits_of(spark, sf_dir), EVERYTHING, CONFIG)
    panels_["recent"] = panels_["recent"].select("branch", "commit_id", "author_date", "author_name", "summary")
    return reduce(DataFrame.unionByName, [_as_lines(df, name) for name, df in panels_.items()])


@_register
def explore_author_sync(spark, sf_dir):
    """The chosen authors that stay when the days change, then every author the picker shows."""
    commits = commits_of(spark, sf_dir)
    activity = stage(rollups.activity(commits), "explorer-activity")
    stay = explore.sync_authors(activity, SYNCED).authors
    shown = explore.select_visible_authors(activity, SEARCH, commits).authors
    rows = [F.struct(F.lit(k).alias("step"), F.lit(e).alias("author_email")) for k, es in (("stay", stay), ("shown", shown)) for e in es]
    return spark.range(1).select(F.inline(F.array(*rows)))


# --- other sources and sinks ------------------------------------------------------


@_register
def numstat_rollup(spark, sf_dir):
    return log_dump.numstat_rollup(testdata.numstat_lines(spark, sf_dir))


@_register
def log_dump_commits(spark, sf_dir):
    records = log_dump.render_log_records(testdata.commits_with_numstat(spark, sf_dir))
    return as_text(log_dump.parse_log_records(records), *CHURN_COLUMNS)


@_register
def frame_to_rows(spark, sf_dir):
    column_frames = testdata.column_frames(spark, sf_dir)
    return frames.frame_rows(column_frames, ("day", "count", "field_2"), keep=("branch", "month"))


@_register
def frame_cells(spark, sf_dir):
    return frames.frame_cells(testdata.column_frames(spark, sf_dir), keep=("branch", "month"))


@_register
def json_roundtrip(spark, sf_dir):
    trailers = trailers_of(spark, sf_dir)
    path = staging_path(spark, "commit-trailers")
    write_dataset(trailers, path, DATASET_ORDERS["commit_trailers"], CONFIG.root_branch)
    return read_dataset(spark, path, trailers.schema)


def _build_tables(spark, sf_dir) -> dict[str, DataFrame]:
    """The stored relations of a build: commits once, all rollups from the staged activity."""
    commits = stage(commits_of(spark, sf_dir), "commits")
    activity = stage(rollups.activity(commits), "activity")
    return relations(spark, commits, commit_trailers(commits), activity)


def _written(spark, sf_dir, position: str | None = None) -> tuple[str, dict[str, DataFrame]]:
    """Path of a written document, and its sections read back."""
    folder = staging_path(spark, "data")
    stored = _build_tables(spark, sf_dir)
    exports = write_exports(stored, folder, CONFIG.root_branch, SECTION_EXPORTS.values())
    sections = document_sections(stored)
    write_dashboard(sections, doc.metadata(stored["commits"], CONFIG, AS_OF), exports, folder, CONFIG.root_branch)
    path = f"{folder}/dashboard"
    return path, read_sections(spark, path, {name: df.schema for name, df in sections.items()}, position)


@_register
def document_metadata(spark, sf_dir):
    path, _ = _written(spark, sf_dir)
    schema = doc.metadata(commits_of(spark, sf_dir), CONFIG, AS_OF).schema
    document = read_dataset(spark, path, T.StructType([T.StructField("metadata", schema)]), whole=True)
    return document.select("metadata.*")


@_register
def document_section_scan(spark, sf_dir):
    path, sections = _written(spark, sf_dir)
    panel = next(p for p in quality.PANELS if p.title == "Branch Summary")
    section = T.StructField(panel.datasets[0], T.ArrayType(sections[panel.datasets[0]].schema))
    document = read_dataset(spark, path, T.StructType([section]), whole=True)
    return select_section(document, panel.datasets[0], panel.columns)


@_named("document_sections")
def document_sections_read(spark, sf_dir):
    """Rows of all eight sections with their places, whether in the document or beside it."""
    _, sections = _written(spark, sf_dir, "position")
    lines = []
    for name, df in sections.items():
        keys = [key.lstrip("-") for key in doc.section_keys(df, name) if key != ROOT_FIRST]
        lines.append(_as_lines(df.select(*keys, "position"), name))
    return reduce(DataFrame.unionByName, lines)


def _export(name: str) -> None:
    def run(spark, sf_dir):
        stored = _build_tables(spark, sf_dir)[EXPORTS[name]]
        path = staging_path(spark, f"export-{name}")
        write_dataset(stored, path, DATASET_ORDERS[name], CONFIG.root_branch)
        numbered = with_positions(read_dataset(spark, path, stored.schema))
        if name != "trailer_fields":
            return numbered
        return numbered.select("position", "ordinality", "trailer_field", "column_name", "category")

    _register(run, f"export_{name}")


for _name in EXPORTS:
    _export(_name)


@_register
def export_authors_array(spark, sf_dir):
    """The authors as one JSON array, read back in its order."""
    stored = _build_tables(spark, sf_dir)["author_activity"]
    path = staging_path(spark, "array-authors")
    write_array(stored, path, DATASET_ORDERS["authors"], CONFIG.root_branch)
    # one file is one partition: rows are numbered in the array's order
    rows = spark.read.schema(stored.schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    return rows.withColumn("position", F.monotonically_increasing_id() + 1)


@_register
def refresh_facts(spark, sf_dir):
    """Two versions of the commits: what a reader of the first still sees, and which version wrote each branch."""
    root = staging_path(spark, "facts")
    tables = tables_of(spark, sf_dir)
    grows = CONFIG.branches[-1]
    early = {**tables, grows: tables[grows].where("author_date < '2024-01-20'")}
    for state in (early, tables):
        unified = reconcile(state, CONFIG)
        snapshots.refresh(enrich(unified), root, "author_date", source=unified)
    schema = enrich(reconcile(tables, CONFIG)).schema
    before, now = (snapshots.read_version(spark, root, schema, version) for version in (1, 2))
    written = {part.branch: part.folder for part in snapshots.parts(spark, root)}
    folder = F.element_at(F.create_map(*[F.lit(x) for pair in written.items() for x in pair]), F.col("branch"))
    counts = lambda df, name: df.groupBy("branch").agg(F.count(F.lit(1)).alias(name))
    joined = counts(before, "count_before").join(counts(now, "count_now"), "branch")
    return joined.select("branch", "count_before", "count_now", folder.alias("written_by"))


def _published(spark, sf_dir):
    unified = log_of(spark, sf_dir)
    publish_views(spark, {"git_log_all": unified, "commits": enrich(unified), "daily_activity": rollups.daily_activity(enrich(unified))})
    register_panels(spark)


@_register
def sql_panel_daily(spark, sf_dir):
    _published(spark, sf_dir)
    start, end = (f"TIMESTAMP '{moment:%Y-%m-%d %H:%M:%S}'" for moment in RANGE)
    return spark.sql(f"SELECT * FROM panel_daily('total_insertions', {start}, {end}, 7)")


@_register
def sql_branch_panel(spark, sf_dir):
    _published(spark, sf_dir)
    start, end = (f"TIMESTAMP '{moment:%Y-%m-%d %H:%M:%S}'" for moment in RANGE)
    return spark.sql(f"SELECT * FROM panel_branches({start}, {end})")


@_register
def published_views(spark, sf_dir):
    """Session views over catalog tables of the branches, asked in SQL."""
    with _catalog(spark, tables_of(spark, sf_dir)) as config:
        publish_from_catalog(spark, config)
        asked = spark.sql(
            """SELECT d.branch, count(*) AS days, sum(d.commit_count) AS commit_count,
                 max(b.commit_count) AS branch_count, max(b.author_count) AS author_count
               FROM daily_activity d JOIN branch_summary b ON b.branch = d.branch GROUP BY d.branch"""
        )
        return stage(asked, "published")  # the tables go away


@contextlib.contextmanager
def _schema(spark):
    """A schema of its own, dropped afterwards with its tables."""
    schema = f"branches_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE SCHEMA {schema} LOCATION '{staging_path(spark, 'schema')}'")
    try:
        yield schema
    finally:
        spark.sql(f"DROP SCHEMA {schema} CASCADE")


@contextlib.contextmanager
def _catalog(spark, tables: dict[str, DataFrame]):
    """The branches as tables of a schema of their own, dropped afterwards."""
    with _schema(spark) as schema:
        for branch, table in tables.items():
            table.write.saveAsTable(f"{schema}.{relation_of(branch)}")
        yield replace(CONFIG, branches=None, schema=f"spark_catalog.{schema}")


def _import(format: str, write: Callable[[DataFrame, str], None]) -> None:
    def run(spark, sf_dir):
        paths = {b: staging_path(spark, f"import-{format}") for b in CONFIG.branches}
        for branch, table in tables_of(spark, sf_dir).items():
            write(table, paths[branch])
        return as_text(reconcile(read_branches(spark, paths, CONFIG, format), CONFIG), *CHURN_COLUMNS)

    _register(run, f"import_{format}")


_import("csv", lambda table, path: table.write.options(**CSV_OPTIONS).csv(path))
_import("json", lambda table, path: table.write.options(**JSON_OPTIONS).json(path))


@_register
def import_log_files(spark, sf_dir):
    paths = {b: staging_path(spark, "import-log") for b in CONFIG.branches}
    for branch, table in tables_of(spark, sf_dir).items():
        block = F.when(F.col("deltas").isNotNull(), F.concat_ws("\t", "insertions", "deletions", F.lit("one file"))).alias("numstat_block")
        records = log_dump.render_log_records(table.select("*", block))
        records.write.option("lineSep", log_dump.RECORD_SEPARATOR).text(paths[branch])
    # a dump counts files by its lines: one of them here, however many the commit had
    unified = reconcile(read_branches(spark, paths, CONFIG, "log"), CONFIG)
    return as_text(unified.drop("deltas", "changed_files"), "insertions", "deletions")


@_register
def import_catalog(spark, sf_dir):
    with _catalog(spark, tables_of(spark, sf_dir)) as config:
        tables, found = load_catalog_branches(spark, config)
        # suffixes name the branches found; the tables go away, so the rows are staged
        unified = stage(reconcile(tables, found), "imported")
    return as_text(unified, *CHURN_COLUMNS)


@_register
def column_coverage(spark, sf_dir):
    return quality.column_coverage(log_of(spark, sf_dir))


@_register
def quality_gate(spark, sf_dir):
    commits = commits_of(spark, sf_dir)
    activity = stage(rollups.activity(commits), "activity")
    return quality.gate(spark, document_sections(relations(spark, commits, commit_trailers(commits), activity)))


@_register
def quality_gate_observed(spark, sf_dir):
    """The gate over written datasets; what was counted while writing is compared with what is read back."""
    sections = document_sections(_build_tables(spark, sf_dir))
    shown = {panel.datasets[0] for panel in quality.PANELS}
    back, counts = {}, {}
    for name in shown:
        df, path = sections[name], staging_path(spark, f"observed-{name}")
        counts[name] = write_dataset(df, path, doc.section_keys(df, name), CONFIG.root_branch)
        back[name] = read_dataset(spark, path, df.schema)
    return quality.gate(spark, back, written=counts)


@_register
def live_panel_check(spark, sf_dir):
    commits = commits_of(spark, sf_dir)
    activity = stage(rollups.activity(commits), "activity")
    report = quality.live_check(panels.live_panels(commits, activity, *RANGE))
    return report.select("check", "target", "status", F.regexp_extract("detail", r"^rows=(\d+)", 1).cast("long").alias("rows"))


@_register
def stream_commits(spark, sf_dir):
    arrivals = union_branches(tables_of(spark, sf_dir), CONFIG.branches)
    landing, stored = staging_path(spark, "arrivals"), staging_path(spark, "streamed")
    arrivals.select(*ARRIVAL_SCHEMA.fieldNames()).write.parquet(landing)
    store_commits(read_commit_stream(spark, landing), stored, staging_path(spark, "stream-log")).awaitTermination()
    enriched = spark.read.schema(enrich(arrivals).schema).parquet(stored)
    return rollups.branch_summary(reconcile_table(enriched, CONFIG))


# Commits arrive in runs, in the order of their dates but for a shift by the id.
FIRST_DAY, RUN_DAYS, RUN_SHIFTS = "2024-01-01", 4, 3
LATENESS = "5 days"


LANDED_ROWS = 250_000  # of a run in one file


def _land(arrivals: DataFrame, run: Column, folder: str) -> int:
    """The runs in turn, each in the same number of files, which is returned: a batch of so many files is a run.

    The largest run sets that number; one with fewer rows than files is filled up with empty files.
    """
    spark, schema = arrivals.sparkSession, T.StructType([*ARRIVAL_SCHEMA.fields, T.StructField("run", T.IntegerType())])
    staged = staging_path(spark, "arrivals")
    runs = arrivals.select(*ARRIVAL_SCHEMA.fieldNames(), run.alias("run"))
    runs.hint("rebalance", "run").write.partitionBy("run").parquet(staged)
    numbered = spark.read.schema(schema).parquet(staged)
    sizes = dict(numbered.groupBy("run").count().collect())
    files = max(1, -(-max(sizes.values(), default=0) // LANDED_ROWS))
    nothing = spark.createDataFrame([], ARRIVAL_SCHEMA)
    for nth, number in enumerate(sorted(sizes), start=1):
        numbered.where(F.col("run") == number).drop("run").repartition(files).write.mode("append").parquet(folder)
        landed = len(spark.read.schema(ARRIVAL_SCHEMA).parquet(folder).inputFiles())
        for _ in range(landed, files * nth):
            nothing.write.mode("append").parquet(folder)
    return files


def _shift() -> Column:
    return F.conv(F.substring("commit_id", 1, 2), 16, 10).cast("int") % RUN_SHIFTS


@_register
def stream_daily_windows(spark, sf_dir):
    """Daily windows behind a watermark, and what came too late for them."""
    arrivals = union_branches(tables_of(spark, sf_dir), CONFIG.branches)
    day = F.datediff(F.to_date("author_date"), F.lit(FIRST_DAY).cast("date"))
    landing, windows, sums = (staging_path(spark, name) for name in ("arrivals", "windows", "daily-sums"))
    files = _land(arrivals, F.coalesce(F.floor(day / RUN_DAYS), F.lit(0)).cast("int") + _shift(), landing)
    commits = lambda: enrich(read_commit_stream(spark, landing, files))
    store_daily_windows(commits(), windows, staging_path(spark, "windows-log"), LATENESS).awaitTermination()
    store_daily_sums(commits(), sums, staging_path(spark, "sums-log")).awaitTermination()
    return daily_with_late(spark, windows, sums)


@_register
def stream_reconciled(spark, sf_dir):
    """The unified relation after three batches that mix the branches."""
    landing, path = staging_path(spark, "arrivals"), staging_path(spark, "reconciled")
    files = _land(union_branches(tables_of(spark, sf_dir), CONFIG.branches), _shift_by_branch(), landing)
    stream = read_commit_stream(spark, landing, files)
    store_reconciled(stream, path, staging_path(spark, "reconciled-log"), CONFIG).awaitTermination()
    return as_text(read_reconciled(spark, path, CONFIG), *CHURN_COLUMNS)


def _shift_by_branch() -> Column:
    """Copies of a commit on different branches arrive in different batches."""
    return (_shift() + F.length("branch")) % RUN_SHIFTS
