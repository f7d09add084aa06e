"""Physical plans that matter at scale."""

from __future__ import annotations

import datetime as dt
import re

import pytest
from conftest import SF

from branchlore.config import Filters
from branchlore.operators import explore, panels, rollups
from branchlore.operators.enrich import commit_trailers, enrich
from branchlore.operators.reconcile import newest_commits, reconcile
from branchlore.plans import registry
from branchlore.sinks.tables import write_facts
from branchlore.sources.branch_tables import read_commits


@pytest.fixture(scope="module")
def stored_tables(spark, tables, tmp_path_factory):
    folder = tmp_path_factory.mktemp("branches")
    for branch, table in tables.items():
        table.write.parquet(str(folder / branch))
    return {branch: read_commits(spark, str(folder / branch)) for branch in tables}


@pytest.fixture(scope="module")
def stored_commits(stored_tables, config, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("facts") / "commits")
    return write_facts(enrich(reconcile(stored_tables, config)), path, "author_date")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def read_schemas(df) -> list[str]:
    return re.findall(r"ReadSchema: struct<(.*)>", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("name", registry.queries())
def test_no_python_and_no_cartesian_product(spark, name):
    text = plan(registry.queries()[name](spark, SF))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text


def test_one_anti_join_per_branch_on_ids(stored_tables, config, spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        unified = reconcile(stored_tables, config)
        text = plan(unified)
        assert text.count("LeftAnti") == 2
        # ids of the root are read alone, and messages only where they are asked for
        daily = plan(rollups.daily_activity(enrich(unified)))
        assert "message" not in daily
        assert any(s == "commit_id:string" for s in read_schemas(unified))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_branch_filter_drops_the_other_arms(stored_tables, config):
    text = plan(reconcile(stored_tables, config).where("branch = 'master'"))
    assert "LeftAnti" not in text and text.count("FileScan") == 1


def test_range_filters_reach_the_scan(stored_commits):
    start, end = dt.datetime(2024, 1, 10, 6), dt.datetime(2024, 1, 20)
    for df in (
        panels.daily_panel(rollups.daily_activity(stored_commits), "commit_count", start, end),
        panels.branch_panel(stored_commits, start, end),
        panels.recent_panel(stored_commits, start, end),
        rollups.daily_activity(
            explore.in_scope(stored_commits, Filters(branches=("master",), start="2024-01-10", end="2024-01-12"))
        ),
    ):
        pushed = df._jdf.queryExecution().executedPlan().toString()
        scans = [line for line in pushed.splitlines() if "FileScan" in line]
        assert scans
        for scan in scans:
            assert re.search(r"PushedFilters: \[IsNotNull\(author_date\), GreaterThanOrEqual\(author_date,2024-01-1", scan)
        assert "message" not in pushed


def test_the_commit_limit_filters_at_the_scan(stored_tables):
    kept = newest_commits(stored_tables, 100)["master"]
    text = plan(kept)
    assert re.search(r"PushedFilters: \[Or\(.*GreaterThan.*commit_date", text)
    assert "Exchange" not in text and "Sort" not in text and kept.count() == 100


def test_branch_filter_prunes_partitions(stored_commits):
    text = plan(explore.in_scope(stored_commits, Filters(branches=("master",))))
    assert re.search(r"PartitionFilters: \[.*branch.*master", text)


def test_top_rows_are_kept_per_task_before_parsing(stored_tables, stored_commits, config):
    text = plan(panels.recent_commits(reconcile(stored_tables, config)))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text
    assert text.index("regexp_extract_all") < text.index("TakeOrderedAndProject")
    for df in (panels.recent_panel(stored_commits), explore.recent(stored_commits), panels.authors_panel(stored_commits)):
        assert "TakeOrderedAndProject" in plan(df)


def test_enrichment_is_one_generated_stage(stored_tables):
    log = stored_tables["master"].selectExpr("'master' AS branch", "*")
    text = plan(enrich(log))
    assert "Exchange" not in text
    # every projection is inside generated code
    assert len(re.findall(r"\*\(\d+\) Project", text)) == text.count("Project [") > 0


def test_activity_is_hashed_and_never_sorted(stored_commits):
    for df in (rollups.activity(stored_commits), explore.author_summaries(stored_commits)):
        text = plan(df)
        assert "SortAggregate" not in text and "ObjectHashAggregate" not in text and "Sort [" not in text
        assert text.count("HashAggregate") == 2


def test_dense_series_sums_days_and_branches_first(stored_commits, config):
    filters = Filters(branches=config.preset("all"))
    text = plan(explore.dense_series(stored_commits, filters, config))
    assert "BroadcastNestedLoopJoin" not in text and "Join" not in text
    assert text.count("partial_sum(1") == 1  # one sum per commit, however many branches


def test_distinct_counts_spread_hot_values(stored_commits):
    for df in (
        rollups.trailer_summary(commit_trailers(stored_commits)),
        rollups.trailer_people_summary(commit_trailers(stored_commits)),
        rollups.branch_summary(stored_commits),
    ):
        text = plan(df)
        # first exchange on the group and the counted value together, then on the group
        assert text.count("Exchange hashpartitioning") == 2
        assert "SortAggregate" not in text and "ObjectHashAggregate" not in text
        keys = re.findall(r"Exchange hashpartitioning\((.*?)\), ENSURE", text)
        counted = "author_email" if "author_email" in text else "commit_id"
        assert counted not in keys[0] and counted in keys[1]


def test_shuffles_are_sized_by_what_is_shuffled(spark):
    from branchlore.session import size_shuffles

    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    try:
        assert size_shuffles(spark, 100 * 2**40) == 40_960
        assert spark.conf.get(key) == "40960"
        assert size_shuffles(spark, 2**40, shuffled=1.0) == 8192
        assert size_shuffles(spark, 1) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.unset(key)


def test_stored_facts_have_few_files_per_branch(spark, stored_commits, tmp_path):
    spread = stored_commits.select("branch", "author_date", "commit_id").repartition(16)
    write_facts(spread, str(tmp_path / "facts"), "author_date")
    files = [len(list(p.glob("*.parquet"))) for p in (tmp_path / "facts").glob("branch=*")]
    assert len(files) == 3 and max(files) <= 2
