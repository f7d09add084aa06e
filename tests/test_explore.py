from __future__ import annotations

import datetime as dt

import pytest
from conftest import at
from pyspark.sql import functions as F

from branchlore.config import BuildConfig, Filters, last_days
from branchlore.operators import explore, rollups
from branchlore.operators.enrich import churn_defaults

CONFIG = BuildConfig(branches="master,A,B")


@pytest.fixture
def log(make_commits):
    def of(branch, *rows):
        return churn_defaults(make_commits(*rows)).select(F.lit(branch).alias("branch"), "*")

    return of(
        "master",
        {"commit_id": "1", "author_name": "Ann", "author_email": "ann@x", "author_date": at(1), "insertions": 5},
        {"commit_id": "2", "author_name": "Ann", "author_email": "ann@x", "author_date": at(3), "insertions": 2},
        {"commit_id": "3", "author_name": "Bob", "author_email": None, "author_date": at(3)},
        {"commit_id": "4", "author_name": "Bob", "author_email": None},
    ).unionByName(
        of(
            "A",
            {"commit_id": "5", "author_name": "Ann", "author_email": "ann@y", "author_date": at(4), "insertions": 9},
            {"commit_id": "6", "author_name": "Cid", "author_email": "c@x", "author_date": at(3)},
            {"commit_id": "7", "author_name": "Dee", "author_email": "d@x", "author_date": at(3)},
        )
    )


def ids(df):
    return sorted(r["commit_id"] for r in df.collect())


def pick(log, **filters):
    return ids(explore.apply_filters(log, Filters(**filters).normalized(CONFIG)))


def test_filters(log):
    assert pick(log, branches=("master", "A")) == list("1234567")
    assert pick(log) == list("1234")  # no branch chosen: the root
    assert pick(log, branches=("A",), start="2024-01-04") == ["5"]
    assert pick(log, branches=("master", "A"), end="2024-01-02") == ["1"]
    assert pick(log, branches=("master", "A"), start="2024-01-03", end="2024-01-03") == list("2367")
    assert pick(log, branches=("master", "A"), authors=("ann@x", "d@x")) == list("127")
    assert pick(log, branches=("B",)) == []


def test_crossed_bounds_follow_the_moved_one():
    crossed = Filters(branches=("A",), start="2024-01-09", end="2024-01-02")
    moved_start, moved_end = crossed.normalized(CONFIG), crossed.normalized(CONFIG, moved="end")
    assert moved_start.start == moved_start.end == dt.date(2024, 1, 9)
    assert moved_end.start == moved_end.end == dt.date(2024, 1, 2)


def test_unknown_metric():
    with pytest.raises(ValueError, match="metric"):
        Filters(metric="stars")


def test_author_sync_drops_those_out_of_scope(log):
    chosen = Filters(branches=("A",), authors=("ann@x", "c@x"), end="2024-01-03")
    assert explore.sync_authors(log, chosen).authors == ("c@x",)
    assert explore.sync_authors(log, Filters(branches=("B",), authors=("c@x",))).authors == ()
    searched = Filters(branches=("A",), authors=("c@x", "d@x"), search="DEE")
    assert explore.sync_authors(log, searched).authors == ("d@x",)


def test_visible_authors(log):
    chosen = explore.select_visible_authors(log, Filters(branches=("master", "A")))
    assert chosen.authors == ("ann@x", "ann@y", "c@x", "d@x")


def test_author_order_and_ties(log):
    chosen = explore.apply_filters(log, Filters(branches=("master", "A")))
    summaries = explore.author_summaries(chosen)
    top = explore.top_authors(summaries, 10, chosen).collect()
    # two commits each: Bob's known latest ties with Ann's, and Ann@x and Bob appear in
    # the order (branch, newest first with unknown dates ahead, id)
    assert [(r["author_name"], r["author_email"]) for r in top] == [
        ("Bob", None),
        ("Ann", "ann@x"),
        ("Ann", "ann@y"),
        ("Cid", "c@x"),
        ("Dee", "d@x"),
    ]
    assert top[1]["branches"] == ["master"] and top[1]["total_insertions"] == 7


def test_ties_at_the_cut_are_broken_by_the_commits(log):
    chosen = explore.apply_filters(log, Filters(branches=("master", "A")))
    for facts in (chosen, rollups.activity(chosen)):
        everyone = explore.top_authors(explore.author_summaries(facts), 10, chosen).collect()
        for count in range(1, 6):
            assert explore.top_authors(explore.author_summaries(facts), count, chosen).collect() == everyone[:count]


def test_search(log):
    scope = explore.scope_authors(log, Filters(branches=("master", "A"), search="  ANN@ "))
    assert sorted(r["author_email"] for r in scope.collect()) == ["ann@x", "ann@y"]
    assert explore.scope_authors(log, Filters(branches=("master",), search=" ")).count() == 2


def test_branch_summaries_count_an_unknown_email_once(log):
    rows = explore.branch_summaries(log, CONFIG).orderBy("position").collect()
    assert [(r["branch"], r["commit_count"], r["author_count"]) for r in rows] == [("master", 4, 2), ("A", 3, 3)]
    batch = {r["branch"]: r["author_count"] for r in rollups.branch_summary(log).collect()}
    assert batch == {"master": 1, "A": 3}


def test_dense_series_fills_days_active_on_any_selected_branch(log):
    filters = Filters(branches=("master", "A", "B"), metric="total_insertions")
    rows = explore.dense_series(explore.apply_filters(log, filters), filters, CONFIG).collect()
    got = {(r["commit_day"].day, r["branch"]): r["value"] for r in rows}
    assert got == {
        (1, "master"): 5, (1, "A"): 0, (1, "B"): 0,
        (3, "master"): 2, (3, "A"): 0, (3, "B"): 0,
        (4, "master"): 0, (4, "A"): 9, (4, "B"): 0,
    }


def test_dense_series_without_configured_branches(log):
    filters = Filters(branches=("gone",))
    series = explore.dense_series(explore.apply_filters(log, filters), filters, CONFIG)
    assert series.columns == ["commit_day", "branch", "value"] and series.isEmpty()


def test_dense_series_reads_only_selected_branches(log):
    filters = Filters(branches=("A",), metric="total_insertions")
    rows = explore.dense_series(log, filters, CONFIG).collect()
    assert {(r["commit_day"].day, r["branch"], r["value"]) for r in rows} == {(3, "A", 0), (4, "A", 9)}


def test_share_of_largest_has_floor_one(spark):
    df = spark.createDataFrame([(0,), (0,)], "v long")
    assert [r["relative_value"] for r in rollups.share_of_largest(df, "v").collect()] == [0.0, 0.0]
    df = spark.createDataFrame([(2,), (8,)], "v long")
    assert sorted(r["relative_value"] for r in rollups.share_of_largest(df, "v").collect()) == [0.25, 1.0]


def test_headline_counts_pairs(log):
    row = explore.headline(log, Filters(branches=("master", "A"))).first()
    assert row["commit_count"] == 7 and row["author_count"] == 5 and row["branch_count"] == 2
    assert row["latest_commit_at"] == at(4)


def test_no_match(log):
    panels = explore.explore(log, Filters(branches=("B",), authors=("ann@x",)), CONFIG)
    stats = panels.pop("stats").first()
    assert stats["commit_count"] == stats["author_count"] == stats["total_insertions"] == 0
    assert stats["latest_commit_at"] is None
    assert all(df.isEmpty() for df in panels.values())


def test_all_panels_from_commits_and_from_activity_agree(commits, config):
    filters = Filters(branches=config.preset("stable"), start="2024-01-03", authors=("u7@example.org", "nobody"))
    direct = explore.explore(commits, filters, config)
    rolled = explore.explore(commits, filters, config, facts=rollups.activity(commits))
    assert direct.keys() == rolled.keys()
    for name, df in direct.items():
        assert df.columns == rolled[name].columns
        assert [r.asDict() for r in df.collect()] == [r.asDict() for r in rolled[name].collect()] or name == "series"
        assert df.exceptAll(rolled[name]).isEmpty()


def test_recent_ties(log):
    rows = explore.recent(log.where("author_date IS NOT NULL"), 4).collect()
    assert [r["commit_id"] for r in rows] == ["5", "6", "7", "2"]


def test_relative_range():
    assert last_days(dt.datetime(2024, 3, 31), 90) == (dt.datetime(2024, 1, 1), dt.datetime(2024, 3, 31))
