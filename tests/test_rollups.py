from __future__ import annotations

import datetime as dt

from conftest import at
from pyspark.sql import functions as F

from branchlore.functions import times
from branchlore.operators import panels, rollups
from branchlore.operators.enrich import churn_defaults


def total(df, column):
    return df.agg(F.sum(column)).first()[0]


def test_counts_add_up(commits, trailers):
    everything = commits.count()
    daily, branch = rollups.daily_activity(commits), rollups.branch_summary(commits)
    assert total(daily, "commit_count") == total(branch, "commit_count") == everything
    assert total(rollups.authors(commits), "commit_count") == everything
    for name in rollups.TOTALS:
        assert total(daily, name) == total(branch, name) == total(commits, name.removeprefix("total_"))
    summary = rollups.trailer_summary(trailers)
    assert total(summary, "entry_count") == trailers.count()
    assert summary.where("entry_count < commit_count").isEmpty()
    people = rollups.trailer_people_summary(trailers)
    assert total(people, "mention_count") == trailers.where("trailer_category = 'person'").count()


def test_no_other_branch_has_a_root_commit(commits):
    root = commits.where("branch = 'master'").select("commit_id")
    assert commits.where("branch <> 'master'").join(root, "commit_id", "left_semi").isEmpty()


def test_rollups_agree_from_commits_and_activity(commits):
    activity = rollups.activity(commits)
    assert activity.count() < commits.count()
    for rollup in (
        rollups.authors,
        rollups.author_activity,
        rollups.daily_activity,
        rollups.branch_summary,
        rollups.branch_names,
        rollups.date_bounds,
    ):
        direct, rolled = rollup(commits), rollup(activity)
        assert direct.schema == rolled.schema
        assert direct.exceptAll(rolled).isEmpty() and rolled.exceptAll(direct).isEmpty()


def test_unknown_churn_is_zero(make_commits):
    row = churn_defaults(make_commits({"commit_id": "a", "insertions": 3})).first()
    assert (row["deltas"], row["insertions"], row["deletions"], row["changed_files"]) == (0, 3, 0, 0)


def test_sums_beyond_long_fail(spark, make_commits):
    big = make_commits(*[{"commit_id": c, "insertions": 2**62} for c in "abc"])
    facts = big.select(F.lit("master").alias("branch"), "*")
    try:
        rollups.branch_summary(churn_defaults(facts)).collect()
    except Exception as error:
        assert "overflow" in str(error).lower()
    else:
        raise AssertionError("the sum wrapped")


def test_epoch_millis_rounds_half_away_from_zero(spark):
    micros = {1500: 2, 1499: 1, -1500: -2, -1499: -1, -400: 0, 59_999_600: 60_000, 0: 0}
    df = spark.createDataFrame([(m,) for m in micros], "m long").withColumn("t", F.timestamp_micros("m"))
    assert {r[0]: r[1] for r in df.select("m", times.epoch_millis("t")).collect()} == micros


def test_texts_of_times_and_numbers(spark):
    row = spark.range(1).select(
        times.day_to_iso(F.to_date(F.lit("2024-02-29"))),
        times.instant_to_iso(F.lit("2024-02-29 13:05:06.7").cast("timestamp")),
        times.display_instant(F.lit("2024-02-09 13:05:06").cast("timestamp")),
        times.display_instant(F.lit(None).cast("timestamp")),
        times.display_number(F.lit(1234567)),
        times.display_number(F.lit(None).cast("long")),
        times.iso_day(F.lit("2024-02-29T13:05:06Z")),
    ).first()
    assert tuple(row) == (
        "2024-02-29T00:00:00Z",
        "2024-02-29T13:05:06Z",
        "Feb 9, 2024, 1:05 PM",
        "n/a",
        "1,234,567",
        "0",
        "2024-02-29",
    )


def test_recent_commits_put_unknown_dates_first(make_commits):
    log = make_commits(
        {"commit_id": "b", "author_date": at(3), "message": "Bug: 1"},
        {"commit_id": "a", "author_date": at(3)},
        {"commit_id": "c", "author_date": at(4)},
        {"commit_id": "z"},
    ).select(F.lit("master").alias("branch"), "*")
    rows = panels.recent_commits(log, 3).collect()
    assert [r["commit_id"] for r in rows] == ["z", "c", "a"]
    assert panels.recent_commits(log, 4).collect()[3]["bug"] == ["1"]


def test_daily_panel_range_tests_midnight(commits):
    from datetime import datetime

    daily = rollups.daily_activity(commits)

    def days(start, end):
        panel = panels.daily_panel(daily, "commit_count", start, end)
        return [r["time"].day for r in panel.where("metric = 'master'").collect()]

    assert days(datetime(2024, 1, 3, 1), datetime(2024, 1, 5, 0)) == [4, 5]
    assert days(datetime(2024, 1, 3), datetime(2024, 1, 5, 23)) == [3, 4, 5]
    weeks = panels.daily_panel(daily, "commit_count", interval="7 days")
    assert total(weeks, "value") == commits.where("author_date IS NOT NULL").count()


def test_panels_take_an_open_range(commits):
    assert total(panels.branch_panel(commits), "commit_count") == commits.count()
    assert panels.authors_panel(commits, limit=None).count() == rollups.author_activity(commits).count()
    assert panels.authors_panel(commits, limit=7).count() == 7


def test_zoned_bounds_mean_the_instant(commits):
    daily = rollups.daily_activity(commits)
    west = dt.timezone(dt.timedelta(hours=-5))
    zoned = panels.daily_panel(daily, "commit_count", dt.datetime(2024, 1, 10, 23, 30, tzinfo=west), dt.datetime(2024, 1, 14, 22, tzinfo=west))
    plain = panels.daily_panel(daily, "commit_count", dt.datetime(2024, 1, 11, 4, 30), dt.datetime(2024, 1, 15, 3))
    assert zoned.collect() == plain.collect()
    assert plain.first()["time"].day == 12 and max(r["time"].day for r in plain.collect()) == 15


def test_panels_from_activity_and_cut_days_equal_those_from_commits(commits):
    activity = rollups.activity(commits)
    for start, end in (
        (dt.datetime(2024, 1, 10, 6), dt.datetime(2024, 1, 20, 18)),
        (dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 11)),
        (dt.datetime(2024, 1, 10, 6), dt.datetime(2024, 1, 10, 18)),
        (dt.datetime(2024, 1, 12), dt.datetime(2024, 1, 10)),
    ):
        live = panels.live_panels(commits, activity, start, end)
        assert live["Branch Summary"].collect() == panels.branch_panel(commits, start, end).collect()
        assert live["Top Authors"].collect() == panels.authors_panel(commits, start, end).collect()
