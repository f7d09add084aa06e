"""Streams with state and retractions, sketches, repositories, buckets and arrays."""

from __future__ import annotations

import datetime as dt
import json
import pathlib
import random

import pytest
from conftest import at
from pyspark.sql import functions as F

from branchlore.config import BuildConfig
from branchlore.functions.sql import register_panels
from branchlore.operators import rollups
from branchlore.operators.enrich import enrich
from branchlore.operators.reconcile import reconcile, reconcile_bucketed, reconcile_table
from branchlore.operators.repositories import reconcile_repositories
from branchlore.schema import COMMIT_SCHEMA
from branchlore.sinks.export import write_array
from branchlore.sinks.tables import publish_views, save_bucketed
from branchlore.streaming import reconciled, windows
from branchlore.streaming.commits import ARRIVAL_SCHEMA, read_commit_stream, read_daily_sums, store_daily_sums

CONFIG = BuildConfig(root_branch="main", branches=("main", "b1", "b2"))


@pytest.fixture
def arrive(spark):
    def make(*rows):
        """(branch, id, day) to full rows."""
        names = ARRIVAL_SCHEMA.fieldNames()
        full = [{"branch": b, "commit_id": i, "author_date": at(d) if d else None, "message": f"{b} {i}", "insertions": 1} for b, i, d in rows]
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], ARRIVAL_SCHEMA)

    return make


def ids(df) -> list:
    return sorted((r.branch, r.commit_id or "") for r in df.collect())


def test_a_commit_that_reaches_the_root_later_leaves_the_other_branch(arrive, spark, tmp_path):
    path = str(tmp_path)
    reconciled.merge_batch(arrive(("b1", "x", 1), ("b2", "x", 1), ("b1", "y", 1), ("b1", None, 1), ("other", "z", 1)), 0, path, CONFIG)
    assert ids(reconciled.read_reconciled(spark, path, CONFIG)) == [("b1", ""), ("b1", "x"), ("b1", "y"), ("b2", "x")]
    reconciled.merge_batch(arrive(("main", "x", 1), ("main", None, 1), ("b2", "x", 2), ("b2", "w", 2)), 1, path, CONFIG)
    want = [("b1", ""), ("b1", "y"), ("b2", "w"), ("main", ""), ("main", "x")]
    assert ids(reconciled.read_reconciled(spark, path, CONFIG)) == want
    reconciled.merge_batch(arrive(("b1", "x", 3)), 2, path, CONFIG)
    assert ids(reconciled.read_reconciled(spark, path, CONFIG)) == want


def test_any_order_of_batches_gives_the_batch_result(arrive, spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice(["main", "b1", "b2"]), rng.choice([None, *"abcdefghijklmnop"]), 1) for _ in range(150)]
    want = ids(reconcile_table(arrive(*rows), CONFIG))
    for seed in range(2):
        rng.shuffle(rows)
        path = str(tmp_path / str(seed))
        for number in range(4):
            batch = arrive(*rows[number::4])
            reconciled.merge_batch(batch, number, path, CONFIG)
            if number % 2:
                reconciled.merge_batch(batch, number, path, CONFIG)  # run again after a failure
        assert ids(reconciled.read_reconciled(spark, path, CONFIG)) == want
    folder = str(tmp_path / "compacted")
    reconciled.compact_reconciled(spark, path, folder, CONFIG)
    assert ids(reconciled.read_reconciled(spark, folder, CONFIG)) == want
    reconciled.merge_batch(arrive(("main", "new", 1), ("b1", "a", 1)), 4, folder, CONFIG)
    assert ids(reconciled.read_reconciled(spark, folder, CONFIG)) == ids(reconcile_table(arrive(*rows, ("main", "new", 1), ("b1", "a", 1)), CONFIG))


def test_merging_reads_no_message_of_stored_rows(arrive, spark, tmp_path):
    reconciled.merge_batch(arrive(("b1", "x", 1)), 0, str(tmp_path), CONFIG)
    stored = reconciled._before(spark, str(tmp_path), reconciled.ROWS, ARRIVAL_SCHEMA, 1).where("branch <> 'main'").select("commit_id")
    scan = [line for line in stored._jdf.queryExecution().executedPlan().toString().splitlines() if "ReadSchema" in line]
    assert scan and all(line.split("ReadSchema: ")[1] == "struct<branch:string,commit_id:string>" for line in scan)


def run_windows(spark, batches, folder, lateness):
    landing = str(folder / "landing")
    paths = [str(folder / n) for n in ("windows", "wlog", "sums", "slog")]
    for batch in batches:  # one stream run a batch: also a restart from the checkpoint each time
        batch.coalesce(1).write.mode("append").parquet(landing)
        stream = lambda: enrich(read_commit_stream(spark, landing))
        windows.store_daily_windows(stream(), paths[0], paths[1], lateness).awaitTermination()
        store_daily_sums(stream(), paths[2], paths[3]).awaitTermination()
    return paths


def test_late_commits_are_counted_apart(arrive, spark, tmp_path):
    batches = [
        arrive(("main", "a", 1), ("main", "b", 20), ("b1", "c", 20), ("main", "n", None)),
        arrive(("main", "d", 20), ("main", "e", 18)),
        arrive(("main", "f", 1), ("main", "g", 19), ("b1", "h", 2)),
    ]
    path, _, sums, _ = run_windows(spark, batches, tmp_path, "3 days")
    found = {(r.branch, r.commit_day and r.commit_day.day): (r.commit_count, r.late_count) for r in windows.daily_with_late(spark, path, sums).collect()}
    assert found == {("main", 1): (1, 1), ("main", 18): (1, 0), ("main", 19): (1, 0), ("main", 20): (2, 0), ("b1", 20): (1, 0), ("b1", 2): (0, 1), ("main", None): (0, 1)}
    compacted = str(tmp_path / "compacted")
    windows.compact_daily_windows(spark, path, compacted)
    assert windows.read_daily_windows(spark, compacted).exceptAll(windows.read_daily_windows(spark, path)).isEmpty()


def test_nothing_is_late_within_the_watermark(spark, tables, config, tmp_path):
    from branchlore.operators.reconcile import union_branches

    arrivals = union_branches(tables, config.branches).select(*ARRIVAL_SCHEMA.fieldNames())
    path, _, sums, _ = run_windows(spark, [arrivals.where(F.crc32("commit_id") % 3 == k) for k in range(3)], tmp_path, "60 days")
    batch = rollups.daily_activity(enrich(arrivals)).where("commit_day IS NOT NULL")
    streamed = windows.read_daily_windows(spark, path)
    assert streamed.exceptAll(batch).isEmpty() and streamed.count() == batch.count()
    late = windows.daily_with_late(spark, path, sums).where("late_count > 0").collect()
    assert late and all(r.commit_day is None for r in late)
    assert read_daily_sums(spark, sums).count() > batch.count()


def test_sketches_merge_over_days_and_branches(spark):
    rows = [(f"b{i % 3}", f"u{i % 4000}@x" if i % 11 else None, dt.datetime(2024, 1, 1 + i % 20)) for i in range(30_000)]
    commits = spark.createDataFrame(rows, "branch string, author_email string, author_date timestamp")
    sketches = rollups.author_sketches(commits)
    for by, chosen in (([], "true"), (["branch"], "true"), (["branch"], "commit_day < '2024-01-05'")):
        approx = rollups.branch_authors_approx(sketches.where(chosen), *by).collect()
        scope = commits.withColumn("commit_day", F.to_date("author_date")).where(chosen).groupBy(*by).agg(F.count_distinct("author_email").alias("n"), F.count("*").alias("c"))
        exact = {tuple(r[b] for b in by): (r.n, r.c) for r in scope.collect()}
        for r in approx:
            n, c = exact[tuple(r[b] for b in by)]
            assert r.commit_count == c and abs(r.approx_author_count - n) <= 0.03 * n


def test_repositories_share_ids_but_not_roots(spark):
    rows = [("r1", "main", "x"), ("r1", "dev", "x"), ("r1", "dev", "y"), ("r2", "dev", "x"), ("r2", "main", "x"), ("r2", "main", "y"),
            ("r2", "main", None), ("r3", "main", "x"), (None, "main", "x")]
    commits = spark.createDataFrame(rows, "repository string, branch string, commit_id string")
    found = reconcile_repositories(commits, {"r1": "main", "r2": "dev"}).collect()
    assert sorted((r.repository, r.branch, r.commit_id or "") for r in found) == [
        ("r1", "dev", "y"), ("r1", "main", "x"), ("r2", "dev", "x"), ("r2", "main", ""), ("r2", "main", "y")]


def test_bucketed_tables_meet_without_a_shuffle(spark, tables, config):
    spark.sql("CREATE SCHEMA IF NOT EXISTS bucketed")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = {b: save_bucketed(t, f"bucketed.t{i}", 4) for i, (b, t) in enumerate(tables.items())}
        unified = reconcile_bucketed(stored, config)
        plan = unified._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "LeftAnti" in plan
        want = reconcile(tables, config)
        assert unified.exceptAll(want).isEmpty() and unified.count() == want.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.sql("DROP SCHEMA bucketed CASCADE")


@pytest.mark.parametrize("n", [0, 1, 700])
def test_array_is_one_json_value_in_order(spark, tmp_path, n):
    df = spark.range(n).selectExpr("CASE WHEN id % 2 = 0 THEN 'main' ELSE 'b' END AS branch", "concat('\\n\"', id) AS name", "CAST(NULL AS STRING) AS nothing")
    for one_file in (True, False):
        path = str(tmp_path / f"{one_file}")
        write_array(df.repartition(5), path, ("branch", "name"), "main", one_file)
        parts = sorted(pathlib.Path(path).glob("part-*"))
        assert len(parts) == 1 or not one_file
        found = json.loads("".join(p.read_text() for p in parts))
        assert found == [r.asDict() for r in df.orderBy("branch", "name").collect()]


def test_panel_functions_reject_unknown_measures(spark, commits):
    publish_views(spark, {"commits": commits, "git_log_all": commits.select("branch", *COMMIT_SCHEMA.fieldNames()), "daily_activity": rollups.daily_activity(commits)})
    register_panels(spark)
    assert spark.sql("SELECT sum(value) FROM panel_daily('commit_count', NULL, NULL)").first()[0] == commits.where("author_date IS NOT NULL").count()
    assert spark.sql("SELECT * FROM git_log_of('REL_17_STABLE')").count() == commits.where("branch = 'REL_17_STABLE'").count()
    with pytest.raises(Exception, match="no measure"):
        spark.sql("SELECT * FROM panel_daily('stars', NULL, NULL, 7)").collect()
