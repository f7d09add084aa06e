from __future__ import annotations

import random

import pytest
from conftest import at
from pyspark.sql import Window
from pyspark.sql import functions as F

from branchlore.config import BuildConfig
from branchlore.operators import reconcile as rec
from branchlore.operators.membership import having_key, lacking_key
from branchlore.staging import release

CONFIG = BuildConfig(branches="master,A,B")
WAYS = {
    "join": rec.reconcile,
    "keys first": rec.reconcile_keys_first,
    "one table": lambda tables, config: rec.reconcile_table(rec.union_branches(tables, config.branches), config),
}


@pytest.fixture
def small(make_commits):
    return {
        "master": make_commits({"commit_id": "r"}, {"commit_id": "r"}, {"commit_id": "s"}, {"commit_id": None}),
        "A": make_commits({"commit_id": "r"}, {"commit_id": "x"}, {"commit_id": "x"}, {"commit_id": None}),
        "B": make_commits({"commit_id": "x"}, {"commit_id": "s"}, {"commit_id": "y"}),
    }


@pytest.mark.parametrize("way", WAYS)
def test_root_whole_others_without_root_commits(small, way):
    rows = WAYS[way](small, CONFIG).select("branch", "commit_id").collect()
    assert sorted(map(tuple, rows), key=str) == sorted(
        [
            ("master", "r"),
            ("master", "r"),
            ("master", "s"),
            ("master", None),
            ("A", "x"),
            ("A", "x"),
            ("A", None),
            ("B", "x"),
            ("B", "y"),
        ],
        key=str,
    )


@pytest.mark.parametrize("way", WAYS)
def test_reconciling_twice_changes_nothing(tables, config, way):
    first = WAYS[way](tables, config)
    second = rec.reconcile_table(first, config)
    assert first.count() == second.count() and first.exceptAll(second).isEmpty()


def test_keys_first_leaves_the_join_to_the_planner(spark, small):
    for threshold in ("10m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            rows = rec.reconcile_keys_first(small, CONFIG)
            assert rows.exceptAll(rec.reconcile(small, CONFIG)).isEmpty() and rows.count() == 9
            plan = rows._jdf.queryExecution().executedPlan().toString()
            assert ("BroadcastHashJoin" in plan) == (threshold == "10m")
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_staged_ids_can_be_released(spark, small):
    rows, path = rec.survivors_first(small, CONFIG)
    assert rows.count() == 9 and spark.read.parquet(path).count() > 0
    release(spark, path)
    assert spark.read.parquet(path).count() == 0
    assert rec.survivors_first(small, BuildConfig(branches="master"))[1] is None


def test_root_alone_and_missing_branch(small):
    assert rec.reconcile(small, BuildConfig(branches="master")).count() == 4
    with pytest.raises(ValueError, match="no commit table for: C"):
        rec.reconcile(small, BuildConfig(branches="master,C"))


def test_membership_of_unknown_keys(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "k string, n int")
    keys = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert sorted(r["n"] for r in having_key(rows, keys, "k").collect()) == [1, 2]
    assert sorted(r["n"] for r in lacking_key(rows, keys, "k").collect()) == [3, 4]


def test_no_diff(small):
    assert rec.drop_churn(small["A"]).where("coalesce(deltas, insertions, deletions, changed_files) IS NOT NULL").isEmpty()


def newest_by_window(table, limit):
    order = Window.orderBy(F.desc_nulls_first("commit_date"), F.asc_nulls_last("commit_id"))
    return table.withColumn("r", F.row_number().over(order)).where(F.col("r") <= limit).drop("r")


@pytest.fixture(scope="module")
def tied(spark):
    """Many equal dates, unknown dates, unknown ids and copies."""
    from branchlore.schema import COMMIT_SCHEMA

    rng = random.Random(3)
    names = COMMIT_SCHEMA.fieldNames()
    rows = []
    for _ in range(400):
        row = {
            "commit_id": rng.choice([None, "aaaa1", "aaaa2", "aaab", "b"] + [f"{rng.randrange(16**6):06x}"] * 4),
            "commit_date": rng.choice([None, at(1), at(2), at(2, 1), at(2, 2), at(rng.randint(3, 28), rng.randrange(60))]),
        }
        rows.append(tuple(row.get(n) for n in names))
    return spark.createDataFrame(rows, COMMIT_SCHEMA).cache()


@pytest.mark.parametrize("limit", [1, 5, 57, 68, 100, 150, 199, 250, 301, 333, 399, 400, 1000])
def test_newest_commits_equals_a_full_sort(tied, limit):
    ours = rec.newest_commits({"b": tied}, limit)["b"].select("commit_date", "commit_id")
    expected = newest_by_window(tied, limit).select("commit_date", "commit_id")
    assert ours.count() == min(limit, 400)
    assert ours.exceptAll(expected).isEmpty() and expected.exceptAll(ours).isEmpty()


def test_newest_commits_of_all_branches_take_few_queries(spark, tied, monkeypatch):
    asked = []
    real = rec._buckets
    monkeypatch.setattr(rec, "_buckets", lambda rows, *more: asked.append(len(rows)) or real(rows, *more))
    tables = {f"b{i}": tied.where(F.xxhash64("commit_id", "commit_date") % 7 != i) for i in range(6)}
    kept = rec.newest_commits(tables, 90)
    assert len(asked) <= 5 and asked[0] == 6
    for branch, table in tables.items():
        expected = newest_by_window(table, 90).select("commit_date", "commit_id")
        assert sorted(map(str, kept[branch].select("commit_date", "commit_id").collect())) == sorted(map(str, expected.collect()))


@pytest.mark.parametrize("date", [None, at(5)])
def test_newest_commits_with_plain_ids_of_one_date(make_commits, date):
    ids = [f"commit-number-{i:05d}" for i in range(300)] + ["commit", "commit-number-", None, None]
    table = make_commits(*[{"commit_id": i, "commit_date": date} for i in ids])
    for limit in (1, 2, 150, 301, 303):
        kept = rec.newest_commits({"b": table}, limit)["b"]
        expected = sorted(ids, key=lambda i: (i is None, i or ""))[:limit]
        assert sorted((r.commit_id for r in kept.collect()), key=str) == sorted(expected, key=str)


def test_newest_commits_among_copies(make_commits):
    copies = make_commits(*[{"commit_id": "a", "commit_date": at(5), "summary": s} for s in "x" * 30 + "y" * 20])
    for limit in (4, 31, 49):
        kept = rec.newest_commits({"b": copies}, limit)["b"]
        assert kept.count() == limit
        assert kept.exceptAll(copies).isEmpty()


def test_zero_is_unlimited(tied):
    assert rec.newest_commits({"b": tied}, 0)["b"] is tied


def test_hot_ids_are_split(spark, tables, config):
    """A third of the rows share an id and a third have none; the join splits their tasks."""
    settings = {
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {key: spark.conf.get(key) for key in settings}
    hot = (
        F.when(F.xxhash64("commit_id") % 3 == 0, F.lit("hot"))
        .when(F.xxhash64("commit_id") % 3 == 1, F.lit(None))
        .otherwise(F.col("commit_id"))
    )
    skewed = {
        b: (t if b == "master" else t.repartition(6)).withColumn("commit_id", F.col("commit_id") if b == "master" else hot)
        for b, t in tables.items()
    }
    expected = rec.union_branches(skewed, config.branches).where("branch <> 'master'")
    ids = skewed["master"].select("commit_id").where("commit_id IS NOT NULL").distinct()
    expected = expected.join(F.broadcast(ids), "commit_id", "left_anti").count() + skewed["master"].count()
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        unified = rec.reconcile(skewed, config).select("branch", "message")
        assert len(unified.collect()) == expected
        assert "skew=true" in unified._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
