from __future__ import annotations

import pathlib

import pytest
from conftest import at
from pyspark.sql import functions as F

from branchlore.sinks import snapshots
from branchlore.sinks.tables import store_facts

SCHEMA = "branch string, commit_id string, author_date timestamp, n long"


@pytest.fixture
def facts(spark):
    def make(*rows):
        return spark.createDataFrame([(b, i, at(d), n) for b, i, d, n in rows], SCHEMA)

    return make


A, B, NONE = ("a", "1", 1, 1), ("b", "2", 2, 2), (None, "3", 3, 3)


def rows(df) -> list:
    return sorted((r.branch or "", r.commit_id, r.n) for r in df.collect())


def test_only_changed_branches_are_written_and_old_readers_keep_theirs(spark, facts, tmp_path):
    root = str(tmp_path)
    first = facts(A, B, NONE)
    assert snapshots.refresh(first, root, "author_date") == 1
    reader = snapshots.read_version(spark, root, first.schema)
    second = facts(A, ("b", "2", 2, 5), ("c", "9", 9, 9), NONE)
    assert snapshots.refresh(second, root, "author_date") == 2
    assert {p.branch: p.folder for p in snapshots.parts(spark, root)} == {"a": "v=1", "b": "v=2", "c": "v=2", None: "v=1"}
    assert sorted(p.name for p in (tmp_path / "v=2").iterdir() if p.is_dir()) == ["branch=b", "branch=c"]
    assert rows(reader) == rows(first) == rows(snapshots.read_version(spark, root, first.schema, 1))
    assert rows(snapshots.read_version(spark, root, first.schema)) == rows(second)


def test_equal_rows_in_another_order_write_nothing(spark, facts, tmp_path):
    snapshots.refresh(facts(A, A, B, NONE), str(tmp_path))
    snapshots.refresh(facts(NONE, B, A, A).repartition(3), str(tmp_path))
    assert not (tmp_path / "v=2").exists()
    snapshots.refresh(facts(NONE, B, A), str(tmp_path))  # one copy less
    assert rows(snapshots.read_version(spark, str(tmp_path), facts(A).schema)) == rows(facts(A, B, NONE))


def test_gone_branches_and_empty_tables(spark, facts, tmp_path):
    root, schema = str(tmp_path), facts(A).schema
    assert rows(snapshots.read_version(spark, root, schema)) == []
    snapshots.refresh(facts(A, B), root)
    snapshots.refresh(facts(B), root)
    assert rows(snapshots.read_version(spark, root, schema)) == rows(facts(B))
    snapshots.refresh(facts(), root)
    assert rows(snapshots.read_version(spark, root, schema)) == []


def test_a_killed_write_leaves_the_version_whole(spark, facts, tmp_path):
    root, schema = str(tmp_path), facts(A).schema
    snapshots.refresh(facts(A, B), root)
    broken = facts(A, ("b", "2", 2, 7)).withColumn("n", F.when(F.col("branch") == "b", F.raise_error(F.lit("killed")).cast("long")).otherwise(F.col("n")))
    with pytest.raises(Exception, match="killed"):
        snapshots.refresh(broken, root, source=facts(A, ("b", "2", 2, 7)))
    # a writer that died after its files but before its list
    facts(("b", "x", 1, 1)).write.partitionBy("branch").parquet(f"{root}/v=2")
    assert snapshots.versions(spark, root) == [1]
    assert rows(snapshots.read_version(spark, root, schema)) == rows(facts(A, B))
    assert snapshots.refresh(facts(A, ("b", "2", 2, 7)), root) == 2
    assert rows(snapshots.read_version(spark, root, schema)) == rows(facts(A, ("b", "2", 2, 7)))


def test_the_slower_of_two_writers_fails(spark, facts, tmp_path):
    root = str(tmp_path)
    store = snapshots._Store(spark, root)
    snapshots.refresh(facts(A), root)
    with pytest.raises(FileExistsError):
        store.put(f"{root}/{snapshots.VERSIONS}/1.json", "x")
    assert rows(snapshots.read_version(spark, root, facts(A).schema)) == rows(facts(A))


def test_expired_versions_leave_what_newer_ones_name(spark, facts, tmp_path):
    root = str(tmp_path)
    for n in range(4):
        snapshots.refresh(facts(A, ("b", "2", 2, n)), root)
    assert snapshots.expire(spark, root, keep=1) == [1, 2, 3]
    assert sorted(p.name for p in tmp_path.iterdir()) == [snapshots.VERSIONS, "v=1", "v=4"]
    assert not [p for p in pathlib.Path(root, "v=1").iterdir() if p.name == "branch=c"]
    assert rows(snapshots.read_version(spark, root, facts(A).schema)) == rows(facts(A, ("b", "2", 2, 3)))


def test_a_filter_on_the_branch_reads_its_folder_alone(spark, facts, tmp_path):
    root = str(tmp_path)
    snapshots.refresh(facts(A, B), root)
    plan = snapshots.read_version(spark, root, facts(A).schema).where("branch = 'a'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "branch" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_tables_without_branches_are_written_whole(spark, tmp_path):
    df = spark.range(5).selectExpr("id AS n")
    first = store_facts(df, str(tmp_path))
    second = store_facts(df.where("n > 2"), str(tmp_path))
    assert first.count() == 5 and second.count() == 2
