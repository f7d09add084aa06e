from __future__ import annotations

import pytest
from conftest import SF
from pyspark.sql import functions as F

import check_oracle
import oracle_queries
from branchlore.operators import rollups
from branchlore.operators.enrich import enrich
from branchlore.operators.reconcile import reconcile_table, union_branches
from branchlore.plans import registry
from branchlore.streaming.commits import (
    ARRIVAL_SCHEMA,
    read_commit_stream,
    read_daily_sums,
    store_commits,
    store_daily_sums,
)


def test_arrivals_are_stored_once_and_reconciled_at_read(spark, tables, config, commits, tmp_path):
    arrivals = union_branches(tables, config.branches).select(*ARRIVAL_SCHEMA.fieldNames())
    landing, stored, log = (str(tmp_path / name) for name in ("landing", "stored", "log"))
    # other branches first: their rows are shared with the root only later
    arrivals.where("branch <> 'master'").repartition(3).write.parquet(landing)
    store_commits(read_commit_stream(spark, landing), stored, log).awaitTermination()
    arrivals.where("branch = 'master'").repartition(3).write.mode("append").parquet(landing)
    for _ in range(2):  # the second run finds nothing new
        store_commits(read_commit_stream(spark, landing, 1), stored, log).awaitTermination()
    table = spark.read.schema(enrich(arrivals).schema).parquet(stored)
    assert table.count() == arrivals.count()
    reconciled = reconcile_table(table, config).select(*commits.columns)
    assert reconciled.exceptAll(commits).isEmpty() and reconciled.count() == commits.count()


def test_daily_sums_hold_late_commits_too(spark, tables, config, tmp_path):
    arrivals = union_branches(tables, config.branches).select(*ARRIVAL_SCHEMA.fieldNames())
    landing, sums, log = (str(tmp_path / name) for name in ("landing", "sums", "log"))
    # the newest commits arrive first, then ones dated years before, then the rest
    arrivals.where("author_date >= '2024-01-20'").write.parquet(landing)
    store_daily_sums(enrich(read_commit_stream(spark, landing)), sums, log).awaitTermination()
    late = arrivals.where("author_date < '2024-01-20' OR author_date IS NULL")
    late = late.withColumn("author_date", F.expr("author_date - INTERVAL 9 YEARS"))
    late.write.mode("append").parquet(landing)
    store_daily_sums(enrich(read_commit_stream(spark, landing, 1)), sums, log).awaitTermination()
    streamed = read_daily_sums(spark, sums)
    batch = rollups.daily_activity(enrich(spark.read.parquet(landing)))
    assert streamed.exceptAll(batch).isEmpty() and streamed.count() == batch.count()
    assert streamed.where("commit_day < '2016-01-01'").count() > 0


def test_runs_land_in_many_files_and_make_a_batch_each(spark, tables, config, tmp_path, monkeypatch):
    monkeypatch.setattr(registry, "LANDED_ROWS", 100)
    arrivals = union_branches(tables, config.branches)
    # run 2 is large, run 1 has fewer rows than files
    run = F.when(F.col("summary").isin("view change 10", "click change 11", "error change 12"), 1).otherwise(2)
    few = arrivals.where(run == 1).count()
    arrivals = arrivals.unionByName(arrivals.limit(1).withColumn("summary", F.lit("click change 11")))
    landing, log, seen = str(tmp_path / "landing"), str(tmp_path / "log"), []
    files = registry._land(arrivals, run, landing)
    assert files == -(-(arrivals.count() - few - 1) // 100) > few + 1

    def look(batch, number):
        seen.append([tuple(r) for r in batch.groupBy(run.alias("run")).count().collect()])

    stream = read_commit_stream(spark, landing, files).writeStream.foreachBatch(look)
    stream.option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    assert seen == [[(1, few + 1)], [(2, arrivals.count() - few - 1)]]
    of_file = spark.read.parquet(landing).groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    assert of_file <= 150


@pytest.mark.parametrize("name", ["stream_daily_windows", "stream_reconciled"])
def test_streams_of_many_files_a_run_equal_their_oracle(spark, monkeypatch, name):
    monkeypatch.setattr(registry, "LANDED_ROWS", 50)
    connection = check_oracle.duck(SF)
    assert check_oracle.compare(spark, connection, SF, name, oracle_queries.oracle_sql()[name]) == ""
