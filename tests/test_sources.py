from __future__ import annotations

import datetime as dt
import json

import pytest
from conftest import SF
from pyspark.sql import functions as F

from branchlore.config import BuildConfig
from branchlore.operators.reconcile import reconcile
from branchlore.schema import COMMIT_SCHEMA
from branchlore.sources import frames, log_dump, testdata
from branchlore.plans import registry
from branchlore.sources.branch_tables import load_catalog_branches, read_branches, read_commits, split_branches
from branchlore.sources.datasets import MANIFEST_SCHEMA, Selector, read_dataset, read_manifest, select_section, with_positions


def record(commit_id, message="", block="", fields=None):
    values = [commit_id, "Ann", "a@x", "2024-01-02T03:04:05+02:00", "Bob", "", "2024-01-02T01:04:05Z", "s", message, block]
    return "\x1f".join(values if fields is None else values[:fields])


def test_dump_files(spark, tmp_path):
    one = record("c1", "s\n\nBug: 1\r\n", "3\t1\ta.c\n-\t-\tlogo.png\n10\t0\tdir/b c.h\n")
    two = record("c2", "", "")
    (tmp_path / "a.log").write_text(one + "\x1e\n" + two + "\x1e\n", newline="")
    (tmp_path / "b.log").write_text(record("c3", "x", "-\t-\tbin") + "\x1e", newline="")
    rows = {r["commit_id"]: r for r in log_dump.read_log_dump(spark, str(tmp_path)).collect()}
    assert sorted(rows) == ["c1", "c2", "c3"]
    c1 = rows["c1"]
    assert c1["message"] == "s\n\nBug: 1\r\n" and c1["committer_email"] is None
    assert c1["author_date"] == c1["commit_date"]
    assert (c1["deltas"], c1["insertions"], c1["deletions"], c1["changed_files"]) == (3, 13, 1, 3)
    assert (rows["c2"]["deltas"], rows["c2"]["insertions"], rows["c2"]["message"]) == (None, None, None)
    assert (rows["c3"]["changed_files"], rows["c3"]["insertions"]) == (1, 0)


def test_dumps_as_branch_tables(spark, tmp_path):
    (tmp_path / "m.log").write_text(record("c1") + "\x1e" + record("c2") + "\x1e", newline="")
    (tmp_path / "a.log").write_text(record("c2") + "\x1e" + record("c3") + "\x1e", newline="")
    config = BuildConfig(branches="master,A")
    tables = read_branches(spark, {"master": str(tmp_path / "m.log"), "A": str(tmp_path / "a.log")}, config, "log")
    unified = reconcile(tables, config)
    expected = {("master", "c1"), ("master", "c2"), ("A", "c3")}
    assert set(map(tuple, unified.select("branch", "commit_id").collect())) == expected
    again = split_branches(unified, config)
    assert {b: t.count() for b, t in again.items()} == {"master": 2, "A": 1}


def test_a_dump_is_split_between_tasks(spark, tmp_path):
    path = tmp_path / "big.log"
    path.write_text("".join(record(f"c{i}", "text " * 20) + "\x1e\n" for i in range(2000)), newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        dump = log_dump.read_log_dump(spark, str(path))
        assert dump.select(F.spark_partition_id()).distinct().count() > 4
        assert dump.select("commit_id").distinct().count() == dump.count() == 2000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_malformed_record_fails(spark, tmp_path):
    (tmp_path / "a.log").write_text(record("c1") + "\x1e" + record("c2", fields=6) + "\x1e", newline="")
    with pytest.raises(Exception, match="log record with 6 fields"):
        log_dump.read_log_dump(spark, str(tmp_path)).collect()


def test_render_and_parse(spark):
    commits = testdata.commits_with_numstat(spark, SF)
    parsed = log_dump.parse_log_records(log_dump.render_log_records(commits))
    names = [c for c in parsed.columns if c not in ("deltas", "insertions", "deletions", "changed_files")]
    assert parsed.select(names).exceptAll(commits.select(names)).isEmpty()
    assert parsed.count() == commits.count()


def frame(spark, fields, values):
    return spark.createDataFrame([("k", fields, values)], "k string, fields array<string>, values array<array<string>>")


def test_frame_rows(spark):
    df = frame(spark, ["a", None, "c"], [["1", "2", "3"], ["x"], ["p", "q"]])
    rows = frames.frame_rows(df, ("a", "field_1", "c", "none"), keep=("k",)).orderBy("row_index").collect()
    assert [tuple(r) for r in rows] == [
        ("k", 0, "1", "x", "p", None),
        ("k", 1, "2", None, "q", None),
        ("k", 2, "3", None, None, None),
    ]


def test_frame_edges(spark):
    # more columns than fields count for the length only; a repeated name means the last
    df = frame(spark, ["a", "a"], [["1"], ["2"], ["x", "y"]])
    assert [tuple(r) for r in frames.frame_rows(df, ("a",)).orderBy("row_index").collect()] == [(0, "2"), (1, None)]
    for empty in ([], [[]], None, [None]):
        assert frames.frame_rows(frame(spark, ["a"], empty), ("a",)).isEmpty()
        assert frames.frame_cells(frame(spark, ["a"], empty)).isEmpty()
    cells = frames.frame_cells(df).orderBy("row_index", "value").collect()
    assert [tuple(r) for r in cells] == [("a", 0, "1"), ("a", 0, "2")]


def test_selector_scan(spark, tmp_path):
    path = tmp_path / "doc.json"
    path.write_text('{"daily": [{"time": "2024-01-02T00:00:00Z", "branch": "m", "n": 3}, {"branch": "x"}], "other": []}')
    document = spark.read.schema("daily array<struct<time:string,branch:string,n:long>>").json(str(path), multiLine=True)
    columns = [Selector("time", "t", "timestamp"), Selector("branch", "b", "string"), Selector("n", "count", "number")]
    rows = select_section(document, "daily", columns)
    assert rows.dtypes == [("t", "timestamp"), ("b", "string"), ("count", "double")]
    assert [(str(r["t"]), r["b"], r["count"]) for r in rows.collect()] == [
        ("2024-01-02 00:00:00", "m", 3.0),
        ("None", "x", None),
    ]


def test_array_of_commits(spark, tmp_path):
    path = tmp_path / "commits.json"
    times = ["2024-01-02T03:04:05+00:00", "2024-01-02T03:04:05.25+00:00", "2024-01-02T04:04:05.25+01:00", None]
    path.write_text(json.dumps([{"commit_id": str(i), "author_date": t, "deltas": i} for i, t in enumerate(times)], indent=1))
    rows = read_dataset(spark, str(path), COMMIT_SCHEMA, whole=True).orderBy("commit_id").collect()
    assert [r["deltas"] for r in rows] == [0, 1, 2, 3]
    half = dt.datetime(2024, 1, 2, 3, 4, 5, 250_000)
    assert [r["author_date"] for r in rows] == [half.replace(microsecond=0), half, half, None]
    (tmp_path / "empty.json").write_text("[]")
    assert read_dataset(spark, str(tmp_path / "empty.json"), COMMIT_SCHEMA, whole=True).isEmpty()


def test_manifest_reads_back(spark, tmp_path):
    path = tmp_path / "branches.json"
    path.write_text(
        '{\n "root_branch": "master",\n "branches": ["master", "A"],\n "include_diff": false,'
        '\n "max_commits": 0,\n "repository_path": "/r"\n}\n'
    )
    manifest = read_manifest(spark, str(path))
    assert manifest.schema == MANIFEST_SCHEMA
    assert tuple(manifest.first()) == ("master", ["master", "A"], False, 0, "/r")


def test_csv_keeps_line_ends_and_quotes(spark, tables, tmp_path):
    path = str(tmp_path / "csv")
    table = tables["master"].limit(200).withColumn("summary", F.concat(F.lit('say "a, b" '), F.col("summary")))
    table.write.options(**registry.CSV_OPTIONS).csv(path)
    read = read_commits(spark, path, "csv")
    assert read.exceptAll(table).isEmpty() and read.count() == 200


def test_broken_text_rows_are_errors(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"commit_id": "a"}\n{"commit_id": \n')
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        read_commits(spark, str(tmp_path / "a.json"), "json").collect()
    (tmp_path / "a.csv").write_text("commit_id,author_name\nx,y,z\n")
    with pytest.raises(Exception, match="(?i)malformed|column"):
        read_commits(spark, str(tmp_path / "a.csv"), "csv").collect()


def test_session_views_are_no_relations_of_a_schema(spark, tables):
    spark.range(1).createOrReplaceTempView("git_log_side")
    try:
        with registry._catalog(spark, tables) as config:
            assert config.schema.startswith("spark_catalog.")
            found, resolved = load_catalog_branches(spark, config)
            assert set(found) == {"master", "rel_17_stable", "rel_18_stable"} == set(resolved.branches)
            assert found["master"].count() == tables["master"].count()
    finally:
        spark.catalog.dropTempView("git_log_side")


def test_positions_follow_the_part_files(spark, tmp_path):
    spark.range(0, 1000, 1, 7).write.json(str(tmp_path / "d"))
    rows = with_positions(spark.read.schema("id long").json(str(tmp_path / "d"))).collect()
    assert sorted((r.position, r.id) for r in rows) == [(i + 1, i) for i in range(1000)]


def test_positions_move_no_rows_and_hold_where_files_are_cut_and_packed(spark, tmp_path):
    spark.range(0, 1000, 1, 7).selectExpr("id", "repeat('x', cast(id % 50 as int)) AS t").write.json(str(tmp_path / "d"))
    spark.range(1000, 1001, 1, 1).selectExpr("id", "'' AS t").write.mode("append").json(str(tmp_path / "d"))
    settings = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "100"}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        dataset = spark.read.schema("id long, t string").json(str(tmp_path / "d"))
        numbered = with_positions(dataset)
        assert "row_number" not in numbered._jdf.queryExecution().toString()
        # part files follow each other by name
        names = sorted({r[0] for r in dataset.select("_metadata.file_name").collect()})
        ids = [json.loads(line)["id"] for name in names for line in (tmp_path / "d" / name).read_text().splitlines()]
        assert sorted((r.position, r.id) for r in numbered.collect()) == list(enumerate(ids, start=1))
        assert dataset.rdd.getNumPartitions() > len(names)
    finally:
        for name in settings:
            spark.conf.unset(name)
