from __future__ import annotations

from branchlore.operators import panels, quality, rollups
from branchlore.operators.enrich import commit_trailers
from branchlore.plans.build import document_sections, relations
from branchlore.sinks.export import write_dataset
from branchlore.sources.datasets import read_dataset


def report_of(df):
    return {(r["check"], r["target"]): (r["status"], r["detail"]) for r in df.collect()}


def test_coverage_counts_what_holds_a_value(spark):
    df = spark.createDataFrame(
        [(None, "", [], 0, False, "x", {}), (None, "", [], 0, False, None, {"k": 1})],
        "nulls string, blanks string, empties array<string>, zeros long, falses boolean, some string, maps map<string,int>",
    )
    got = {r["column_name"]: (r["row_count"], r["filled_rows"]) for r in quality.column_coverage(df).collect()}
    assert got == {
        "nulls": (2, 0),
        "blanks": (2, 0),
        "empties": (2, 0),
        "zeros": (2, 2),
        "falses": (2, 2),
        "some": (2, 1),
        "maps": (2, 1),
    }


def test_gate_passes_on_a_build(spark, commits):
    sections = document_sections(relations(spark, commits, commit_trailers(commits), commits))
    report = quality.gate(spark, sections)
    assert quality.passed(report)
    assert report.count() == 1 + sum(len(panel.columns) for panel in quality.PANELS)


def test_gate_reports_every_error(spark, commits):
    sections = document_sections(relations(spark, commits, commit_trailers(commits), commits))
    sections["author_summary"] = sections["author_summary"].limit(0)
    sections["recent_commits"] = sections["recent_commits"].drop("summary").drop("time")
    del sections["branch_summary"]
    odd = quality.Panel("Odd", "map", ("a", "b"), ())
    extra = [p for p in quality.PANELS if p.title != "Daily Insertions By Branch"] + [odd]
    report = quality.gate(spark, sections, extra)
    got = report_of(report)
    assert got["panels_present", "Daily Insertions By Branch"][0] == "error"
    assert got["panel_kind", "Odd"] == ("error", "kind 'map' is none of timeseries, table")
    assert got["one_dataset", "Odd"] == ("error", "reads 2 datasets instead of one")
    assert got["section_present", "Branch Summary"][0] == "error"
    assert got["columns_present", "Recent Commits"] == ("error", "not in recent_commits: summary, time")
    assert got["column_coverage", "Top Authors.branch"] == ("error", "no rows")
    assert got["column_coverage", "Daily Commit Count By Branch.branch"][0] == "ok"
    assert not quality.passed(report)


def test_a_panel_missing_from_the_list_is_found(spark):
    left = [p for p in quality.PANELS if p.title != "Top Authors"]
    assert quality.missing_panels(quality.PANELS) == []
    assert quality.missing_panels(left) == ["Top Authors"]


def test_empty_column_is_an_error(spark):
    df = spark.createDataFrame([("a", None)], "branch string, note string")
    panel = quality.Panel("P", "table", ("d",), quality._columns(("branch", "string"), ("note", "string")))
    got = report_of(quality.gate(spark, {"d": df}, [panel], expected=["P"]))
    assert got["column_coverage", "P.note"] == ("error", "0 of 1")
    assert got["column_coverage", "P.branch"] == ("ok", "1 of 1")


def test_live_check(spark, commits):
    daily = rollups.daily_activity(commits)
    report = quality.live_check(
        {"daily": panels.daily_panel(daily, "commit_count"), "none": panels.recent_panel(commits.limit(0))}
    )
    got = report_of(report)
    assert got["live_rows", "daily"][0] == "ok" and "time=2024-01-01" in got["live_rows", "daily"][1]
    assert got["live_rows", "none"] == ("error", "rows=0")


def test_what_was_counted_while_writing_is_compared_with_what_is_read(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, None), ("b", None, None), (None, 3, None)], "branch string, n long, note string").repartition(3)
    counts = write_dataset(rows, f"{tmp_path}/rows", ("branch",), "a")
    assert counts == [("branch", 3, 2), ("n", 3, 2), ("note", 3, 0)]
    back = read_dataset(spark, f"{tmp_path}/rows", rows.schema)
    panel = quality.Panel("P", "table", ("rows",), (quality.Selector("n", "n", "number"),))
    report = report_of(quality.gate(spark, {"rows": back}, [panel], ["P"], {"rows": counts}))
    assert report["column_coverage", "P.n"] == ("ok", "2 of 3")
    assert report["as_written", "rows.note"] == ("ok", "0 of 3, 0 of 3 written")
    lost = {"rows": back.where("branch = 'a'").drop("note")}
    report = report_of(quality.gate(spark, lost, [panel], ["P"], {"rows": counts, "gone": counts}))
    assert report["as_written", "rows.n"] == ("error", "1 of 1, 2 of 3 written")
    assert report["as_written", "rows.note"] == ("error", "not found")
    assert report["as_written", "gone"] == ("error", "written, not found")


def test_counts_of_empty_datasets(spark, tmp_path):
    rows = spark.createDataFrame([], "branch string, tags array<string>")
    assert write_dataset(rows, f"{tmp_path}/rows", ("branch",), "a") == [("branch", 0, 0), ("tags", 0, 0)]


def test_the_gate_reads_a_written_dataset_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1)], "branch string, n long")
    counts = write_dataset(rows, f"{tmp_path}/rows", ("branch",), "a")
    panel = quality.Panel("P", "table", ("rows",), (quality.Selector("n", "n", "number"),))
    back = read_dataset(spark, f"{tmp_path}/rows", rows.schema)
    report = quality.gate(spark, {"rows": back}, [panel], ["P"], {"rows": counts})
    assert report._jdf.queryExecution().executedPlan().toString().count("Scan json") == 1
