from __future__ import annotations

import datetime as dt
import json
import pathlib

import pytest
from conftest import SF

import branchlore.__main__ as job
from branchlore.operators import quality
from branchlore.operators.ordering import DATASET_ORDERS
from branchlore.plans.build import EXPORTS, build, document_sections, views_over
from branchlore.operators.reconcile import reconcile
from branchlore.sinks.document import INLINE, SECTIONS
from branchlore.sinks.export import write_dataset
from branchlore.sinks.tables import publish_views, save_table
from branchlore.sources.datasets import read_dataset, read_manifest, read_sections

AS_OF = dt.datetime(2024, 1, 31)


@pytest.fixture(scope="module")
def out(tmp_path_factory):
    return str(tmp_path_factory.mktemp("build"))


@pytest.fixture(scope="module")
def built(spark, tables, config, out):
    build(spark, tables, config, out, AS_OF)
    return build(spark, tables, config, out, AS_OF)  # a refresh replaces everything


def lines(path: str) -> list[dict]:
    """Rows of a dataset in part order."""
    found = []
    for part in sorted(pathlib.Path(path).glob("part-*")):
        found += [json.loads(line) for line in part.read_text().splitlines()]
    return found


def rank(row: dict, keys):
    """Sort key with None as the greatest value, descending for ``-``."""
    parts = []
    for key in keys:
        if key == "@root_first":
            parts.append(row["branch"] != "master")
        elif key.startswith("-"):
            value = row[key[1:]]
            number = value if not isinstance(value, str) else dt.datetime.fromisoformat(value).timestamp()
            parts.append((value is not None, -(number or 0)))
        else:
            parts.append((row[key] is None, row[key] or ""))
    return parts


def test_relations_equal_the_lazy_ones(built, commits, trailers):
    assert built.relations["commits"].exceptAll(commits).isEmpty()
    assert built.relations["commits"].count() == commits.count()
    assert built.relations["commit_trailers"].exceptAll(trailers).isEmpty()


@pytest.mark.parametrize("name", EXPORTS)
def test_export_is_whole_and_in_order(spark, built, name):
    rows = lines(built.paths[name])
    assert len(rows) == built.relations[EXPORTS[name]].count()
    ranks = [rank(row, DATASET_ORDERS[name]) for row in rows]
    assert ranks == sorted(ranks)
    assert list(rows[0]) == built.relations[EXPORTS[name]].columns
    df = built.relations[EXPORTS[name]]
    assert read_dataset(spark, built.paths[name], df.schema).exceptAll(df).isEmpty()


def document(path: str) -> dict:
    return json.loads("".join(p.read_text() for p in sorted(pathlib.Path(path).glob("part-*"))))


def test_document(built):
    doc = document(built.paths["dashboard"])
    assert list(doc) == ["metadata", *INLINE, "external_sections"]
    assert doc["metadata"] == {
        "generated_at": "2024-01-31T00:00:00Z",
        "root_branch": "master",
        "repository_path": "/srv/repos/example.git",
        "branches": ["master", "REL_17_STABLE", "REL_18_STABLE"],
    }
    assert [r["ordinality"] for r in doc["trailer_fields"]] == list(range(1, 11))
    assert [r["branch"] for r in doc["branch_summary"]] == ["master", "REL_17_STABLE", "REL_18_STABLE"]
    assert len(doc["recent_commits"]) == 250 and len(doc["recent_commits"][0]) == 22
    assert set(doc["external_sections"]) == set(SECTIONS) - set(INLINE) == set(built.external_sections)
    for name, dataset in SECTIONS.items():
        rows = doc[name] if name in INLINE else lines(doc["external_sections"][name])
        keys = [k.replace("author_date", "time") if "commits" in name else k for k in DATASET_ORDERS[dataset]]
        ranks = [rank(row, keys) for row in rows]
        assert ranks == sorted(ranks), name
    assert len(lines(doc["external_sections"]["commits"])) == built.relations["commits"].count()


def test_gate_passes(spark, built):
    assert built.passed and built.report.where("status <> 'ok'").isEmpty()
    stored = spark.read.json(built.paths["report"])
    assert stored.count() == built.report.count()
    assert stored.where("check = 'live_rows'").count() == 5


def test_gate_reads_what_was_written(spark, built):
    schemas = {name: df.schema for name, df in document_sections(built.relations).items()}
    sections = read_sections(spark, built.paths["dashboard"], schemas)
    assert list(sections) == list(SECTIONS)
    report = quality.gate(spark, sections)
    assert quality.passed(report)
    sections["daily_activity"] = sections["daily_activity"].limit(0)
    assert not quality.passed(quality.gate(spark, sections))
    assert read_sections(spark, built.paths["dashboard"], {"unknown": schemas["commits"]}) == {}


def test_layout_does_not_depend_on_size(spark, tables, config, built, tmp_path):
    few = build(spark, {b: t.limit(30) for b, t in tables.items()}, config, str(tmp_path), AS_OF)
    small, large = document(few.paths["dashboard"]), document(built.paths["dashboard"])
    assert list(small) == list(large)
    assert set(small["external_sections"]) == set(large["external_sections"])


def test_job(spark, tables, tmp_path, monkeypatch):
    for branch, table in tables.items():
        table.write.parquet(str(tmp_path / branch))
    paths = [f"{branch}={tmp_path / branch}" for branch in tables]
    monkeypatch.setattr(job, "new_session", lambda *_: spark)
    options = ["--branches", "master, REL_18_STABLE", "--no-diff", "--max-commits", "50", "--out", str(tmp_path / "out")]
    # without diffs the churn columns hold zeros, which count as filled
    assert job.main([*options, *paths]) == 0
    rows = lines(str(tmp_path / "out" / "data" / "branch_summary"))
    assert [r["branch"] for r in rows] == ["master", "REL_18_STABLE"]
    assert rows[0]["commit_count"] == 50 and rows[0]["total_insertions"] == 0
    with pytest.raises(SystemExit):
        job.main(["--out", "x", "master"])


def test_manifest(spark, built):
    assert tuple(read_manifest(spark, built.paths["branches"]).first()) == (
        "master",
        ["master", "REL_17_STABLE", "REL_18_STABLE"],
        True,
        0,
        "/srv/repos/example.git",
    )


def test_views_serve_sql(spark, built):
    publish_views(spark, built.relations)
    assert spark.sql("SELECT count(*) FROM trailer_summary").first()[0] == built.relations["trailer_summary"].count()
    days = spark.sql("SELECT sum(commit_count) FROM daily_activity").first()[0]
    assert days == spark.sql("SELECT count(*) FROM commits").first()[0]


def test_lazy_views(spark, tables, config):
    names = publish_views(spark, views_over(spark, reconcile(tables, config), config))
    assert {"git_log", "git_log_all", "commits", "authors", "commit_trailers"} <= set(names)
    assert spark.table("git_log").count() == tables["master"].count()
    assert "branch" not in spark.table("git_log").columns


def test_saved_table_is_replaced(spark, commits):
    for _ in range(2):
        saved = save_table(commits.select("branch", "commit_id"), "stored_commits")
    assert saved.count() == commits.count()
    warehouse = pathlib.Path(spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:"))
    assert (warehouse / "stored_commits" / "branch=master").is_dir()


def test_copies_are_spread_over_files(spark, tmp_path):
    copies = spark.range(0, 40_000, 1, 8).selectExpr("'master' AS branch", "DATE'2024-01-01' AS commit_day")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_dataset(copies, str(tmp_path / "d"), DATASET_ORDERS["daily_activity"], "master")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    counts = [len(p.read_text().splitlines()) for p in (tmp_path / "d").glob("part-*")]
    assert sum(counts) == 40_000 and max(counts) < 20_000


def test_entry(spark):
    import __spark_entry__ as contract

    df = contract.entry(spark)
    assert df.count() > 0 and "mentioned_urls" in df.columns
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert SF in contract.SMOKE_DIR
