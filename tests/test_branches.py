from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from branchlore.config import DEFAULT_BRANCHES, BuildConfig, join_branches, normalize_branches, suffix_of
from branchlore.functions import branches
from branchlore.plans.build import publish_from_catalog
from branchlore.sources.branch_tables import (
    BranchError,
    list_relations,
    load_catalog_branches,
    read_branches,
    read_commits,
    relation_of,
    resolve_branches,
)

SUFFIXES = {
    "REL_18_STABLE": "rel_18_stable",
    "feature/X-1": "feature_x_1",
    "": "head",
    None: "head",
    "a" * 45: "a" * 40,
    "été": "_t_",
    "KK": "k_",
}


def test_suffix(spark):
    df = spark.createDataFrame([(name,) for name in SUFFIXES], "b string")
    for name, suffix in df.select("b", branches.branch_suffix("b")).collect():
        assert suffix == SUFFIXES[name] == suffix_of(name)


def test_branch_list(spark):
    csv, expected = " REL_17 , master,,REL_18,REL_17", ["master", "REL_17", "REL_18"]
    assert list(normalize_branches(csv, " master ")) == expected
    column = branches.branch_list(F.lit(csv), F.lit(" master "))
    assert spark.range(1).select(column).first()[0] == expected
    assert join_branches(expected) == "master, REL_17, REL_18"
    assert spark.range(1).select(branches.join_list(column)).first()[0] == "master, REL_17, REL_18"


def test_labels_and_order(spark):
    names = ["REL_17_STABLE", "REL_REL_1_STABLE_STABLE", "master", "x\nREL_1"]
    rows = spark.createDataFrame([(n,) for n in names], "b string").select(
        "b",
        branches.short_label("b").alias("label"),
        branches.root_first("b", "master").alias("rank"),
        branches.configured_position("b", ["master", "REL_17_STABLE"]).alias("position"),
    )
    got = {r["b"]: (r["label"], r["rank"], r["position"]) for r in rows.collect()}
    assert got == {
        "REL_17_STABLE": ("R17", 1, 1),
        "REL_REL_1_STABLE_STABLE": ("RREL_1_STABLE", 1, -1),
        "master": ("master", 0, 0),
        "x\nREL_1": ("x\nR1", 1, -1),
    }


def test_defaults_and_presets():
    config = BuildConfig()
    assert config.root_branch == "master" and config.branches == DEFAULT_BRANCHES
    assert config.preset("all") == DEFAULT_BRANCHES
    assert config.preset("stable") == DEFAULT_BRANCHES[1:]
    assert config.preset("root") == ("master",)
    assert BuildConfig(root_branch=" main ", branches="a, main ,b").branches == ("main", "a", "b")
    with pytest.raises(ValueError):
        config.preset("none")
    with pytest.raises(ValueError):
        BuildConfig(max_commits=-1)


def test_resolution_errors():
    config = BuildConfig(branches="master,REL_18_STABLE")
    with pytest.raises(BranchError, match="no git_log_"):
        resolve_branches([], config)
    with pytest.raises(BranchError, match="root branch 'master'"):
        resolve_branches(["git_log_rel_18_stable"], config)
    with pytest.raises(BranchError, match="REL_18_STABLE"):
        resolve_branches(["git_log_master"], config)
    clash = BuildConfig(branches=["a/b", "a-b"])
    with pytest.raises(BranchError, match="share"):
        resolve_branches(["git_log_master", "git_log_a_b"], clash)


def test_inferred_branches_skip_what_has_no_relation():
    config = BuildConfig(root_branch="master", branches=None)
    listing = ["git_logs", "git_log_rel_18_stable", "git_log_master", "git_log_rel_17_stable"]
    assert resolve_branches(listing, config) == {
        "master": "git_log_master",
        "rel_17_stable": "git_log_rel_17_stable",
        "rel_18_stable": "git_log_rel_18_stable",
    }


def test_catalog_round_trip(spark, tables, config):
    spark.sql("CREATE DATABASE IF NOT EXISTS history")
    for branch, table in tables.items():
        table.write.mode("overwrite").saveAsTable(f"history.{relation_of(branch)}")
    spark.range(1).write.mode("overwrite").saveAsTable("history.git_log")
    spark.range(1).write.mode("overwrite").saveAsTable("history.git_log_all")
    assert list_relations(spark, "history") == sorted(relation_of(b) for b in tables)

    configured = BuildConfig(branches=config.branches, schema="history", include_diff=False, max_commits=5)
    loaded, resolved = load_catalog_branches(spark, configured)
    assert list(loaded) == list(config.branches) == list(resolved.branches)
    assert loaded["master"].count() == 5
    assert loaded["master"].where("insertions IS NOT NULL OR deltas IS NOT NULL").isEmpty()

    assert publish_from_catalog(spark, configured).branches == config.branches
    assert spark.sql("SELECT count(*) FROM git_log").first()[0] == 5
    assert spark.sql("SELECT count(DISTINCT branch) FROM branch_summary").first()[0] == 3

    _, inferred = load_catalog_branches(spark, BuildConfig(branches=None, schema="history"))
    assert inferred.branches == ("master", "rel_17_stable", "rel_18_stable")


def test_files_need_the_base_columns(spark, tables, config, tmp_path):
    paths = {}
    for branch, table in tables.items():
        paths[branch] = str(tmp_path / relation_of(branch))
        table.write.parquet(paths[branch])
    read = read_branches(spark, paths, config)
    assert read["master"].exceptAll(tables["master"]).isEmpty()
    with pytest.raises(BranchError, match="REL_17"):
        read_branches(spark, {"master": paths["master"]}, config)
    spark.range(1).write.parquet(str(tmp_path / "other"))
    with pytest.raises(ValueError, match="commit_id"):
        read_commits(spark, str(tmp_path / "other"))
