"""Branch commit tables from files or from the catalog, with the import options applied."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from branchlore.config import BuildConfig, suffix_of
from branchlore.operators.reconcile import drop_churn, newest_commits
from branchlore.schema import COMMIT_SCHEMA, conform
from branchlore.sources.log_dump import read_log_dump

RELATION_PREFIX = "git_log_"
UNIFIED_RELATIONS = ("git_log", "git_log_all")
TEXT_OPTIONS = {
    "json": {"mode": "FAILFAST"},
    "csv": {"mode": "FAILFAST", "header": True, "multiLine": True, "quote": '"', "escape": '"', "enforceSchema": False},
}


class BranchError(ValueError):
    """The branch relations do not fit the configuration."""


def relation_of(branch: str) -> str:
    return RELATION_PREFIX + suffix_of(branch)


def read_commits(spark: SparkSession, path: str | list[str], format: str = "parquet", **options) -> DataFrame:
    """A commit table from files; text formats are read with the base schema, never inferred.

    A row that does not parse is an error.  CSV has a header line, ``"`` around fields with line
    ends, and a quote inside doubled; ``options`` override.  ``format="log"`` reads exported log
    dumps.
    """
    if format == "log":
        return read_log_dump(spark, path)
    reader = spark.read.format(format).options(**{**TEXT_OPTIONS.get(format, {}), **options})
    if format not in ("parquet", "orc"):
        reader = reader.schema(COMMIT_SCHEMA)
    return conform(reader.load(path))


def apply_import_options(tables: Mapping[str, DataFrame], config: BuildConfig) -> dict[str, DataFrame]:
    """``include_diff`` and ``max_commits`` (per branch), as the import would."""
    imported = {branch: table if config.include_diff else drop_churn(table) for branch, table in tables.items()}
    return newest_commits(imported, config.max_commits)


def read_branches(
    spark: SparkSession, paths: Mapping[str, str], config: BuildConfig, format: str = "parquet", **options
) -> dict[str, DataFrame]:
    """One table per configured branch from ``paths[branch]``."""
    missing = [branch for branch in config.branches if branch not in paths]
    if missing:
        raise BranchError(f"no path for branches: {', '.join(missing)}")
    tables = {branch: read_commits(spark, paths[branch], format, **options) for branch in config.branches}
    return apply_import_options(tables, config)


def split_branches(table: DataFrame, config: BuildConfig) -> dict[str, DataFrame]:
    """One table per configured branch from a table with a ``branch`` column."""
    tables = {b: conform(table.where(F.col("branch") == b)) for b in config.branches}
    return apply_import_options(tables, config)


def list_relations(spark: SparkSession, schema: str | None = None) -> list[str]:
    """Candidate branch relations of a schema (the current one by default), by name."""
    found = spark.catalog.listTables(schema, "git_log*")
    # session views belong to no schema
    names = {t.name for t in found if not (schema and t.isTemporary)}
    return sorted(n for n in names if re.match("git_log.", n) and n not in UNIFIED_RELATIONS)


def resolve_branches(relations: Sequence[str], config: BuildConfig) -> dict[str, str]:
    """Branch name to relation, root first; raises when something needed is missing.

    Without a configured list the relations themselves name the branches (by suffix).
    """
    where = f"schema {config.schema}" if config.schema else "the current schema"
    if not relations:
        raise BranchError(f"no {RELATION_PREFIX}* relations in {where}; import branch tables first")
    root_relation = relation_of(config.root_branch)
    if root_relation not in relations:
        raise BranchError(
            f"relation {root_relation} of the root branch {config.root_branch!r} is missing in {where}"
        )
    resolved = {config.root_branch: root_relation}
    if config.branches is None:
        for name in sorted(relations):
            label = re.sub(f"^{RELATION_PREFIX}", "", name)
            if name != root_relation and relation_of(label) in relations:
                resolved[label] = relation_of(label)
        return resolved
    for branch in config.branches:
        relation = relation_of(branch)
        if relation not in relations:
            raise BranchError(f"relation {relation} of branch {branch!r} is missing in {where}")
        resolved[branch] = relation
    check_collisions(resolved)
    return resolved


def check_collisions(relations: Mapping[str, str]) -> None:
    """Two branches must not share a relation (long names are cut)."""
    owners: dict[str, str] = {}
    for branch, relation in relations.items():
        if relation in owners:
            raise BranchError(f"branches {owners[relation]!r} and {branch!r} share relation {relation}")
        owners[relation] = branch


def load_catalog_branches(
    spark: SparkSession, config: BuildConfig
) -> tuple[dict[str, DataFrame], BuildConfig]:
    """Tables of the catalog's branch relations, and the configuration with its branch list."""
    resolved = resolve_branches(list_relations(spark, config.schema), config)
    place = config.schema.split(".") if config.schema else []
    quoted = lambda *names: ".".join(f"`{name}`" for name in names)
    tables = {branch: conform(spark.table(quoted(*place, name))) for branch, name in resolved.items()}
    config = replace(config, branches=tuple(resolved))
    return apply_import_options(tables, config), config
