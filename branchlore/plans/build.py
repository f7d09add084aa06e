"""The whole build: branch tables to stored facts, JSON datasets, document, manifest and report."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from branchlore.config import BuildConfig
from branchlore.operators import panels, quality, rollups
from branchlore.operators.enrich import commit_trailers, enrich
from branchlore.operators.ordering import DATASET_ORDERS
from branchlore.operators.reconcile import reconcile, root_view, survivors_first
from branchlore.schema import trailer_field_catalog
from branchlore.session import size_shuffles
from branchlore.sinks import document as doc
from branchlore.sinks.export import write_dataset
from branchlore.sinks.tables import publish_views, store_facts
from branchlore.sources.branch_tables import load_catalog_branches
from branchlore.sources.datasets import read_sections
from branchlore.staging import release


def relations(spark: SparkSession, commits: DataFrame, trailers: DataFrame, facts: DataFrame) -> dict[str, DataFrame]:
    """Every derived relation, lazily; ``facts`` is ``commits`` or the activity table."""
    return {
        "trailer_field_catalog": trailer_field_catalog(spark),
        "commits": commits,
        "commit_trailers": trailers,
        "authors": rollups.authors(facts),
        "author_activity": rollups.author_activity(facts),
        "daily_activity": rollups.daily_activity(facts),
        "branch_summary": rollups.branch_summary(facts),
        "trailer_summary": rollups.trailer_summary(trailers),
        "trailer_people_summary": rollups.trailer_people_summary(trailers),
    }


def views_over(spark: SparkSession, git_log_all: DataFrame, config: BuildConfig) -> dict[str, DataFrame]:
    """The relations over an unstored ``git_log_all``, for ad hoc SQL."""
    commits = enrich(git_log_all)
    derived = relations(spark, commits, commit_trailers(commits), commits)
    return {"git_log": root_view(git_log_all, config), "git_log_all": git_log_all, **derived}


def publish_from_catalog(spark: SparkSession, config: BuildConfig) -> BuildConfig:
    """Session views over the catalog's branch relations; returns the configuration with its branches."""
    tables, config = load_catalog_branches(spark, config)
    publish_views(spark, views_over(spark, reconcile(tables, config), config))
    return config


@dataclass
class Build:
    """What a build wrote: stored relations, paths of the exports and of the document sections
    beside the document, and the gate's report, stored as well."""

    relations: dict[str, DataFrame]
    paths: dict[str, str]
    external_sections: dict[str, str]
    report: DataFrame
    passed: bool


# Export name to relation.
EXPORTS = {
    "trailer_fields": "trailer_field_catalog",
    "commits": "commits",
    "authors": "author_activity",
    "daily_activity": "daily_activity",
    "trailer_summary": "trailer_summary",
    "commit_trailers": "commit_trailers",
    "trailer_people_summary": "trailer_people_summary",
    "branch_summary": "branch_summary",
}
# Sections that equal an export, row by row and in order.
SECTION_EXPORTS = {
    "author_summary": "authors",
    "trailer_summary": "trailer_summary",
    "trailer_people_summary": "trailer_people_summary",
}


def build(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    config: BuildConfig,
    out: str,
    as_of: dt.datetime,
    input_bytes: int | None = None,
) -> Build:
    """Run everything under ``out``; refreshing is running it again.

    Stored relations are versions: readers of the last build keep theirs while a new one is
    written, branches that did not change are not written, and a build that fails leaves them.

    Messages are read once: for the stored ``commits``.  Trailer rollups read the stored
    ``commit_trailers``, the others the stored ``activity``, and exports read stored rollups.
    The gate reads the written document and what it names.  ``input_bytes``, the size of the
    commit tables, lets shuffles start with enough parts.
    """
    if input_bytes:
        size_shuffles(spark, input_bytes)
    unified, staged = survivors_first(tables, config)
    commits = store_facts(enrich(unified), f"{out}/tables/commits", "author_date", unified)
    if staged:
        release(spark, staged)
    trailers = store_facts(commit_trailers(commits), f"{out}/tables/commit_trailers", "author_date")
    facts = store_facts(rollups.activity(commits), f"{out}/tables/activity", "commit_day")
    stored = {}
    for name, df in relations(spark, commits, trailers, facts).items():
        keep = name in ("commits", "commit_trailers", "trailer_field_catalog")
        stored[name] = df if keep else store_facts(df, f"{out}/tables/{name}")

    counts: dict[str, list] = {}
    paths = write_exports(stored, f"{out}/data", config.root_branch, counts=counts)
    sections = document_sections(stored)
    paths["dashboard"] = f"{out}/data/dashboard"
    external = write_dashboard(sections, doc.metadata(facts, config, as_of), paths, f"{out}/data", config.root_branch, counts)
    paths["branches"] = f"{out}/data/branches"
    doc.write_document(doc.manifest(spark, config), paths["branches"])

    written = read_sections(spark, paths["dashboard"], {name: df.schema for name, df in sections.items()})
    beside = {name: counts[SECTION_EXPORTS.get(name, name)] for name in external}
    found = quality.gate(spark, written, written=beside).unionByName(quality.live_check(panels.live_panels(commits, facts)))
    paths["report"] = f"{out}/data/report"
    found.write.mode("overwrite").json(paths["report"])
    report = spark.read.schema(quality.REPORT_SCHEMA).json(paths["report"])
    publish_views(spark, stored)
    return Build(stored, paths, external, report, quality.passed(report))


def write_exports(
    stored: Mapping[str, DataFrame],
    folder: str,
    root: str,
    names: Iterable[str] = tuple(EXPORTS),
    counts: dict[str, list] | None = None,
) -> dict[str, str]:
    """Ordered JSON datasets; returns their paths by name.  ``counts`` gets what was counted while writing."""
    paths = {name: f"{folder}/{name}" for name in names}
    for name, path in paths.items():
        found = write_dataset(stored[EXPORTS[name]], path, DATASET_ORDERS[name], root)
        if counts is not None:
            counts[name] = found
    return paths


def write_dashboard(
    sections: Mapping[str, DataFrame],
    metadata: DataFrame,
    exports: Mapping[str, str],
    folder: str,
    root: str,
    counts: dict[str, list] | None = None,
) -> dict[str, str]:
    """The document and the sections beside it that no export holds yet; returns the latter's paths.

    ``counts`` gets what was counted while the sections beside it were written.
    """
    external = {}
    for name, section in sections.items():
        if name in doc.INLINE:
            continue
        if name in SECTION_EXPORTS:
            external[name] = exports[SECTION_EXPORTS[name]]
        else:
            external[name] = f"{folder}/dashboard_{name}"
            found = write_dataset(section, external[name], doc.section_keys(section, name), root)
            if counts is not None:
                counts[name] = found
    document = doc.dashboard_document(metadata.sparkSession, metadata, sections, external, root)
    doc.write_document(document, f"{folder}/dashboard")
    return external


def document_sections(stored: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The sections of the dashboard document, before ordering."""
    return {
        "trailer_fields": stored["trailer_field_catalog"],
        "branch_summary": stored["branch_summary"],
        "author_summary": stored["author_activity"],
        "daily_activity": rollups.with_day_times(stored["daily_activity"]),
        "trailer_summary": stored["trailer_summary"],
        "trailer_people_summary": stored["trailer_people_summary"],
        "recent_commits": panels.recent_commits(stored["commits"]),
        "commits": panels.timed(stored["commits"]),
    }
