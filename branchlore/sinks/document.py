"""The dashboard document and the build manifest."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from branchlore.config import BuildConfig
from branchlore.functions.times import instant_to_iso
from branchlore.operators import rollups
from branchlore.operators.ordering import DATASET_ORDERS
from branchlore.sinks.export import JSON_OPTIONS, as_array

# The sections in document order, with the dataset whose order each follows.
SECTIONS = {
    "trailer_fields": "trailer_fields",
    "branch_summary": "branch_summary",
    "author_summary": "authors",
    "daily_activity": "daily_activity",
    "trailer_summary": "trailer_summary",
    "trailer_people_summary": "trailer_people_summary",
    "recent_commits": "recent_commits",
    "commits": "commits",
}
# Sections that are part of the document itself: a catalog, a row per branch, a list of fixed
# length.  All others grow with the history and are datasets beside it, at any size.
INLINE = ("trailer_fields", "branch_summary", "recent_commits")


def metadata(facts: DataFrame, config: BuildConfig, as_of: dt.datetime) -> DataFrame:
    """One row: when, from where, and the branches present, root first."""
    moment = as_of if as_of.tzinfo else as_of.replace(tzinfo=dt.timezone.utc)
    return rollups.sorted_branch_names(facts, config.root_branch).select(
        instant_to_iso(F.lit(moment)).alias("generated_at"),
        F.lit(config.root_branch).alias("root_branch"),
        F.lit(config.repository_path).alias("repository_path"),
        "branches",
    )


def dashboard_document(
    spark: SparkSession,
    metadata_row: DataFrame,
    inline: Mapping[str, DataFrame],
    external: Mapping[str, str],
    root: str,
) -> DataFrame:
    """One row with the metadata, the ``INLINE`` sections as ordered arrays, and the paths of the others."""
    parts: list[Column] = [metadata_row.select(F.struct("*")).scalar().alias("metadata")]
    for name in INLINE:
        df = inline[name]
        parts.append(as_array(df, section_keys(df, name), root).alias(name))
    places = [F.lit(x) for name, path in external.items() for x in (name, path)]
    parts.append(F.create_map(*places).cast("map<string,string>").alias("external_sections"))
    return spark.range(0, 1, 1, 1).select(*parts)


def section_keys(section: DataFrame, name: str) -> tuple[str, ...]:
    """Sort keys of a section; commit sections call the author date ``time``."""
    keys = DATASET_ORDERS[SECTIONS[name]]
    if "time" not in section.columns:
        return keys
    return tuple(key.replace("author_date", "time") for key in keys)


def document_json(document: DataFrame) -> DataFrame:
    options = {**JSON_OPTIONS, "pretty": "true"}
    return document.select(F.to_json(F.struct("*"), options).alias("value"))


def write_document(document: DataFrame, path: str) -> None:
    document_json(document).write.mode("overwrite").text(path)


def manifest(spark: SparkSession, config: BuildConfig) -> DataFrame:
    return spark.range(0, 1, 1, 1).select(
        F.lit(config.root_branch).alias("root_branch"),
        F.lit(list(config.branches)).alias("branches"),
        F.lit(config.include_diff).alias("include_diff"),
        F.lit(config.max_commits).cast("long").alias("max_commits"),
        F.lit(config.repository_path).alias("repository_path"),
    )
