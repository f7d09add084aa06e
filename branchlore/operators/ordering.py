"""Sort orders with NULL as the greatest value: last ascending, first descending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from branchlore.functions.branches import root_first

ROOT_FIRST = "@root_first"


def order_by(*keys: str, root: str | None = None) -> list[Column]:
    """``"-x"`` is descending; ``ROOT_FIRST`` puts the root branch before the others."""
    columns = []
    for key in keys:
        if key == ROOT_FIRST:
            columns.append(root_first("branch", root).asc())
        elif key.startswith("-"):
            columns.append(F.desc_nulls_first(key[1:]))
        else:
            columns.append(F.asc_nulls_last(key))
    return columns


def newest(commits: DataFrame, limit: int, *ties: str) -> DataFrame:
    """The ``limit`` newest rows by ``author_date`` (unknown dates first), then ``ties``.

    Dates alone are ranked first.  The date of the last row wanted then filters the scan
    and whatever is below the sort, so wide rows that cannot be among the newest are
    neither read where files are clustered by date nor shuffled for reconciliation.
    """
    dates = commits.select("author_date").orderBy(F.desc_nulls_first("author_date")).limit(limit)
    last = dates.agg(F.min("author_date").alias("last")).scalar()
    date = F.col("author_date")
    candidates = commits.where(date.isNull() | (date >= last))
    return candidates.orderBy(*order_by("-author_date", *ties)).limit(limit)


def rank_struct(df: DataFrame, *keys: str, root: str | None = None) -> Column:
    """The same order as one ascending struct, for sorting arrays of structs.

    Descending keys must be numbers or timestamps.
    """
    parts = []
    for position, key in enumerate(keys):
        name = key.lstrip("-")
        if key == ROOT_FIRST:
            parts.append(root_first("branch", root).alias(f"k{position}"))
            continue
        column = F.col(name)
        if key.startswith("-"):
            if dict(df.dtypes)[name].startswith("timestamp"):
                column = F.unix_micros(column.cast("timestamp"))
            parts += [column.isNotNull().alias(f"n{position}"), (-column).alias(f"k{position}")]
        else:
            parts += [column.isNull().alias(f"n{position}"), column.alias(f"k{position}")]
    return F.struct(*parts)


# Key order of each exported dataset.  The trailing keys that the exports
# leave open (author_name, branch of recent commits) are added so that order is total.
DATASET_ORDERS = {
    "trailer_fields": ("ordinality",),
    "commits": ("branch", "-author_date", "commit_id"),
    "authors": ("branch", "-commit_count", "-last_commit_at", "author_email", "author_name"),
    "daily_activity": ("branch", "commit_day"),
    "trailer_summary": ("branch", "trailer_field", "-last_commit_at", "trailer_value"),
    "commit_trailers": ("branch", "-author_date", "commit_id", "trailer_field", "trailer_value"),
    "trailer_people_summary": ("branch", "-last_commit_at", "person"),
    "branch_summary": (ROOT_FIRST, "branch"),
    "recent_commits": ("-time", "commit_id", "branch"),
}
