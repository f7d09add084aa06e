"""Many repositories at once: the unified relation with a ``repository`` column.

Repositories may share commit ids (a fork, a mirror), so a commit is known by its repository and id.
Each has a root branch of its own.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from branchlore.operators.membership import lacking_key
from branchlore.schema import COMMIT_SCHEMA
from branchlore.sources.branch_tables import BranchError, read_commits

COLUMNS = ("repository", "branch", *COMMIT_SCHEMA.fieldNames())


def read_repositories(
    spark: SparkSession, paths: Mapping[str, Mapping[str, str]], format: str = "parquet", **options
) -> DataFrame:
    """Commits of ``paths[repository][branch]`` in one table."""
    named = [
        read_commits(spark, path, format, **options).select(
            F.lit(repository).alias("repository"), F.lit(branch).alias("branch"), *COMMIT_SCHEMA.fieldNames()
        )
        for repository, branches in paths.items()
        for branch, path in branches.items()
    ]
    if not named:
        raise BranchError("no repository")
    return reduce(DataFrame.unionByName, named)


def is_root(roots: Mapping[str, str]) -> Column:
    """Whether a row is on its repository's root branch."""
    listed = F.create_map(*[F.lit(x) for pair in roots.items() for x in pair])
    return F.coalesce(F.col("branch") == F.element_at(listed, F.col("repository")), F.lit(False))


def reconcile_repositories(commits: DataFrame, roots: Mapping[str, str]) -> DataFrame:
    """Root branches whole, other branches without the commits of their own repository's root.

    One anti join for all repositories.  Rows without an id are kept; rows of a repository that
    ``roots`` does not name, or of none, are left out.
    """
    mine = commits.where(F.col("repository").isin(*roots))
    root, others = mine.where(is_root(roots)), mine.where(~is_root(roots))
    key = F.when(F.col("commit_id").isNotNull(), F.struct("repository", "commit_id")).alias("_commit")
    ids = root.select(key)
    return root.unionByName(lacking_key(others.withColumn("_commit", key), ids, "_commit").drop("_commit"))
