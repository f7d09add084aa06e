"""The build as a job: ``spark-submit branchlore/__main__.py`` or ``python -m branchlore``.

Branch tables come from ``BRANCH=PATH`` arguments, or from the catalog when there are
none.  The exit status is that of the quality gate.
"""

from __future__ import annotations

import argparse
import datetime as dt
import sys
from dataclasses import replace

from branchlore.config import DEFAULT_BRANCHES, DEFAULT_ROOT, BuildConfig, join_branches
from branchlore.plans.build import build
from branchlore.session import new_session
from branchlore.sources.branch_tables import load_catalog_branches, read_branches


def arguments(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="branchlore", description=__doc__)
    parser.add_argument("tables", nargs="*", metavar="BRANCH=PATH")
    parser.add_argument("--out", required=True, help="folder for tables and data")
    parser.add_argument("--format", default="parquet", help="of the paths: parquet, orc, json, csv or log")
    parser.add_argument("--schema", help="catalog schema to look for branch relations in")
    parser.add_argument(
        "--branches", default=join_branches(DEFAULT_BRANCHES), help="comma list, or 'auto' for all found"
    )
    parser.add_argument("--root-branch", default=DEFAULT_ROOT)
    parser.add_argument("--no-diff", action="store_true", help="leave churn out")
    parser.add_argument("--max-commits", type=int, default=0, help="newest per branch, 0 for all")
    parser.add_argument("--repository-path", default="")
    parser.add_argument("--input-bytes", type=int, help="size of the branch tables, to size shuffles")
    options = parser.parse_args(argv)
    if any("=" not in table for table in options.tables):
        parser.error("tables are given as BRANCH=PATH")
    return options


def main(argv: list[str] | None = None) -> int:
    options = arguments(argv)
    config = BuildConfig(
        root_branch=options.root_branch,
        branches=None if options.branches == "auto" else options.branches,
        schema=options.schema,
        include_diff=not options.no_diff,
        max_commits=options.max_commits,
        repository_path=options.repository_path,
    )
    spark = new_session("branchlore")
    if options.tables:
        paths = dict(table.split("=", 1) for table in options.tables)
        if config.branches is None:
            config = replace(config, branches=tuple(paths))
        tables = read_branches(spark, paths, config, options.format)
    else:
        tables, config = load_catalog_branches(spark, config)
    now = dt.datetime.now(dt.timezone.utc)
    built = build(spark, tables, config, options.out, now, input_bytes=options.input_bytes)
    print(f"{'passed' if built.passed else 'FAILED'}: the report is in {built.paths['report']}")
    return 0 if built.passed else 1


if __name__ == "__main__":
    sys.exit(main())
