"""Checks of the datasets behind the dashboard panels.

Findings are rows (check, target, status, detail); all checks report, none stops the others.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from branchlore.sources.datasets import Selector

REPORT_SCHEMA = "check string, target string, status string, detail string"


class Panel(NamedTuple):
    title: str
    kind: str
    datasets: tuple[str, ...]
    columns: tuple[Selector, ...]


def _columns(*named: tuple[str, str]) -> tuple[Selector, ...]:
    return tuple(Selector(name, name, kind) for name, kind in named)


# The dashboard panels, the section each reads and its typed columns.
PANELS = (
    Panel(
        "Daily Commit Count By Branch",
        "timeseries",
        ("daily_activity",),
        _columns(("time", "timestamp"), ("branch", "string"), ("commit_count", "number")),
    ),
    Panel(
        "Daily Insertions By Branch",
        "timeseries",
        ("daily_activity",),
        _columns(("time", "timestamp"), ("branch", "string"), ("total_insertions", "number")),
    ),
    Panel(
        "Branch Summary",
        "table",
        ("branch_summary",),
        _columns(
            ("branch", "string"),
            ("commit_count", "number"),
            ("author_count", "number"),
            ("total_insertions", "number"),
            ("total_deletions", "number"),
            ("total_changed_files", "number"),
            ("last_commit_at", "timestamp"),
        ),
    ),
    Panel(
        "Top Authors",
        "table",
        ("author_summary",),
        _columns(
            ("branch", "string"),
            ("author_name", "string"),
            ("author_email", "string"),
            ("commit_count", "number"),
            ("total_insertions", "number"),
            ("total_deletions", "number"),
            ("total_changed_files", "number"),
            ("last_commit_at", "timestamp"),
        ),
    ),
    Panel(
        "Recent Commits",
        "table",
        ("recent_commits",),
        _columns(
            ("time", "timestamp"),
            ("branch", "string"),
            ("author_name", "string"),
            ("summary", "string"),
            ("insertions", "number"),
            ("deletions", "number"),
            ("changed_files", "number"),
        ),
    ),
)
# The panels a dashboard must have, whatever the list above holds.
EXPECTED_PANELS = (
    "Branch Summary",
    "Daily Commit Count By Branch",
    "Daily Insertions By Branch",
    "Recent Commits",
    "Top Authors",
)
PANEL_KINDS = ("timeseries", "table")


def filled(column: str, data_type: T.DataType) -> Column:
    """Not NULL, not empty text, not an empty array or map; 0 and false count as filled."""
    value = F.col(column)
    present = value.isNotNull()
    if isinstance(data_type, T.StringType):
        present = present & (value != "")
    elif isinstance(data_type, (T.ArrayType, T.MapType)):
        present = present & (F.size(value) > 0)
    return present


def column_coverage(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column the row count and the rows that hold a value, in one pass."""
    columns = list(columns or df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(filled(c, types[c])).alias(f"c{i}") for i, c in enumerate(columns)],
    )
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("filled_rows")) for i, c in enumerate(columns)]
    )
    return counted.select(F.col("rows").alias("row_count"), F.inline(pairs)).select(
        "column_name", "row_count", "filled_rows"
    )


def counted(df: DataFrame, observation: Observation) -> DataFrame:
    """The rows unchanged; the action that writes them counts them and what each column holds.

    Put it last, on what is written: there every partition is counted once, however often a
    sort samples the plan below or a lost executor has earlier stages run again.
    """
    held = [F.count_if(filled(f.name, f.dataType)).alias(f"filled_{i}") for i, f in enumerate(df.schema.fields)]
    return df.observe(observation, F.count(F.lit(1)).alias("row_count"), *held)


def counts_of(columns: Sequence[str], observation: Observation) -> list[tuple[str, int, int]]:
    """What was counted while writing: (column, rows, rows that hold a value).  One number a column comes back."""
    got = observation.get
    return [(c, got.get("row_count", 0), got.get(f"filled_{i}", 0)) for i, c in enumerate(columns)]


def missing_panels(panels: Iterable[Panel], expected: Iterable[str] = EXPECTED_PANELS) -> list[str]:
    return sorted(set(expected) - {panel.title for panel in panels})


def _rows(spark: SparkSession, findings: list[tuple]) -> DataFrame:
    return spark.createDataFrame(findings, REPORT_SCHEMA)


def gate(
    spark: SparkSession,
    datasets: Mapping[str, DataFrame],
    panels: Sequence[Panel] = PANELS,
    expected: Iterable[str] = EXPECTED_PANELS,
    written: Mapping[str, Sequence[tuple[str, int, int]]] | None = None,
) -> DataFrame:
    """The report over all panels; each dataset is read once, for all panels on it.

    ``written`` has what ``counts_of`` gave for datasets that were counted while written.  All
    their columns are then compared with what is read back, in the same pass.
    """
    written = written or {}
    missing = missing_panels(panels, expected)
    findings = [("panels_present", title, "error", "not on the dashboard") for title in missing]
    if not missing:
        findings.append(("panels_present", "all", "ok", f"{len(panels)} panels"))
    covered: dict[str, list[tuple[str, str]]] = {}
    for panel in panels:
        if panel.kind not in PANEL_KINDS:
            findings.append(("panel_kind", panel.title, "error", f"kind {panel.kind!r} is none of {', '.join(PANEL_KINDS)}"))
        if len(panel.datasets) != 1:
            findings.append(
                ("one_dataset", panel.title, "error", f"reads {len(panel.datasets)} datasets instead of one")
            )
            continue
        name = panel.datasets[0]
        if name not in datasets:
            findings.append(("section_present", panel.title, "error", f"the document has no {name}"))
            continue
        df = datasets[name]
        selectors = [c.selector for c in panel.columns]
        absent = sorted(set(selectors) - set(df.columns))
        if absent:
            findings.append(("columns_present", panel.title, "error", f"not in {name}: {', '.join(absent)}"))
            continue
        covered.setdefault(name, []).extend((panel.title, selector) for selector in selectors)
    for name in written:
        if name in datasets:
            covered.setdefault(name, [])
        else:
            findings.append(("as_written", name, "error", "written, not found"))
    coverage = [_coverage_findings(name, datasets[name], wanted, written.get(name, ())) for name, wanted in covered.items()]
    return reduce(DataFrame.unionByName, coverage, _rows(spark, findings))


def _coverage_findings(
    name: str, df: DataFrame, wanted: list[tuple[str, str]], written: Sequence[tuple[str, int, int]]
) -> DataFrame:
    present = [c for c, _, _ in written if c in df.columns]
    coverage = column_coverage(df, list(dict.fromkeys([*(selector for _, selector in wanted), *present])))
    empty, unfilled = F.col("row_count") == 0, F.col("filled_rows") == 0
    found = F.concat_ws(" of ", F.col("filled_rows"), F.col("row_count"))
    checks = [
        F.struct(
            F.lit("column_coverage").alias("check"),
            F.lit(f"{title}.{selector}").alias("target"),
            F.when(empty | unfilled, "error").otherwise("ok").alias("status"),
            F.when(empty, "no rows").otherwise(found).alias("detail"),
            F.lit(selector).alias("column"),
        )
        for title, selector in wanted
    ]
    for column, rows, held in written:
        same = (F.col("row_count") == rows) & (F.col("filled_rows") == held)
        absent = column not in df.columns
        checks.append(
            F.struct(
                F.lit("as_written").alias("check"),
                F.lit(f"{name}.{column}").alias("target"),
                (F.lit("error") if absent else F.when(same, "ok").otherwise("error")).alias("status"),
                (F.lit("not found") if absent else F.concat(found, F.lit(f", {held} of {rows} written"))).alias("detail"),
                F.lit(present[0] if absent and present else column).alias("column"),
            )
        )
    reports = coverage.select("column_name", F.explode(F.array(*checks)).alias("finding"))
    return reports.where("column_name = finding.column").select("finding.check", "finding.target", "finding.status", "finding.detail")


def live_check(panel_queries: Mapping[str, DataFrame]) -> DataFrame:
    """Every panel query must return a row; with the first three fields of one of them."""
    checks = []
    for title, df in panel_queries.items():
        fields = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns[:3]]
        counted = df.select(F.concat_ws(", ", *fields).alias("sample")).agg(
            F.count(F.lit(1)).alias("rows"), F.min("sample").alias("sample")
        )
        checks.append(
            counted.select(
                F.lit("live_rows").alias("check"),
                F.lit(title).alias("target"),
                F.when(F.col("rows") > 0, "ok").otherwise("error").alias("status"),
                F.concat_ws(
                    "; ", F.concat(F.lit("rows="), F.col("rows")), F.concat(F.lit("sample="), F.col("sample"))
                ).alias("detail"),
            )
        )
    return reduce(DataFrame.unionByName, checks)


def passed(report: DataFrame) -> bool:
    return report.where(F.col("status") == "error").isEmpty()
