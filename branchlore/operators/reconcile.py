"""From per-branch commit tables to one relation with a ``branch`` column.

The root keeps every row.  Another branch keeps the rows whose ``commit_id`` the root
lacks; rows without an id are kept, and a commit on two such branches counts on both.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from branchlore.config import BuildConfig
from branchlore.operators.membership import lacking_key
from branchlore.schema import CHURN_COLUMNS, COMMIT_SCHEMA
from branchlore.staging import staging_path, stored


def union_branches(tables: Mapping[str, DataFrame], branches: Sequence[str]) -> DataFrame:
    """Rows of the listed branches with their branch name, in list order."""
    named = [
        tables[branch].select(F.lit(branch).alias("branch"), *COMMIT_SCHEMA.fieldNames())
        for branch in branches
    ]
    return reduce(DataFrame.unionByName, named)


def root_view(git_log_all: DataFrame, config: BuildConfig) -> DataFrame:
    """The root branch alone, without the branch column."""
    return git_log_all.where(F.col("branch") == config.root_branch).drop("branch")


def reconcile(tables: Mapping[str, DataFrame], config: BuildConfig) -> DataFrame:
    """The unified relation as one lazy plan with a single anti join for all branches."""
    root, others = _split(tables, config)
    if others is None:
        return root
    return root.unionByName(lacking_key(others, root, "commit_id"))


def reconcile_bucketed(tables: Mapping[str, DataFrame], config: BuildConfig) -> DataFrame:
    """The unified relation of branch tables stored in buckets of ``commit_id``: no row is shuffled.

    Every branch meets the root bucket by bucket, so neither messages nor ids move.  A bucket holds
    all rows of its ids and is not split; where one id has very many rows use ``reconcile``.
    """
    names = _names(tables, config)
    root_ids = tables[config.root_branch].select("commit_id")
    parts = [union_branches(tables, names[:1])]
    for branch in names[1:]:
        own = tables[branch].join(root_ids, "commit_id", "left_anti")
        parts.append(union_branches({branch: own}, [branch]))
    return reduce(DataFrame.unionByName, parts)


def reconcile_table(commits: DataFrame, config: BuildConfig) -> DataFrame:
    """The same for one table that already has a ``branch`` column."""
    branch = F.col("branch")
    root = commits.where(branch == config.root_branch)
    others = commits.where(branch != config.root_branch)
    if config.branches is not None:
        others = others.where(branch.isin(*config.branches))
    return root.unionByName(lacking_key(others, root, "commit_id"))


def reconcile_keys_first(tables: Mapping[str, DataFrame], config: BuildConfig) -> DataFrame:
    """The unified relation, finding the surviving ids before touching a message."""
    return survivors_first(tables, config)[0]


def survivors_first(tables: Mapping[str, DataFrame], config: BuildConfig) -> tuple[DataFrame, str | None]:
    """The unified relation and the path of the staged ids it reads, to be released after use.

    Long-lived branches share most of their history with the root, so the join that
    decides reads ids only, and its small result is staged.  The stored size of that
    result lets the planner choose: sent to the executors where it is small, else
    shuffled with the wide rows, and a hot id is split at run time.
    """
    root, others = _split(tables, config)
    if others is None:
        return root, None
    ids = others.select("branch", "commit_id").distinct()
    path = staging_path(root.sparkSession, "branch-only-commits")
    own = stored(lacking_key(ids, root, "commit_id"), path)
    kept = others.alias("o").join(
        own.alias("k"),
        (F.col("o.branch") == F.col("k.branch"))
        & F.col("o.commit_id").eqNullSafe(F.col("k.commit_id")),
        "left_semi",
    )
    return root.unionByName(kept), path


def _names(tables: Mapping[str, DataFrame], config: BuildConfig) -> list[str]:
    names = [config.root_branch, *(b for b in config.branches or tables if b != config.root_branch)]
    missing = [name for name in names if name not in tables]
    if missing:
        raise ValueError(f"no commit table for: {', '.join(missing)}")
    return names


def _split(tables: Mapping[str, DataFrame], config: BuildConfig):
    names = _names(tables, config)
    root = union_branches(tables, names[:1])
    return root, union_branches(tables, names[1:]) if names[1:] else None


def drop_churn(table: DataFrame) -> DataFrame:
    """A table imported without diffs: churn is NULL, and its columns are not read."""
    return table.withColumns({c: F.lit(None).cast("long") for c in CHURN_COLUMNS})


def newest_commits(tables: Mapping[str, DataFrame], limit: int) -> dict[str, DataFrame]:
    """The ``limit`` newest rows of every branch table, 0 for all.

    Newest is ``commit_date`` descending (unknown dates first), then ``commit_id``.
    Each branch's cut is found by counting: per slice of 19 hours, per second in the slice
    that holds the cut, per date in that second, then per id prefix, four characters more
    each time.  A step is one query for all branches; it counts two columns and yields one
    bucket per branch.  No branch is ever sorted, and rows are filtered where they lie.
    """
    if limit == 0:
        return dict(tables)
    cuts = {branch: _Cut(limit) for branch in tables}
    steps = [(F.shiftright(_age(), bits), partial(_newer, bits), partial(_in_slice, bits)) for bits in _SLICE_BITS]
    # conditions are only and-ed and or-ed, so an unknown one drops the row, and plain
    # comparisons with dates reach the scan
    while open_ := {branch: cut for branch, cut in cuts.items() if cut.open}:
        step = next(iter(open_.values())).step
        if step < len(steps):
            bucket, before, same = steps[step]
        else:
            length = _PREFIX * (step - len(steps) + 1)
            bucket = F.substring("commit_id", 1, length)
            before, same = partial(_smaller, bucket), bucket.eqNullSafe
        found = _buckets({b: tables[b].where(c.inside) for b, c in open_.items()}, bucket, {b: c.wanted for b, c in open_.items()})
        for branch, cut in open_.items():
            row = found.get(branch)
            if row is None:  # the branch has fewer rows
                cut.kept, cut.open = F.lit(True), False
                continue
            cut.kept = cut.kept | (cut.inside & before(row.bucket))
            cut.inside = cut.inside & same(row.bucket)
            cut.wanted -= row.before
            cut.step += 1
            if cut.wanted == row.rows:
                cut.kept, cut.open = cut.kept | cut.inside, False
            elif step >= len(steps) and (row.bucket is None or len(row.bucket) < length):
                cut.copies, cut.open = True, False  # the bucket is one whole id
    kept = {}
    for branch, cut in cuts.items():
        rows = tables[branch].where(cut.kept)
        kept[branch] = rows.unionByName(_copies(tables[branch].where(cut.inside), cut.wanted)) if cut.copies else rows
    return kept


@dataclass
class _Cut:
    """How far a branch's cut is known: rows surely kept, rows that hold the cut, and how many of these to keep."""

    wanted: int
    kept: Column = field(default_factory=lambda: F.lit(False))
    inside: Column = field(default_factory=lambda: F.lit(True))
    step: int = 0
    open: bool = True
    copies: bool = False


# Age is the negated date in microseconds; an unknown date has the smallest.  Slices of
# 2^36 microseconds are about 19 hours, of 2^20 about a second, of 2^0 a single date.
_UNKNOWN = -(2**63)
_SLICE_BITS = (36, 20, 0)
_PREFIX = 4  # characters of an id that one step more looks at


def _age() -> Column:
    date = F.col("commit_date")
    return F.when(date.isNull(), F.lit(_UNKNOWN)).otherwise(-F.unix_micros(date))


def _date(age: int) -> Column:
    return F.timestamp_micros(F.lit(-age))


def _newer(bits: int, time_slice: int) -> Column:
    youngest = time_slice << bits
    if youngest == _UNKNOWN:
        return F.lit(False)
    date = F.col("commit_date")
    return date.isNull() | (date > _date(youngest))


def _in_slice(bits: int, time_slice: int) -> Column:
    date = F.col("commit_date")
    youngest, oldest = time_slice << bits, ((time_slice + 1) << bits) - 1
    if youngest == _UNKNOWN:
        return date.isNull()
    return date.between(_date(oldest), _date(youngest))


def _smaller(column: Column, value: str | None) -> Column:
    # NULL sorts last, so everything known is smaller
    return column.isNotNull() if value is None else column < value


def _buckets(rows: Mapping[str, DataFrame], bucket: Column, wanted: Mapping[str, int]) -> dict:
    """Per branch the bucket holding row number ``wanted``, with its size and the rows before it.

    The running sums are over the buckets of one narrowing step, not over commits: slices
    of a history, 65,536 seconds, 1,048,576 dates, prefixes of four more characters.
    """
    named = [df.select(F.lit(branch).alias("branch"), bucket.alias("bucket")) for branch, df in rows.items()]
    counts = reduce(DataFrame.unionByName, named).groupBy("branch", "bucket").agg(F.count(F.lit(1)).alias("rows"))
    ordered = Window.partitionBy("branch").orderBy(F.asc_nulls_last("bucket"))
    upto = F.sum("rows").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    want = F.element_at(F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair]), F.col("branch"))
    running = counts.withColumn("upto", upto).withColumn("want", want)
    found = running.where((F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("rows") < F.col("want")))
    # one row per branch
    return {r.branch: r for r in found.select("branch", "bucket", "rows", (F.col("upto") - F.col("rows")).alias("before")).collect()}


def _copies(copies: DataFrame, wanted: int) -> DataFrame:
    """Any ``wanted`` of the rows that share date and id: by a hash of the whole row, equal rows last.

    Only the hashes are counted and added up.
    """
    whole = F.xxhash64(*copies.columns)
    counts = copies.groupBy(whole.alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))
    upto = F.sum("rows").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    running = counts.withColumn("upto", upto)
    cut = running.where((F.col("upto") >= wanted) & (F.col("upto") - F.col("rows") < wanted)).first()
    return copies.where(whole < cut.bucket).unionByName(
        copies.where(whole == cut.bucket).limit(wanted - (cut.upto - cut.rows))
    )
