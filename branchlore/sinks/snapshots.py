"""Stored tables in versions: readers keep what they began with, and a failed write leaves all as it was.

    ROOT/v=N                   rows that version N wrote, by branch where the table has one
    ROOT/_versions/N.json      what version N consists of: per branch the folder that holds it

A version exists once its list does.  The list is written last, beside its place, and renamed, so a
write that is killed leaves files that nothing names.  A branch whose rows did not change keeps
its folder and is not written again.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSIONS = "_versions"
BRANCH = "branch"


@dataclass(frozen=True)
class Part:
    """One branch of a version; the only part of a table without branches has the branch None."""

    branch: str | None
    folder: str
    rows: int
    print: str


class _Store:
    """The file system that holds a path, whichever it is."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.fs = self.path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, folder: str) -> list[str]:
        where = self.path(folder)
        return [f.getPath().getName() for f in self.fs.listStatus(where)] if self.fs.exists(where) else []

    def put(self, path: str, text: str) -> None:
        """Write a short file whole or not at all; an existing one is an error."""
        if self.fs.exists(self.path(path)):
            raise FileExistsError(path)
        beside = f"{path}.new"
        out = self.fs.create(self.path(beside), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if not self.fs.rename(self.path(beside), self.path(path)):
            raise FileExistsError(path)

    def drop(self, path: str) -> None:
        self.fs.delete(self.path(path), True)


def versions(spark: SparkSession, root: str) -> list[int]:
    """The versions there are, oldest first."""
    names = _Store(spark, root).names(f"{root}/{VERSIONS}")
    return sorted(int(name.removesuffix(".json")) for name in names if name.removesuffix(".json").isdigit() and name.endswith(".json"))


def parts(spark: SparkSession, root: str, version: int | None = None) -> list[Part]:
    """What a version (the newest by default) consists of; a row per branch."""
    found = versions(spark, root)
    if not found:
        return []
    schema = "branch string, folder string, rows long, print string"
    lines = spark.read.schema(schema).json(f"{root}/{VERSIONS}/{found[-1] if version is None else version}.json")
    return [Part(*row) for row in lines.collect()]


def fingerprints(rows: DataFrame) -> DataFrame:
    """Per branch the number of rows and a digest that does not depend on their order.

    Equal rows give equal digests; other rows give other ones but for a chance of about 2^-64.
    """
    whole = F.xxhash64(*rows.columns)
    by = [BRANCH] if BRANCH in rows.columns else []
    found = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(whole.cast("decimal(38,0)")).alias("total"), F.bit_xor(whole).alias("mixed")
    )
    said = F.concat_ws("/", F.col("rows").cast("string"), F.col("total").cast("string"), F.col("mixed").cast("string"))
    return found.select((F.col(BRANCH) if by else F.lit(None).cast("string")).alias(BRANCH), "rows", said.alias("print"))


def refresh(df: DataFrame, root: str, clustered_by: str | None = None, source: DataFrame | None = None) -> int:
    """Store ``df`` as the next version and return its number; readers of earlier ones are not disturbed.

    Where ``df`` has a ``branch``, branches whose fingerprint is that of the last version are not
    written.  ``source`` gives other rows to take the fingerprints of, such as the ones ``df``
    is made from where that costs more; it must have the same branches.  Branches that are gone are gone
    in the new version.  One writer at a time: the slower of two fails and leaves the other's version.
    """
    spark, store = df.sparkSession, _Store(df.sparkSession, root)
    found = versions(spark, root)
    number = found[-1] + 1 if found else 1
    recipe = df.schema.simpleString()
    now = {r.branch: (r.rows, f"{r.print} {recipe}") for r in fingerprints(df if source is None else source).collect()}
    last = {part.branch: part for part in parts(spark, root)}
    same = {b for b, (_, print_) in now.items() if b in last and last[b].print == print_}
    folder = f"v={number}"
    store.drop(f"{root}/{folder}")  # what a killed write left
    rows = df
    if same and BRANCH in df.columns:
        named = sorted(b for b in same if b is not None)
        kept = F.col(BRANCH).isin(*named) if named else F.lit(False)
        rows = df.where(~(F.coalesce(kept, F.lit(False)) | (F.col(BRANCH).isNull() if None in same else F.lit(False))))
    if len(same) < len(now) or not now:
        _write(rows, f"{root}/{folder}", clustered_by)
    listed = [last[b] if b in same else Part(b, folder, n, print_) for b, (n, print_) in now.items()]
    store.put(f"{root}/{VERSIONS}/{number}.json", "".join(json.dumps(asdict(part)) + "\n" for part in listed))
    return number


def _write(rows: DataFrame, path: str, clustered_by: str | None) -> None:
    if BRANCH not in rows.columns:
        rows.write.mode("overwrite").parquet(path)
        return
    # small branches make one file each, the adaptive planner splits a large one over tasks
    together = rows.hint("rebalance", BRANCH)
    order = [BRANCH, clustered_by] if clustered_by else [BRANCH]
    together.sortWithinPartitions(*order).write.mode("overwrite").partitionBy(BRANCH).parquet(path)


def read_version(spark: SparkSession, root: str, schema: T.StructType, version: int | None = None) -> DataFrame:
    """A version (the newest by default) as it was written; filters on the branch leave out whole folders."""
    listed = parts(spark, root, version)
    if not listed:
        return spark.createDataFrame([], schema)
    if BRANCH not in schema.names:
        return spark.read.schema(schema).parquet(*sorted({f"{root}/{p.folder}" for p in listed}))
    found = []
    for folder in sorted({p.folder for p in listed}):
        held = [p.branch for p in listed if p.folder == folder]
        named = [b for b in held if b is not None]
        mine = F.col(BRANCH).isin(*named) if named else F.lit(False)
        if None in held:
            mine = mine | F.col(BRANCH).isNull()
        found.append(spark.read.schema(schema).parquet(f"{root}/{folder}").where(mine).select(*schema.names))
    return reduce(DataFrame.unionByName, found)


def expire(spark: SparkSession, root: str, keep: int = 2) -> list[int]:
    """Delete all but the newest versions and the folders only they name; returns the versions that went.

    To be run while no writer is at work and no reader needs the old versions.
    """
    found, store = versions(spark, root), _Store(spark, root)
    old = found[:-keep] if keep else found
    for version in old:
        store.drop(f"{root}/{VERSIONS}/{version}.json")
    named = {part.folder for version in found[len(old) :] for part in parts(spark, root, version)}
    for name in store.names(root):
        if name.startswith("v=") and name not in named:
            store.drop(f"{root}/{name}")
    return old
