"""Commit tables derived from the driver's ``events`` and ``lineitem`` tables.

The base text is portable: the DuckDB oracle runs the very same string, so both
engines start from identical commits.  Everything after the base table is written
twice, independently, once here with DataFrames and once as oracle SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from branchlore.config import BuildConfig

FIXTURE_CONFIG = BuildConfig(
    root_branch="master",
    branches=("master", "REL_17_STABLE", "REL_18_STABLE"),
    repository_path="/srv/repos/example.git",
)

# Which residues of eid % 10 a branch holds: 6 and 7 are shared with the root,
# 8 is shared by both stable branches, 9 is on one stable branch only.
BRANCH_RESIDUES = {
    "master": (0, 1, 2, 3, 4, 5, 6, 7),
    "REL_17_STABLE": (6, 8),
    "REL_18_STABLE": (7, 8, 9),
}

BASE_SQL = """
SELECT event_id AS eid,
  md5(CAST(event_id AS STRING)) AS commit_id,
  'User ' || CAST(user_id AS STRING) AS author_name,
  CASE WHEN event_id % 211 = 0 THEN NULL ELSE 'u' || CAST(user_id % 120 AS STRING) || '@example.org' END AS author_email,
  CASE WHEN event_id % 997 = 0 THEN NULL ELSE ts END AS author_date,
  'Committer ' || CAST(user_id % 7 AS STRING) AS committer_name,
  'c' || CAST(user_id % 7 AS STRING) || '@example.org' AS committer_email,
  ts + INTERVAL '1' HOUR AS commit_date,
  event_type || ' change ' || CAST(event_id AS STRING) AS summary,
  CASE WHEN event_id % 101 = 0 THEN NULL ELSE
  event_type || ' change ' || CAST(event_id AS STRING) || chr(10) || chr(10)
  || 'Body text: not a trailer key' || chr(10)
  || CASE WHEN event_id % 3 = 0 THEN 'Reported-by: Rep ' || CAST(event_id % 40 AS STRING) || ' <r' || CAST(event_id % 40 AS STRING) || '@example.org>' || chr(10) ELSE '' END
  || CASE WHEN event_id % 15 = 0 THEN 'Suggested-by: Rev ' || CAST(event_id % 25 AS STRING) || chr(10) ELSE '' END
  || CASE WHEN event_id % 17 = 0 THEN 'Diagnosed-by: Rev ' || CAST(event_id % 25 AS STRING) || chr(10) ELSE '' END
  || CASE WHEN event_id % 5 = 0 THEN 'Author: User ' || CAST(user_id AS STRING) || chr(10) ELSE '' END
  || CASE WHEN event_id % 14 = 0 THEN 'co-authored-by: User ' || CAST((user_id + 1) % 150 AS STRING) || chr(10) ELSE '' END
  || CASE WHEN event_id % 4 = 0 THEN 'reviewed-BY:  Rev ' || CAST(event_id % 25 AS STRING) || '  ' || chr(13) || chr(10) ELSE '' END
  || CASE WHEN event_id % 8 = 0 THEN 'Reviewed-by: Rev ' || CAST(event_id % 25 AS STRING) || chr(10) ELSE '' END
  || CASE WHEN event_id % 19 = 0 THEN 'Tested-by:Rev ' || CAST(event_id % 25 AS STRING) || chr(10) ELSE '' END
  || CASE WHEN event_id % 6 = 0 THEN ' Author: indented, ignored' || chr(10) ELSE '' END
  || CASE WHEN event_id % 7 = 0 THEN 'Bug: ' || chr(10) ELSE '' END
  || CASE WHEN event_id % 9 = 0 THEN 'Bug: #' || CAST(event_id % 50 AS STRING) || chr(10) ELSE '' END
  || CASE WHEN event_id % 2 = 0 THEN 'Discussion: https://example.org/m/' || CAST(event_id % 100 AS STRING) || chr(10) ELSE '' END
  || CASE WHEN event_id % 12 = 0 THEN 'Discussion: see <https://example.org/m/' || CAST(event_id % 100 AS STRING) || '> and (http://example.org/x' || CAST(event_id % 3 AS STRING) || ')' || chr(10) ELSE '' END
  || CASE WHEN event_id % 13 = 0 THEN 'Signed-off-by: unlisted key' || chr(10) ELSE '' END
  || CASE WHEN event_id % 10 = 0 THEN 'Backpatch-through: ' || CAST(14 + event_id % 7 AS STRING) ELSE '' END
  END AS message,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE 1 + event_id % 4 END AS deltas,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 97 END AS insertions,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 53 END AS deletions,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE 1 + event_id % 6 END AS changed_files
FROM events
"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events, spread before the texts are made: the fixture is one small file."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").repartition(spark.sparkContext.defaultParallelism)


def base_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event, shaped like a commit, with the helper column ``eid``."""
    # event times are stored without a zone; commits carry instants (UTC)
    return spark.sql(
        BASE_SQL.replace("FROM events", "FROM {events}"),
        events=_events(spark, sf_dir),
    ).withColumns(
        {
            "author_date": F.col("author_date").cast("timestamp"),
            "commit_date": F.col("commit_date").cast("timestamp"),
        }
    )


def branch_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The per-branch commit tables, keyed by real branch name."""
    base = base_commits(spark, sf_dir)
    return {
        branch: base.where((F.col("eid") % 10).isin(*residues)).drop("eid")
        for branch, residues in BRANCH_RESIDUES.items()
    }


def numstat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-file line counts of commits, from ``lineitem``."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.md5(F.col("l_orderkey").cast("string")).alias("commit_id"),
        F.col("l_quantity").cast("long").alias("additions"),
        (F.col("l_partkey") % 20).alias("removals"),
        F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("path"),
    )


def commits_with_numstat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base commits plus a numstat text block (a handful of lines per commit)."""
    line = F.concat_ws("\t", "additions", "removals", "path")
    blocks = (
        numstat_lines(spark, sf_dir)
        .groupBy("commit_id")
        .agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("numstat_block"))
    )
    return base_commits(spark, sf_dir).join(blocks, "commit_id", "left")


def branch_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One branch-like name per event, some of them NULL, empty, long or real."""
    eid, user = F.col("event_id"), F.col("user_id").cast("string")
    name = (
        F.when(eid % 9 == 0, F.lit(None))
        .when(eid % 9 == 1, F.lit(""))
        .when(eid % 9 == 2, F.concat(F.lit("REL_"), user, F.lit("_STABLE")))
        .when(eid % 9 == 3, F.concat(F.lit("feature/X-"), user, F.lit(".REL_REL_1_STABLE_STABLE")))
        .when(eid % 9 == 4, F.concat(F.lit("Topic/"), F.repeat(F.lit("aZ-"), 14), user))
        .when(eid % 9 == 5, F.lit("master"))
        .when(eid % 9 == 6, F.lit("REL_18_STABLE"))
        .otherwise(F.concat(F.col("event_type"), F.lit(" "), user))
    )
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(eid.alias("eid"), name.alias("branch_name"))


def branch_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One comma list of branch names per event, with blanks and repeats."""
    eid, user = F.col("event_id"), F.col("user_id")
    csv = F.concat_ws(
        ",",
        F.concat(F.lit(" REL_"), (user % 5).cast("string"), F.lit("  ")),
        F.when(eid % 2 == 0, F.lit("master")).otherwise(F.lit("")),
        F.lit("   "),
        F.concat(F.lit("REL_"), (eid % 5).cast("string")),
        F.col("event_type"),
    )
    csv = F.when(eid % 50 != 0, csv)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(eid.alias("eid"), csv.alias("branches_csv"))


def column_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column frames per event type and month: a name, a short name and a nameless field.

    The second column lacks the days with an even count, so columns have uneven lengths.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    day = F.date_format("ts", "yyyy-MM-dd")
    daily = events.groupBy(F.col("event_type").alias("branch"), day.alias("day")).agg(
        F.count(F.lit(1)).alias("n")
    )
    pairs = F.sort_array(F.collect_list(F.struct("day", "n")))
    monthly = daily.groupBy("branch", F.substring("day", 1, 7).alias("month")).agg(pairs.alias("p"))
    odd = F.filter("p", lambda x: x["n"] % 2 == 1)
    return monthly.select(
        "branch",
        "month",
        F.array(F.lit("day"), F.lit("count"), F.lit(None).cast("string")).alias("fields"),
        F.array(
            F.col("p.day"),
            F.transform(odd, lambda x: x["n"].cast("string")),
            F.slice(F.col("p.day"), 1, 3),
        ).alias("values"),
    )
