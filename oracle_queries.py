"""DuckDB SQL for the registered queries, written apart from the Spark code.

Only the base commit text is shared.  Trailers are found the long way, line by line;
branch reconciliation is NOT EXISTS; every order spells out where NULL goes.
"""

from __future__ import annotations

from branchlore.sources.testdata import BASE_SQL

# The trailer fields, which must equal the library's.
CATALOG = """
catalog(ordinality, trailer_field, column_name, category) AS (VALUES
  (1, 'Reported-by', 'reported_by', 'person'),
  (2, 'Suggested-by', 'suggested_by', 'person'),
  (3, 'Diagnosed-by', 'diagnosed_by', 'person'),
  (4, 'Author', 'trailer_author', 'person'),
  (5, 'Co-authored-by', 'co_authored_by', 'person'),
  (6, 'Reviewed-by', 'reviewed_by', 'person'),
  (7, 'Tested-by', 'tested_by', 'person'),
  (8, 'Bug', 'bug', 'reference'),
  (9, 'Discussion', 'discussion', 'reference'),
  (10, 'Backpatch-through', 'backpatch_through', 'reference'))"""

# Field to column name.
COLUMNS = {
    "Reported-by": "reported_by",
    "Suggested-by": "suggested_by",
    "Diagnosed-by": "diagnosed_by",
    "Author": "trailer_author",
    "Co-authored-by": "co_authored_by",
    "Reviewed-by": "reviewed_by",
    "Tested-by": "tested_by",
    "Bug": "bug",
    "Discussion": "discussion",
    "Backpatch-through": "backpatch_through",
}

TS = "'%Y-%m-%d %H:%M:%S.%f'"
BASE_COLUMNS = (
    f"commit_id, author_name, author_email, strftime(author_date, {TS}) AS author_date,"
    f" committer_name, committer_email, strftime(commit_date, {TS}) AS commit_date, summary, message"
)
CHURN = "deltas, insertions, deletions, changed_files"

WITH = f"""WITH base AS ({BASE_SQL}),
master AS (SELECT * FROM base WHERE eid % 10 < 8),
rel17 AS (SELECT * FROM base WHERE eid % 10 IN (6, 8)),
rel18 AS (SELECT * FROM base WHERE eid % 10 IN (7, 8, 9)),
git_log_all AS (
  SELECT 'master' AS branch, t.* FROM master t
  UNION ALL
  SELECT 'REL_17_STABLE', t.* FROM rel17 t
  WHERE NOT EXISTS (SELECT 1 FROM master r WHERE r.commit_id = t.commit_id)
  UNION ALL
  SELECT 'REL_18_STABLE', t.* FROM rel18 t
  WHERE NOT EXISTS (SELECT 1 FROM master r WHERE r.commit_id = t.commit_id)),
commits AS (
  SELECT * REPLACE (CAST(coalesce(deltas, 0) AS BIGINT) AS deltas, CAST(coalesce(insertions, 0) AS BIGINT) AS insertions,
    CAST(coalesce(deletions, 0) AS BIGINT) AS deletions, CAST(coalesce(changed_files, 0) AS BIGINT) AS changed_files)
  FROM git_log_all),
{CATALOG},
split_messages AS (
  SELECT branch, commit_id, string_split_regex(coalesce(message, ''), '\\r?\\n') AS ls FROM git_log_all),
lines AS (SELECT branch, commit_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM split_messages),
found AS MATERIALIZED (
  SELECT *, regexp_extract_all(value, '(https?://[^\\s<>()"]+)', 1) AS us FROM (
    SELECT l.branch, l.commit_id, l.n, c.ordinality, c.trailer_field, c.category,
      trim(substr(l.line, instr(l.line, ':') + 1), ' ') AS value
    FROM lines l JOIN catalog c ON lower(split_part(trim(l.line, ' '), ':', 1)) = lower(c.trailer_field)
    WHERE regexp_matches(l.line, '^[A-Za-z0-9-]+:') AND trim(substr(l.line, instr(l.line, ':') + 1), ' ') <> '')),
url_hits AS (
  SELECT branch, commit_id, ordinality, n, unnest(us) AS url, unnest(range(1, len(us) + 1)) AS k FROM found),
urls AS (
  SELECT branch, commit_id, string_agg(url, chr(1) ORDER BY o, n, k) AS mentioned_urls
  FROM (SELECT branch, commit_id, url, first(ordinality ORDER BY ordinality, n, k) AS o,
          first(n ORDER BY ordinality, n, k) AS n, first(k ORDER BY ordinality, n, k) AS k
        FROM url_hits GROUP BY ALL) GROUP BY branch, commit_id),
people AS (
  SELECT branch, commit_id, string_agg(value, chr(1) ORDER BY o, n) AS mentioned_people
  FROM (SELECT branch, commit_id, value, first(ordinality ORDER BY ordinality, n) AS o,
          first(n ORDER BY ordinality, n) AS n
        FROM found WHERE category = 'person' GROUP BY ALL) GROUP BY branch, commit_id),
arrays AS (
  SELECT branch, commit_id,
    {", ".join(f"string_agg(value, chr(1) ORDER BY n) FILTER (trailer_field = '{f}') AS {c}" for f, c in COLUMNS.items())}
  FROM found GROUP BY branch, commit_id),
enriched AS (
  SELECT c.*, {", ".join(f"coalesce(a.{c}, '') AS {c}" for c in COLUMNS.values())},
    coalesce(p.mentioned_people, '') AS mentioned_people, coalesce(u.mentioned_urls, '') AS mentioned_urls
  FROM commits c
  LEFT JOIN arrays a ON a.branch = c.branch AND a.commit_id = c.commit_id
  LEFT JOIN people p ON p.branch = c.branch AND p.commit_id = c.commit_id
  LEFT JOIN urls u ON u.branch = c.branch AND u.commit_id = c.commit_id),
commit_trailers AS (
  SELECT f.branch, f.commit_id, c.summary, f.trailer_field, f.category AS trailer_category,
    f.value AS trailer_value, CASE WHEN f.category = 'person' THEN f.value ELSE '' END AS people,
    array_to_string(list_filter(f.us, lambda x, i: list_position(f.us, x) = i), chr(1)) AS urls, c.author_name, c.author_date
  FROM found f JOIN commits c ON c.branch = f.branch AND c.commit_id = f.commit_id)
"""

TRAILERS = ", ".join(COLUMNS.values())
SUMS = (
    "CAST(sum(insertions) AS BIGINT) AS total_insertions, CAST(sum(deletions) AS BIGINT) AS total_deletions,"
    " CAST(sum(changed_files) AS BIGINT) AS total_changed_files"
)
FIRST = f"strftime(min(author_date), {TS}) AS first_commit_at"
LAST = f"strftime(max(author_date), {TS}) AS last_commit_at"
RANGE = "author_date BETWEEN TIMESTAMP '2024-01-10 06:00:00' AND TIMESTAMP '2024-01-31 06:00:00'"
DAY_RANGE = "CAST(CAST(author_date AS DATE) AS TIMESTAMP) BETWEEN TIMESTAMP '2024-01-10 06:00:00' AND TIMESTAMP '2024-01-31 06:00:00'"
WINDOWED = "CAST(author_date AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-20'"
POSITION = (
    "CAST(CASE branch WHEN 'master' THEN 0 WHEN 'REL_17_STABLE' THEN 1 WHEN 'REL_18_STABLE' THEN 2 ELSE -1 END"
    " AS BIGINT) AS position"
)
BRANCH_SUMMARY = (
    f"SELECT branch, count(*) AS commit_count, count(DISTINCT author_email) AS author_count, {FIRST}, {LAST}, {SUMS}"
    " FROM commits {where} GROUP BY branch"
)
EXPLORER_BRANCHES = (
    "SELECT branch, count(*) AS commit_count, count(DISTINCT coalesce(author_email, '?')) AS author_count,"
    f" {FIRST}, {LAST}, {SUMS}, {POSITION} FROM commits WHERE {{where}} GROUP BY branch"
)
MILLIS = "CAST(CAST((epoch_us({c}) + 500) // 1000 AS BIGINT) AS VARCHAR)"


def _stats(where: str, branches: int) -> str:
    return f"""SELECT count(*) AS commit_count,
      count(DISTINCT coalesce(author_email, '?') || '::' || author_name) AS author_count,
      CAST({branches} AS BIGINT) AS branch_count, CAST(coalesce(sum(insertions), 0) AS BIGINT) AS total_insertions,
      CAST(coalesce(sum(deletions), 0) AS BIGINT) AS total_deletions,
      CAST(coalesce(sum(changed_files), 0) AS BIGINT) AS total_changed_files,
      strftime(max(author_date), {TS}) AS latest_commit_at FROM commits WHERE {where}"""


def _authors(where: str, having: str = "true", limit: int | None = None) -> str:
    # ties: position of the author's first commit in (branch, newest first, id) order
    tail = f"ORDER BY commit_count DESC, last_at DESC NULLS FIRST, seen LIMIT {limit}" if limit else ""
    return f"""SELECT author_email, author_name, commit_count, total_insertions, total_deletions, total_changed_files,
      strftime(last_at, {TS}) AS last_commit_at, branches FROM (
        SELECT author_email, author_name, count(*) AS commit_count, {SUMS}, max(author_date) AS last_at,
          min(place) AS seen, string_agg(DISTINCT branch, chr(1) ORDER BY branch) AS branches
        FROM (SELECT *, row_number() OVER (ORDER BY branch, author_date DESC NULLS FIRST, commit_id) AS place FROM commits)
        WHERE {where} GROUP BY author_email, author_name HAVING {having}) {tail}"""


_SEARCH = "(lower(author_name) LIKE '%user 12%' OR coalesce(lower(author_email), '') LIKE '%user 12%')"

_DENSE = f"""days AS (SELECT DISTINCT CAST(author_date AS DATE) AS day FROM commits
    WHERE branch <> 'master' AND CAST(author_date AS DATE) >= DATE '2024-01-05'),
  picked(branch) AS (VALUES ('REL_17_STABLE'), ('REL_18_STABLE')),
  series AS (SELECT branch, CAST(author_date AS DATE) AS day, CAST(sum(insertions) AS BIGINT) AS v FROM commits GROUP BY ALL),
  dense AS (SELECT strftime(d.day, '%Y-%m-%d') AS commit_day, p.branch, coalesce(s.v, 0) AS value
    FROM days d CROSS JOIN picked p LEFT JOIN series s ON s.day = d.day AND s.branch = p.branch)"""

_NAMES = """names AS (SELECT event_id AS eid, CASE event_id % 9
    WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'REL_' || user_id || '_STABLE'
    WHEN 3 THEN 'feature/X-' || user_id || '.REL_REL_1_STABLE_STABLE'
    WHEN 4 THEN 'Topic/' || repeat('aZ-', 14) || user_id
    WHEN 5 THEN 'master' WHEN 6 THEN 'REL_18_STABLE' ELSE event_type || ' ' || user_id END AS branch_name FROM events),
  suffixed AS (SELECT *, CASE WHEN coalesce(branch_name, '') = '' THEN 'head'
    ELSE left(regexp_replace(lower(branch_name), '[^a-z0-9]', '_', 'g'), 40) END AS suffix FROM names)"""

_LISTS = """listed AS (
    SELECT event_id AS eid, CASE WHEN event_id % 50 <> 0 THEN ['REL_' || (user_id % 5),
      CASE WHEN event_id % 2 = 0 THEN 'master' ELSE '' END, '', 'REL_' || (event_id % 5), event_type] ELSE [] END AS xs
    FROM events),
  items AS (SELECT eid, 'master' AS item, 0 AS n FROM listed
    UNION ALL SELECT eid, unnest(xs), generate_subscripts(xs, 1) FROM listed),
  firsts AS (SELECT eid, item, min(n) AS n FROM items WHERE item <> '' GROUP BY ALL)"""

_NUMSTAT = """numstat AS (SELECT md5(CAST(l_orderkey AS VARCHAR)) AS commit_id, count(*) AS entries,
    CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS added, CAST(sum(l_partkey % 20) AS BIGINT) AS removed
    FROM lineitem GROUP BY 1)"""

_FRAMES = """daily AS (SELECT event_type AS branch, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL),
  ranked AS (SELECT branch, day[1:7] AS month, day, n, row_number() OVER w - 1 AS i FROM daily
    WINDOW w AS (PARTITION BY branch, day[1:7] ORDER BY day)),
  odd AS (SELECT branch, month, n, row_number() OVER (PARTITION BY branch, month ORDER BY day) - 1 AS i
    FROM ranked WHERE n % 2 = 1)"""

_PANELS = {
    "Daily Commit Count By Branch": ("daily", ("time", "branch", "commit_count")),
    "Daily Insertions By Branch": ("daily", ("time", "branch", "total_insertions")),
    "Branch Summary": (
        "branches",
        (
            "branch",
            "commit_count",
            "author_count",
            "total_insertions",
            "total_deletions",
            "total_changed_files",
            "last_commit_at",
        ),
    ),
    "Top Authors": (
        "authors",
        (
            "branch",
            "author_name",
            "author_email",
            "commit_count",
            "total_insertions",
            "total_deletions",
            "total_changed_files",
            "last_commit_at",
        ),
    ),
    "Recent Commits": (
        "recent",
        ("time", "branch", "author_name", "summary", "insertions", "deletions", "changed_files"),
    ),
}


def _filled(column: str) -> str:
    return f"count(*) FILTER ({column} IS NOT NULL AND CAST({column} AS VARCHAR) <> '')"


def _coverage() -> str:
    names = (
        "branch",
        "commit_id",
        "author_name",
        "author_email",
        "author_date",
        "committer_name",
        "committer_email",
        "commit_date",
        "summary",
        "message",
        "deltas",
        "insertions",
        "deletions",
        "changed_files",
    )
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS row_count, {_filled(c)} AS filled_rows FROM git_log_all" for c in names
    )


def _gate() -> str:
    parts = ["SELECT 'panels_present' AS \"check\", 'all' AS target, 'ok' AS status, '5 panels' AS detail"]
    for title, (relation, columns) in _PANELS.items():
        parts += [
            f"SELECT 'column_coverage', '{title}.{c}', CASE WHEN {_filled(c)} = 0 THEN 'error' ELSE 'ok' END,"
            f" {_filled(c)} || ' of ' || count(*) FROM {relation}"
            for c in columns
        ]
    return f""", daily AS (SELECT branch, strftime(CAST(author_date AS DATE), '%Y') AS time, count(*) AS commit_count,
        sum(insertions) AS total_insertions FROM commits GROUP BY branch, CAST(author_date AS DATE), time),
      branches AS ({BRANCH_SUMMARY.format(where="")}),
      authors AS (SELECT branch, author_name, author_email, count(*) AS commit_count, {SUMS}, {LAST}
        FROM commits GROUP BY ALL),
      recent AS (SELECT *, author_date AS time FROM commits
        ORDER BY author_date DESC NULLS FIRST, commit_id, branch LIMIT 250)
      {" UNION ALL ".join(parts)}"""


def _live() -> str:
    counts = {
        "Daily Commit Count By Branch": f"SELECT DISTINCT branch, CAST(author_date AS DATE) FROM commits WHERE {DAY_RANGE}",
        "Daily Insertions By Branch": f"SELECT DISTINCT branch, CAST(author_date AS DATE) FROM commits WHERE {DAY_RANGE}",
        "Branch Summary": f"SELECT DISTINCT branch FROM commits WHERE {RANGE}",
        "Top Authors": "SELECT * FROM (SELECT DISTINCT branch, author_name, author_email"
        f" FROM commits WHERE {RANGE}) LIMIT 250",
        "Recent Commits": f"SELECT * FROM (SELECT 1 FROM commits WHERE {RANGE}) LIMIT 250",
    }
    return " UNION ALL ".join(
        f"SELECT 'live_rows' AS \"check\", '{title}' AS target, CASE WHEN count(*) > 0 THEN 'ok' ELSE 'error' END AS status,"
        f" count(*) AS \"rows\" FROM ({sql})"
        for title, sql in counts.items()
    )


_CHURN_TEXT = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in CHURN.split(", "))
_LOG = f"SELECT branch, {BASE_COLUMNS}, {_CHURN_TEXT} FROM git_log_all"
_BRANCHES = BRANCH_SUMMARY.format(where="")

ORACLES = {
    "git_log_all": _LOG,
    "git_log_all_keys_first": _LOG,
    "git_log_all_one_table": _LOG,
    "git_log_root": f"SELECT {BASE_COLUMNS}, {_CHURN_TEXT} FROM master",
    "max_commits": f"""SELECT branch, commit_id, strftime(commit_date, {TS}) AS commit_date FROM (
      SELECT *, row_number() OVER (PARTITION BY branch ORDER BY commit_date DESC NULLS FIRST, commit_id NULLS LAST) AS r
      FROM (SELECT 'master' AS branch, * FROM master UNION ALL SELECT 'REL_17_STABLE', * FROM rel17
            UNION ALL SELECT 'REL_18_STABLE', * FROM rel18)) WHERE r <= 300""",
    "no_diff_commits": f"""SELECT branch, count(*) AS commit_count, count(DISTINCT author_email) AS author_count,
      {FIRST}, {LAST}, CAST(0 AS BIGINT) AS total_insertions, CAST(0 AS BIGINT) AS total_deletions,
      CAST(0 AS BIGINT) AS total_changed_files FROM commits GROUP BY branch""",
    "branch_suffix": f", {_NAMES} SELECT eid, branch_name, suffix FROM suffixed",
    "branch_list_normalized": f", {_LISTS} SELECT eid, string_agg(item, ', ' ORDER BY n) AS branches FROM firsts GROUP BY eid",
    "branch_list_items": f""", {_LISTS} SELECT eid, row_number() OVER (PARTITION BY eid ORDER BY n) - 1 AS ordinality,
        item AS branch FROM firsts""",
    "branch_labels": f""", {_NAMES}
      SELECT eid, regexp_replace(regexp_replace(branch_name, 'REL_', 'R'), '_STABLE', '') AS label,
        CAST(CASE WHEN branch_name = 'master' THEN 0 ELSE 1 END AS BIGINT) AS root_rank,
        CAST(CASE WHEN branch_name IS NOT NULL THEN
          {POSITION.replace("branch", "branch_name").replace(" AS position", "")} END AS VARCHAR) AS position,
        suffix AS inferred FROM suffixed""",
    "branch_list": "SELECT 'master' || chr(1) || string_agg(branch, chr(1) ORDER BY branch) AS branches"
    " FROM (SELECT DISTINCT branch FROM git_log_all) WHERE branch <> 'master'",
    "commits": f"SELECT branch, {BASE_COLUMNS}, {CHURN}, {TRAILERS}, mentioned_people, mentioned_urls FROM enriched",
    "commits_churn": f"SELECT branch, commit_id, {CHURN} FROM commits",
    "commits_trailers_arrays": f"SELECT branch, commit_id, {TRAILERS} FROM enriched",
    "commits_mentions": "SELECT branch, commit_id, mentioned_people, mentioned_urls FROM enriched",
    "commit_trailers": "SELECT branch, commit_id, summary, trailer_field, trailer_category, trailer_value,"
    f" people, urls, author_name, strftime(author_date, {TS}) AS author_date FROM commit_trailers",
    "trailer_url_rows": """SELECT branch, commit_id, trailer_field, value AS trailer_value,
        row_number() OVER (PARTITION BY branch, commit_id, ordinality, n ORDER BY k) - 1 AS position, url
      FROM (SELECT h.branch, h.commit_id, f.trailer_field, f.value, h.ordinality, h.n, h.url, min(h.k) AS k
            FROM url_hits h JOIN found f ON f.branch = h.branch AND f.commit_id = h.commit_id
              AND f.ordinality = h.ordinality AND f.n = h.n GROUP BY ALL)""",
    "message_lines": "SELECT branch, commit_id, n - 1 AS line_number, line FROM lines",
    "unique_message_lines": """SELECT g.branch, g.commit_id, coalesce(u.unique_lines, '') AS unique_lines
      FROM git_log_all g LEFT JOIN (
        SELECT branch, commit_id, string_agg(line, chr(1) ORDER BY n) AS unique_lines FROM (
          SELECT branch, commit_id, trim(line, ' ') AS line, min(n) AS n FROM lines
          WHERE trim(line, ' ') <> '' GROUP BY ALL) GROUP BY branch, commit_id) u
      ON u.branch = g.branch AND u.commit_id = g.commit_id""",
    "sql_extract_field": """SELECT e.branch, e.commit_id, e.reviewed_by, e.bug,
        coalesce(u.urls, '') AS urls, coalesce(r.reporters, '') AS reporters,
        lower(e.branch) AS suffix, false AS bug_is_person
      FROM enriched e
      LEFT JOIN (SELECT branch, commit_id, string_agg(url, chr(1) ORDER BY n, k) AS urls FROM (
          SELECT branch, commit_id, url, first(n ORDER BY n, k) AS n, first(k ORDER BY n, k) AS k
          FROM url_hits WHERE ordinality = 9 GROUP BY ALL) GROUP BY branch, commit_id) u
        ON u.branch = e.branch AND u.commit_id = e.commit_id
      LEFT JOIN (SELECT branch, commit_id, string_agg(value, chr(1) ORDER BY n) AS reporters FROM (
          SELECT branch, commit_id, value, min(n) AS n FROM found WHERE ordinality = 1 GROUP BY ALL)
          GROUP BY branch, commit_id) r
        ON r.branch = e.branch AND r.commit_id = e.commit_id""",
    "trailer_field_catalog": """SELECT CAST(c.ordinality AS BIGINT) AS ordinality, c.trailer_field, c.column_name,
        c.category, c.category = 'person' AS is_person, count(f.n) AS entry_count
      FROM catalog c LEFT JOIN found f ON f.trailer_field = c.trailer_field GROUP BY ALL""",
    "authors": f"SELECT branch, author_name, author_email, count(*) AS commit_count, {FIRST}, {LAST}"
    " FROM git_log_all GROUP BY branch, author_name, author_email",
    "author_activity": f"SELECT branch, author_name, author_email, count(*) AS commit_count, {SUMS}, {LAST}"
    " FROM commits GROUP BY branch, author_name, author_email",
    "daily_activity": "SELECT branch, strftime(CAST(author_date AS DATE), '%Y-%m-%d') AS commit_day,"
    f" count(*) AS commit_count, {SUMS} FROM commits GROUP BY branch, CAST(author_date AS DATE)",
    "daily_activity_dashboard": f"""SELECT branch, strftime(day, '%Y-%m-%d') AS commit_day,
        strftime(day, '%Y-%m-%dT00:00:00Z') AS time, CAST(CAST(epoch_ms(CAST(day AS TIMESTAMP)) AS BIGINT) AS VARCHAR) AS time_unix_ms,
        count(*) AS commit_count, {SUMS}
      FROM (SELECT *, CAST(author_date AS DATE) AS day FROM commits) GROUP BY branch, day""",
    "branch_summary": _BRANCHES,
    "branch_summary_from_activity": _BRANCHES,
    "trailer_summary": f"""SELECT branch, trailer_field, trailer_category, trailer_value, count(*) AS entry_count,
        count(DISTINCT commit_id) AS commit_count, {FIRST}, {LAST}
      FROM commit_trailers GROUP BY branch, trailer_field, trailer_category, trailer_value""",
    "trailer_people_summary": f"""SELECT branch, people AS person, count(*) AS mention_count,
        count(DISTINCT commit_id) AS commit_count,
        string_agg(DISTINCT trailer_field, chr(1) ORDER BY trailer_field) AS trailer_fields, {FIRST}, {LAST}
      FROM commit_trailers WHERE trailer_category = 'person' GROUP BY branch, people""",
    "date_bounds": "SELECT strftime(min(CAST(author_date AS DATE)), '%Y-%m-%d') AS min_day,"
    " strftime(max(CAST(author_date AS DATE)), '%Y-%m-%d') AS max_day FROM commits",
    "branch_display": """SELECT branch, format('{:,}', CAST(sum(insertions) AS BIGINT)) AS insertions,
        strftime(max(author_date), '%b %-d, %Y, %-I:%M %p') AS last_commit,
        strftime(max(author_date), '%Y-%m-%dT%H:%M:%SZ') AS last_commit_iso,
        strftime(min(author_date), '%Y-%m-%d') AS first_day
      FROM commits GROUP BY branch""",
    "recent_commits": f"""SELECT branch, commit_id, author_name, author_email, strftime(author_date, {TS}) AS time,
        {MILLIS.format(c="author_date")} AS time_unix_ms, summary, {TRAILERS}, mentioned_people, mentioned_urls,
        insertions, deletions, changed_files
      FROM enriched ORDER BY author_date DESC NULLS FIRST, commit_id, branch LIMIT 250""",
    "commits_timed": f"SELECT branch, commit_id, strftime(author_date, {TS}) AS time,"
    f" {MILLIS.format(c='author_date')} AS time_unix_ms, message FROM commits",
    "panel_daily_commits": f"""SELECT strftime(CAST(CAST(author_date AS DATE) AS TIMESTAMP), {TS}) AS time,
        count(*) AS value, branch AS metric FROM commits WHERE {DAY_RANGE} GROUP BY CAST(author_date AS DATE), branch""",
    "panel_daily_insertions": f"""SELECT strftime(make_timestamp(CAST(bucket * 604800000000 AS BIGINT)), {TS}) AS time,
        CAST(sum(insertions) AS BIGINT) AS value, branch AS metric
      FROM (SELECT *, epoch_us(CAST(CAST(author_date AS DATE) AS TIMESTAMP)) // 604800000000 AS bucket
            FROM commits WHERE {DAY_RANGE}) GROUP BY bucket, branch""",
    "panel_branch_summary": BRANCH_SUMMARY.format(where=f"WHERE {RANGE}"),
    "panel_top_authors": f"""SELECT branch, author_name, author_email, commit_count, total_insertions, total_deletions,
        total_changed_files, strftime(last_at, {TS}) AS last_commit_at FROM (
          SELECT branch, author_name, author_email, count(*) AS commit_count, {SUMS}, max(author_date) AS last_at
          FROM commits WHERE {RANGE} GROUP BY branch, author_name, author_email)
      ORDER BY commit_count DESC, last_at DESC NULLS FIRST, author_email NULLS LAST, branch, author_name LIMIT 250""",
    "panel_recent_commits": f"""SELECT strftime(author_date, {TS}) AS time, branch, author_name, summary,
        insertions, deletions, changed_files
      FROM commits WHERE {RANGE} ORDER BY author_date DESC, commit_id, branch LIMIT 250""",
    "explore_stats": _stats(WINDOWED, 3),
    "explore_stats_no_match": _stats("false", 3),
    "explore_stats_root_default": _stats("branch = 'master' AND CAST(author_date AS DATE) = DATE '2024-01-20'", 1),
    "explore_authors": _authors("true", limit=15),
    "explore_authors_chosen": _authors("author_email IN ('u12@example.org', 'u7@example.org')"),
    "explore_authors_semi_join": EXPLORER_BRANCHES.format(
        where=f"author_email IN (SELECT author_email FROM commits WHERE {_SEARCH} AND author_email IS NOT NULL)"
    ),
    "explore_branches": EXPLORER_BRANCHES.format(where=WINDOWED),
    "explore_daily": "SELECT branch, strftime(CAST(author_date AS DATE), '%Y-%m-%d') AS commit_day,"
    f" count(*) AS commit_count, {SUMS} FROM commits WHERE {WINDOWED} GROUP BY branch, CAST(author_date AS DATE)",
    "explore_daily_zero_filled": f", {_DENSE} SELECT * FROM dense",
    "explore_share_of_max": f""", {_DENSE}
      SELECT *, value / greatest((SELECT max(value) FROM dense), 1) AS relative_value FROM dense""",
    "explore_recent": f"""SELECT branch, commit_id, strftime(author_date, {TS}) AS author_date, author_name, summary
      FROM commits WHERE {WINDOWED} ORDER BY commits.author_date DESC, branch, commit_id LIMIT 25""",
    "explore_author_search": _authors("true", _SEARCH, 60),
    "explore_from_activity": _authors(WINDOWED, limit=10),
    "numstat_rollup": f""", {_NUMSTAT} SELECT commit_id, entries AS deltas, added AS insertions, removed AS deletions,
        entries AS changed_files FROM numstat""",
    "log_dump_commits": f""", {_NUMSTAT} SELECT {BASE_COLUMNS.replace("commit_id", "b.commit_id", 1)}, CAST(entries AS VARCHAR) AS deltas,
        CAST(added AS VARCHAR) AS insertions, CAST(removed AS VARCHAR) AS deletions,
        CAST(entries AS VARCHAR) AS changed_files
      FROM base b LEFT JOIN numstat s ON s.commit_id = b.commit_id""",
    "frame_to_rows": f""", {_FRAMES} SELECT r.branch, r.month, r.i AS row_index, r.day, CAST(o.n AS VARCHAR) AS count,
        CASE WHEN r.i < 3 THEN r.day END AS field_2
      FROM ranked r LEFT JOIN odd o ON o.branch = r.branch AND o.month = r.month AND o.i = r.i""",
    "frame_cells": f""", {_FRAMES} SELECT branch, month, 'day' AS field, i AS row_index, day AS value FROM ranked
      UNION ALL SELECT branch, month, 'count', i, CAST(n AS VARCHAR) FROM odd
      UNION ALL SELECT branch, month, 'field_2', i, day FROM ranked WHERE i < 3""",
    "document_metadata": """SELECT '2024-01-31T06:00:00Z' AS generated_at, 'master' AS root_branch,
        '/srv/repos/example.git' AS repository_path,
        'master' || chr(1) || string_agg(DISTINCT branch, chr(1) ORDER BY branch) FILTER (branch <> 'master') AS branches
      FROM commits""",
    "document_section_scan": f"""SELECT branch, CAST(count(*) AS DOUBLE) AS commit_count,
        CAST(count(DISTINCT author_email) AS DOUBLE) AS author_count,
        CAST(sum(insertions) AS DOUBLE) AS total_insertions, CAST(sum(deletions) AS DOUBLE) AS total_deletions,
        CAST(sum(changed_files) AS DOUBLE) AS total_changed_files, {LAST} FROM commits GROUP BY branch""",
    "column_coverage": _coverage(),
    "quality_gate": _gate(),
    "live_panel_check": _live(),
    "stream_commits": _BRANCHES,
}
ORACLES["json_roundtrip"] = ORACLES["commit_trailers"]

ORACLES["import_csv"] = ORACLES["import_json"] = _LOG
# suffixes name the branches that a catalog was searched for
ORACLES["import_catalog"] = f"SELECT lower(branch) AS branch, {BASE_COLUMNS}, {_CHURN_TEXT} FROM git_log_all"
ORACLES["import_log_files"] = (
    f"SELECT branch, {BASE_COLUMNS}, CAST(insertions AS VARCHAR) AS insertions, CAST(deletions AS VARCHAR) AS deletions"
    " FROM git_log_all"
)
ORACLES["published_views"] = """SELECT lower(branch) AS branch, count(DISTINCT coalesce(CAST(CAST(author_date AS DATE) AS VARCHAR), '?')) AS days,
    count(*) AS commit_count, count(*) AS branch_count, count(DISTINCT author_email) AS author_count
  FROM commits GROUP BY branch"""

# Export: the relation's SQL and its key order.
_EXPORTS = {
    "trailer_fields": ("SELECT CAST(ordinality AS BIGINT) AS ordinality, trailer_field, column_name, category FROM catalog", "ordinality"),
    "commits": (ORACLES["commits"], "branch, author_date DESC NULLS FIRST, commit_id"),
    "authors": (ORACLES["author_activity"], "branch, commit_count DESC, last_commit_at DESC NULLS FIRST, author_email NULLS LAST, author_name"),
    "daily_activity": (ORACLES["daily_activity"], "branch, commit_day NULLS LAST"),
    "trailer_summary": (ORACLES["trailer_summary"], "branch, trailer_field, last_commit_at DESC NULLS FIRST, trailer_value"),
    "commit_trailers": (ORACLES["commit_trailers"], "branch, author_date DESC NULLS FIRST, commit_id, trailer_field, trailer_value"),
    "trailer_people_summary": (ORACLES["trailer_people_summary"], "branch, last_commit_at DESC NULLS FIRST, person"),
    "branch_summary": (_BRANCHES, "branch <> 'master', branch"),
}
for _name, (_sql, _order) in _EXPORTS.items():
    ORACLES[f"export_{_name}"] = f"SELECT *, row_number() OVER (ORDER BY {_order}) AS position FROM ({_sql})"


def _lines(panel: str, sql: str, *columns: str) -> str:
    """Rows as text, their values joined in this order."""
    said = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in columns)
    return f"SELECT '{panel}' AS panel, concat_ws('|', {said}) AS line FROM ({sql})"


_TIMED = f"SELECT *, strftime(author_date, {TS}) AS time FROM commits"


def _section(name: str, sql: str, order: str, *columns: str) -> str:
    return _lines(name, f"SELECT *, row_number() OVER (ORDER BY {order}) AS position FROM ({sql})", *columns, "position")


_TOTALS = ("total_insertions", "total_deletions", "total_changed_files")
_WRITTEN = {
    "daily_activity": (
        f"(SELECT branch, CAST(author_date AS DATE) AS commit_day, commit_day AS time, commit_day AS time_unix_ms, count(*) AS commit_count, {SUMS}"
        " FROM commits GROUP BY branch, CAST(author_date AS DATE))",
        ("branch", "commit_day", "time", "time_unix_ms", "commit_count", *_TOTALS),
    ),
    "branch_summary": ("branches", ("branch", "commit_count", "author_count", *_TOTALS, "first_commit_at", "last_commit_at")),
    "author_summary": ("authors", ("branch", "author_name", "author_email", "commit_count", *_TOTALS, "last_commit_at")),
    "recent_commits": (
        f"({ORACLES['recent_commits']})",
        (
            "branch", "commit_id", "author_name", "author_email", "time", "time_unix_ms", "summary", *COLUMNS.values(),
            "mentioned_people", "mentioned_urls", "insertions", "deletions", "changed_files",
        ),
    ),
}
ORACLES["quality_gate_observed"] = " UNION ALL ".join(
    [
        _gate(),
        *[
            f"SELECT 'as_written', '{name}.{c}', 'ok', {_filled(c)} || ' of ' || count(*) || ', ' || {_filled(c)} || ' of ' || count(*) || ' written'"
            f" FROM {relation}"
            for name, (relation, columns) in _WRITTEN.items()
            for c in columns
        ],
    ]
)

ORACLES["document_sections"] = " UNION ALL ".join(
    [
        _section("trailer_fields", "SELECT * FROM catalog", "ordinality", "ordinality"),
        _section("branch_summary", "SELECT DISTINCT branch FROM commits", _EXPORTS["branch_summary"][1], "branch"),
        _section("author_summary", *_EXPORTS["authors"], "branch", "commit_count", "last_commit_at", "author_email", "author_name"),
        _section("daily_activity", *_EXPORTS["daily_activity"], "branch", "commit_day"),
        _section("trailer_summary", *_EXPORTS["trailer_summary"], "branch", "trailer_field", "last_commit_at", "trailer_value"),
        _section("trailer_people_summary", *_EXPORTS["trailer_people_summary"], "branch", "last_commit_at", "person"),
        _section("recent_commits", ORACLES["recent_commits"], "time DESC NULLS FIRST, commit_id, branch", "time", "commit_id", "branch"),
        _section("commits", _TIMED, "branch, time DESC NULLS FIRST, commit_id", "branch", "time", "commit_id"),
    ]
)

_SCOPE = "CAST(author_date AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-25'"
_USER_1 = "(lower(author_name) LIKE '%user 1%' OR coalesce(lower(author_email), '') LIKE '%user 1%')"
_AUTHOR_COLUMNS = ("author_email", "author_name", "commit_count", "total_insertions", "total_deletions", "total_changed_files", "last_commit_at")
_SHARE = "CAST(round({v} * 1000000.0 / greatest(max({v}) OVER (), 1)) AS BIGINT) AS share"
_LABEL = "regexp_replace(regexp_replace(branch, 'REL_', 'R'), '_STABLE', '') AS label"
_SERIES = f"""SELECT strftime(d.day, '%Y-%m-%d') AS commit_day, p.branch, coalesce(s.v, 0) AS value
  FROM (SELECT DISTINCT CAST(author_date AS DATE) AS day FROM commits WHERE {_SCOPE}) d
  CROSS JOIN (SELECT DISTINCT branch FROM commits) p
  LEFT JOIN (SELECT branch, CAST(author_date AS DATE) AS day, CAST(sum(insertions) AS BIGINT) AS v FROM commits GROUP BY ALL) s
    ON s.day = d.day AND s.branch = p.branch"""
_BRANCH_ROWS = EXPLORER_BRANCHES.format(where=_SCOPE)
_TOTALS = ("total_insertions", "total_deletions", "total_changed_files")
ORACLES["explore_all"] = " UNION ALL ".join(
    [
        _lines("stats", _stats(_SCOPE, 3), "commit_count", "author_count", "branch_count", *_TOTALS, "latest_commit_at"),
        _lines("branches", _BRANCH_ROWS, "branch", "commit_count", "author_count", "first_commit_at", "last_commit_at", *_TOTALS, "position"),
        _lines("branch_chart", f"SELECT *, {_LABEL}, {_SHARE.format(v='commit_count')} FROM ({_BRANCH_ROWS})", "position", "label", "commit_count", "share"),
        _lines(
            "daily",
            f"SELECT branch, strftime(CAST(author_date AS DATE), '%Y-%m-%d') AS commit_day, count(*) AS commit_count, {SUMS}"
            f" FROM commits WHERE {_SCOPE} GROUP BY branch, CAST(author_date AS DATE)",
            "branch", "commit_day", "commit_count", *_TOTALS,
        ),
        _lines("series", f"SELECT *, {_SHARE.format(v='value')} FROM ({_SERIES})", "commit_day", "branch", "value", "share"),
        _lines("authors", _authors(_SCOPE, limit=15), *_AUTHOR_COLUMNS, "branches"),
        _lines("author_chart", f"SELECT *, {_SHARE.format(v='commit_count')} FROM ({_authors(_SCOPE, limit=10)})", *_AUTHOR_COLUMNS, "branches", "share"),
        _lines("picker", _authors(_SCOPE, _USER_1, 60), *_AUTHOR_COLUMNS, "branches"),
        _lines(
            "recent",
            f"SELECT branch, commit_id, strftime(commits.author_date, {TS}) AS author_date, author_name, summary FROM commits"
            f" WHERE {_SCOPE} ORDER BY commits.author_date DESC, branch, commit_id LIMIT 25",
            "branch", "commit_id", "author_date", "author_name", "summary",
        ),
    ]
)
ORACLES["explore_author_sync"] = f"""SELECT 'stay' AS step, author_email FROM (SELECT DISTINCT author_email FROM commits
    WHERE branch <> 'master' AND CAST(author_date AS DATE) <= DATE '2024-01-10'
      AND author_email IN ('u12@example.org', 'u7@example.org', 'nobody@example.org'))
  UNION ALL SELECT 'shown', author_email FROM (SELECT DISTINCT author_email FROM ({_authors("true", _SEARCH, 60)}))
  WHERE author_email IS NOT NULL"""

ORACLES["git_log_all_bucketed"] = ORACLES["stream_reconciled"] = _LOG
ORACLES["sql_panel_daily"] = ORACLES["panel_daily_insertions"]
ORACLES["sql_branch_panel"] = ORACLES["panel_branch_summary"]
ORACLES["export_authors_array"] = ORACLES["export_authors"]


def _repository(name: str, root: str, others: dict[str, str]) -> str:
    tables = {"master": "master", "REL_17_STABLE": "rel17", "REL_18_STABLE": "rel18"}
    chosen = lambda branch, where: (
        f"SELECT '{name}' AS repository, '{branch}' AS branch, {BASE_COLUMNS}, {_CHURN_TEXT} FROM {tables[branch]} t {where}"
    )
    lacking = f"WHERE NOT EXISTS (SELECT 1 FROM {tables[root]} r WHERE r.commit_id = t.commit_id)"
    return " UNION ALL ".join([chosen(root, ""), *[chosen(branch, lacking) for branch in others]])


ORACLES["git_log_all_repositories"] = " UNION ALL ".join(
    [
        _repository("core", "master", ("REL_17_STABLE", "REL_18_STABLE")),
        _repository("fork", "REL_18_STABLE", ("master", "REL_17_STABLE")),
        _repository("mirror", "master", ("REL_17_STABLE",)),
    ]
)
_EXACT = "count(*) AS commit_count, count(DISTINCT author_email) AS author_count, TRUE AS within_3_percent"
ORACLES["branch_summary_approx"] = f"""SELECT 'all' AS scope, branch, {_EXACT} FROM commits GROUP BY branch
  UNION ALL SELECT 'window', branch, {_EXACT} FROM commits WHERE {WINDOWED} GROUP BY branch"""
ORACLES["refresh_facts"] = """SELECT branch, count(*) FILTER (branch <> 'REL_18_STABLE' OR author_date < TIMESTAMP '2024-01-20') AS count_before,
    count(*) AS count_now, CASE branch WHEN 'REL_18_STABLE' THEN 'v=2' ELSE 'v=1' END AS written_by
  FROM commits GROUP BY branch"""
# A batch drops what was closed before it began: by the commits up to the batch before the last one.
ORACLES["stream_daily_windows"] = """, arrivals AS (
    SELECT 'master' AS branch, * FROM master UNION ALL SELECT 'REL_17_STABLE', * FROM rel17 UNION ALL SELECT 'REL_18_STABLE', * FROM rel18),
  in_runs AS (
    SELECT *, CAST(author_date AS DATE) AS day, CAST(coalesce(floor(datediff('day', DATE '2024-01-01', CAST(author_date AS DATE)) / 4.0), 0) AS INT)
      + CAST('0x' || commit_id[1:2] AS INT) % 3 AS run FROM arrivals),
  closed AS (
    SELECT run, max(max(author_date)) OVER (ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - INTERVAL 5 DAY AS upto
    FROM in_runs GROUP BY run),
  judged AS (
    SELECT *, author_date IS NULL OR coalesce(CAST(day + 1 AS TIMESTAMP) <= upto, FALSE) AS late FROM in_runs JOIN closed USING (run))
  SELECT branch, strftime(day, '%Y-%m-%d') AS commit_day, count(*) FILTER (NOT late) AS commit_count,
    CAST(coalesce(sum(insertions) FILTER (NOT late AND insertions IS NOT NULL), 0) AS BIGINT) AS total_insertions,
    CAST(coalesce(sum(deletions) FILTER (NOT late AND deletions IS NOT NULL), 0) AS BIGINT) AS total_deletions,
    CAST(coalesce(sum(changed_files) FILTER (NOT late AND changed_files IS NOT NULL), 0) AS BIGINT) AS total_changed_files,
    count(*) FILTER (late) AS late_count
  FROM judged GROUP BY branch, day"""


def oracle_sql() -> dict[str, str]:
    """Complete DuckDB statements, keyed like the registered queries."""
    return {name: WITH + sql for name, sql in ORACLES.items()}
