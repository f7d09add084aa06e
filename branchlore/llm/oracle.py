"""DuckDB SQL for the registered queries that SQL can express.

Shares only rules, templates and parameters with the operators; everything is worked out by
plain joins over unnested words.  Left to brute-force tests: fingerprints (no such hash in SQL),
a trained model, tokenizers and markup.
"""

from __future__ import annotations

from branchlore.llm import license_scan, quality_rules, secret_scan

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLDED = rf"regexp_extract_all(translate(t, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SPACED = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
DOCS = "d AS MATERIALIZED (SELECT row_number() OVER () AS rid, *, coalesce(text, '') AS t FROM documents)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _either_case(pattern: str) -> str:
    """ASCII letters in either case spelled out: folding in the other engine knows more letters."""
    head, tail = pattern.removeprefix("(?i:").removesuffix(")").split(")", 1)
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in head) + ")" + tail


def _secrets() -> str:
    rules = []
    for rank, rule in enumerate(secret_scan.RULES):
        pattern = _quoted(_either_case(rule.pattern) if rule.pattern.startswith("(?i:") else rule.pattern)
        rules.append(
            f"""SELECT rid, {rank} AS rank, '{rule.kind}' AS kind, {rule.least} AS least, string_split_regex(t, {pattern}) AS b,
                regexp_extract_all(t, {pattern}, 0) AS m, regexp_extract_all(t, {pattern}, {rule.group}) AS v
            FROM d WHERE regexp_matches(t, {pattern})"""
        )
    n_base = len(secret_scan.BASE_RULES)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secret_scan.BASE_RULES)
    zeros = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secret_scan.BASE_RULES)
    return f"""
WITH {DOCS}, found AS ({' UNION ALL '.join(rules)}),
each AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found),
spans AS (
  SELECT rid, rank, kind, m[i] AS said, CAST(list_sum(list_transform(b[1:i], lambda x: length(x))) AS BIGINT)
    + coalesce(CAST(list_sum(list_transform(m[1:i - 1], lambda x: length(x))) AS BIGINT), 0) AS s
  FROM each WHERE length(v[i]) >= least),
per AS (
  SELECT rid, {counts},
    string_agg(kind || ':' || s || ':' || (s + length(said)), ',' ORDER BY s, rank) FILTER (rank < {n_base}) AS base,
    string_agg(kind || ':' || s || ':' || (s + length(said)), ',' ORDER BY s, rank) AS spans
  FROM spans GROUP BY rid)
SELECT doc_id, {zeros}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (rid)"""


def _licences() -> str:
    rows = ", ".join(f"({n}, '{t.label}', '{t.text}', {t.key_at}, {len(t.key.split())})" for n, t in enumerate(license_scan.TEMPLATES))
    n_base = len(license_scan.BASE)
    return f"""
WITH {DOCS}, w AS MATERIALIZED (SELECT rid, {FOLDED} AS words FROM d),
p AS MATERIALIZED (SELECT rid, unnest(words) AS word, unnest(range(0, len(words))) AS pos FROM w),
tpl(number, label, body, key_at, key_len) AS (VALUES {rows}),
tw AS (SELECT number, unnest(string_split(body, ' ')) AS word, unnest(range(0, len(string_split(body, ' ')))) AS place FROM tpl),
df AS (SELECT word, count(DISTINCT rid) AS n FROM p WHERE word IN (SELECT word FROM tw) GROUP BY word),
ranked AS (
  SELECT number, word, row_number() OVER (PARTITION BY number ORDER BY n, word) AS r
  FROM (SELECT DISTINCT number, word FROM tw) JOIN df USING (word)),
rare AS (SELECT * FROM ranked WHERE r <= CASE WHEN number < {n_base} THEN 1 ELSE {license_scan.RARE_WORDS} END),
need AS (SELECT number, CASE WHEN number < {n_base} THEN 1 ELSE least({license_scan.AGREEING}, count(*)) END AS least_n FROM rare GROUP BY number),
starts AS (
  SELECT p.rid, number, p.pos - tw.place AS s FROM p JOIN tw USING (word) JOIN rare USING (number, word)
  JOIN need USING (number) GROUP BY p.rid, number, s, least_n HAVING count(*) >= least_n),
judged AS (
  SELECT starts.rid, number, s, label, CAST(count(*) FILTER (p.word = tw.word) AS DOUBLE) / count(*) AS score,
    count(*) FILTER (p.word = tw.word AND tw.place >= key_at AND tw.place < key_at + key_len) = key_len AS key_stands
  FROM starts JOIN tpl USING (number) JOIN tw USING (number) LEFT JOIN p ON p.rid = starts.rid AND p.pos = s + tw.place
  GROUP BY starts.rid, number, s, label, key_len),
per AS (
  SELECT rid, count(*) FILTER (number < {n_base}) AS n_base, min(s) FILTER (number < {n_base}) AS first_word,
    max(s) FILTER (number < {n_base}) AS last_word, max(score) AS score,
    array_to_string(list_sort(list(DISTINCT label) FILTER (number < {n_base})), ',') AS base_labels,
    array_to_string(list_sort(list(DISTINCT label)), ',') AS labels
  FROM judged WHERE key_stands AND score >= {license_scan.LEAST_SCORE} GROUP BY rid)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d JOIN w USING (rid) LEFT JOIN per USING (rid)"""


CONTAMINATION = rf"""
WITH {DOCS}, w AS MATERIALIZED (SELECT rid, {FOLDED} AS words FROM d),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {FOLDED} AS words FROM (SELECT item_id, coalesce(text, '') AS t FROM benchmark)),
windows AS MATERIALIZED (
  SELECT DISTINCT item, size, array_to_string(words[i:i + size - 1], ' ') AS said
  FROM (SELECT item, words, least(10, len(words)) AS size, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS i FROM b WHERE len(words) > 0)),
grams AS (
  SELECT rid, i, size, array_to_string(words[i:i + size - 1], ' ') AS said
  FROM (SELECT rid, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM w, (SELECT DISTINCT size FROM windows))),
hits AS MATERIALIZED (SELECT DISTINCT rid, i, item, windows.size AS size FROM grams JOIN windows ON grams.said = windows.said AND grams.size = windows.size),
per AS (SELECT rid, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM hits GROUP BY rid),
places AS (SELECT rid, count(DISTINCT spot) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS spot FROM hits) GROUP BY rid),
long_ones AS MATERIALIZED (SELECT said, list(item) AS items, row_number() OVER () AS win FROM windows WHERE size > 8 GROUP BY said),
terms AS MATERIALIZED (SELECT win, word, shift FROM (
  SELECT win, unnest(string_split(said, ' ')) AS word, unnest(range(0, len(string_split(said, ' ')))) AS shift FROM long_ones)),
p AS MATERIALIZED (SELECT rid, unnest(words) AS word, unnest(range(0, len(words))) AS pos FROM w),
b_words AS MATERIALIZED (SELECT p.* FROM p SEMI JOIN terms USING (word)),
ranked AS (
  SELECT win, word, shift, row_number() OVER (PARTITION BY win ORDER BY n, shift) AS r
  FROM terms JOIN (SELECT word, count(*) AS n FROM b_words GROUP BY word) USING (word)),
starts AS MATERIALIZED (
  SELECT win, r, rid, pos - shift AS s FROM ranked JOIN b_words USING (word) WHERE r <= 2),
two AS (SELECT win, count(*) AS lists FROM ranked WHERE r <= 2 GROUP BY win),
agreed AS MATERIALIZED (
  SELECT a.win, a.rid, a.s FROM starts a JOIN two USING (win) WHERE a.r = 1 AND lists = 1
  UNION SELECT a.win, a.rid, a.s FROM starts a JOIN starts b ON a.win = b.win AND a.rid = b.rid AND b.s BETWEEN a.s - 4 AND a.s + 4
    WHERE a.r = 1 AND b.r = 2),
sizes AS (SELECT win, count(*) AS size FROM terms GROUP BY win),
around AS (
  SELECT g.win, g.rid, g.s, word, count(*) AS n FROM agreed g JOIN sizes USING (win)
  JOIN b_words ON b_words.rid = g.rid AND b_words.pos >= g.s - 4 AND b_words.pos < g.s + size + 4 GROUP BY ALL),
near AS (
  SELECT DISTINCT win, rid FROM (
    SELECT win, rid, s FROM around JOIN (SELECT win, word, count(*) AS has FROM terms GROUP BY ALL) USING (win, word)
    GROUP BY win, rid, s HAVING sum(least(n, has)) >= 8)),
near_items AS (
  SELECT rid, item FROM (SELECT DISTINCT rid, unnest(items) AS item FROM near JOIN long_ones USING (win)) ANTI JOIN hits USING (rid, item)),
nears AS (SELECT rid, count(*) AS n_near, array_to_string(list_sort(list(item)), ',') AS items FROM near_items GROUP BY rid)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(per.items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(n_near, 0) AS n_near, sha256(coalesce(nears.items, '')) AS near_items_sha256
FROM d JOIN w USING (rid) LEFT JOIN per USING (rid) LEFT JOIN places USING (rid) LEFT JOIN nears USING (rid)"""

CHATS = """
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
told AS (SELECT *, replace(text, '<|', '<||') AS escaped, replace(replace(role, '<|', '<||'), chr(10), '<|line_end|>') AS head FROM said),
learnt AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, escaped) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, escaped) FILTER (role = 'assistant'), '') AS learned,
    sum(length('<|im_start|>') + length(head) + 1 + length(escaped) + length('<|im_end|>') + 1) AS formatted_chars
  FROM told GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars, 0::BIGINT AS expanded_tokens
FROM learnt"""


def _quality() -> str:
    values, fits = [], []
    for name, (top, bottom, scale, above, below) in quality_rules.MEASURES.items():
        values.append(f"SELECT rid, '{name}' AS measure, CASE WHEN {bottom} > 0 THEN {top} * {scale} // {bottom} ELSE 0 END AS value FROM c")
        low = f"least(q1 - {quality_rules.FENCE} * (q3 - q1), q2 - {below})" if below else "-1"
        fits.append(f"measure <> '{name}' OR (value <= greatest(q3 + {quality_rules.FENCE} * (q3 - q1), q2 + {above}) AND value >= {low})")
    levels = {"own": ("lang", "source"), "lng": ("lang",), "every": ()}
    quantiles, joins, use = [], [], []
    for level, keys in levels.items():
        group = "".join(f"{k}, " for k in keys)
        quantiles.append(
            f"""{level} AS (SELECT {group}measure, max(n) AS n, min(bucket) FILTER (upto * 4 >= n) AS q1,
              min(bucket) FILTER (upto * 4 >= n * 2) AS q2, min(bucket) FILTER (upto * 4 >= n * 3) AS q3
            FROM (SELECT {group}measure, bucket, count(*) OVER (PARTITION BY {group}measure ORDER BY bucket) AS upto,
              count(*) OVER (PARTITION BY {group}measure) AS n FROM m WHERE NOT base_failed) GROUP BY {group}measure)"""
        )
        same = " AND ".join([f"m.measure = {level}.measure", *[f"m.{k} IS NOT DISTINCT FROM {level}.{k}" for k in keys]])
        joins.append(f"LEFT JOIN {level} ON {same}")
    for q in ("q1", "q2", "q3"):
        least = quality_rules.LEAST_TEXTS
        use.append(f"CASE WHEN own.n >= {least} THEN own.{q} WHEN lng.n >= {least} THEN lng.{q} ELSE every.{q} END AS {q}")
    return rf"""
WITH {DOCS}, w AS MATERIALIZED (
  SELECT rid, t, {SPACED} AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
pw AS (SELECT rid, unnest(words) AS word, unnest(range(0, len(words))) AS i FROM w),
grams AS (
  SELECT rid, i, word || ' ' || lead(word, 1) OVER v || ' ' || lead(word, 2) OVER v || ' ' || lead(word, 3) OVER v
    || ' ' || lead(word, 4) OVER v AS gram FROM pw WINDOW v AS (PARTITION BY rid ORDER BY i)),
windows AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS often FROM grams WHERE gram IS NOT NULL),
repeats AS (SELECT rid, count(DISTINCT spot) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS spot FROM windows WHERE often > 1) GROUP BY rid),
c AS MATERIALIZED (
  SELECT rid, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words
  FROM w LEFT JOIN repeats USING (rid)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
vals AS ({' UNION ALL '.join(values)}),
m AS MATERIALIZED (
  SELECT rid, lang, source, measure, value, base_failed,
    (value >> greatest(length(bin(value)) - 6, 0)::BIGINT) << greatest(length(bin(value)) - 6, 0)::BIGINT AS bucket
  FROM vals JOIN f USING (rid) JOIN d USING (rid)),
{', '.join(quantiles)},
bounds AS (SELECT m.rid, m.measure, m.value, {', '.join(use)} FROM m {' '.join(joins)}),
verdict AS (SELECT rid, bool_and(coalesce({' AND '.join(f'({x})' for x in fits)}, true)) AS fits FROM bounds GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND fits AS kept
FROM d JOIN f USING (rid) JOIN verdict USING (rid)"""


MIX = rf"""
WITH {DOCS}, s AS MATERIALIZED (
  SELECT rid, doc_id, source, len({SPACED}) AS size,
    CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), t)), 1, 15) AS BIGINT) AS h FROM d),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
weighted AS (SELECT *, [1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM per),
filled AS (
  SELECT *, 3 * source_size AS most, CAST(3 * source_size AS DOUBLE) / weight AS level,
    CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
    CAST(sum(weight) OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS free
  FROM weighted),
split AS (SELECT *, most * free <= weight * rest AS fills FROM filled),
open_ AS (SELECT rest AS rest1, free AS free1 FROM split WHERE NOT fills ORDER BY level, source NULLS LAST LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN fills THEN CAST(most AS DOUBLE) ELSE CAST(rest1 AS DOUBLE) * weight / free1 END AS target
  FROM split LEFT JOIN open_ ON true),
timed AS (
  SELECT rid, doc_id, s.source, size, h, source_size, target,
    CAST(sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id NULLS FIRST, size, rid ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM s JOIN targets ON s.source IS NOT DISTINCT FROM targets.source),
queue AS (
  SELECT rid, size, pass, sum(size) OVER (ORDER BY CAST(pass * source_size + upto AS DOUBLE) / target, source NULLS LAST, pass, h,
    doc_id NULLS FIRST, size) AS used
  FROM timed, range(3) AS passes(pass) WHERE size > 0),
copies AS (SELECT rid, count(*) AS n FROM queue WHERE used <= (SELECT sum(size) FROM s) GROUP BY rid)
SELECT doc_id, size, source_size, target, size * coalesce(n, 0) AS taken FROM timed LEFT JOIN copies USING (rid)"""


PHRASES = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
starts AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
grams AS (SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase FROM starts, range(1, 6) AS sizes(k) WHERE i + k - 1 <= len(ws)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 100),
inside AS (
  SELECT DISTINCT s.lang, s.phrase FROM c AS s JOIN c AS t ON s.lang = t.lang AND t.k > s.k AND t.f >= s.f
    AND contains(' ' || t.phrase || ' ', ' ' || s.phrase || ' ')),
kept AS (SELECT * FROM c ANTI JOIN inside USING (lang, phrase)),
cuts AS (SELECT lang, phrase, f AS a, cut, array_to_string(ws[:cut], ' ') AS x, array_to_string(ws[cut + 1 :], ' ') AS y FROM kept, range(1, 5) AS cs(cut) WHERE cut < k),
scores AS (
  SELECT cuts.lang, cuts.phrase, a, cut, fx.f AS l, fy.f AS r, n, ((1000::HUGEINT * a * n) // (fx.f::HUGEINT * fy.f))::BIGINT AS score
  FROM cuts JOIN f AS fx ON fx.lang = cuts.lang AND fx.phrase = x JOIN f AS fy ON fy.lang = cuts.lang AND fy.phrase = y
    JOIN totals ON totals.lang = cuts.lang),
weakest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM weakest QUALIFY rank <= 2000"""


def _field(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE octet_length(encode(CAST({column} AS VARCHAR))) || ':' || {column} END"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


def _tree(name: str, source: str) -> str:
    """Levels of the trees over ``source`` (tree, pos, node, n): runs of two become their digest while there is more than one."""
    return f"""{name} AS (
  SELECT tree, 0 AS level, pos, node, n FROM {source}
  UNION ALL
  SELECT tree, level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (n + 1) // 2 FROM {name} WHERE n > 1 GROUP BY tree, level, pos // 2, n)"""


MANIFEST = rf"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list_transform(range(256), lambda b: list_reduce([b] || range(8),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
d AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf('n_chars')} AS leaf, {_leaf('(n_chars + 1)')} AS other, n_chars IS NOT NULL AND
    xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0 AS struck
  FROM documents, crc),
leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n, leaf AS node FROM d),
{_tree('low', 'leaves')},
tops AS MATERIALIZED (
  SELECT tree AS group_, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, node, '' AS tree FROM low WHERE n = 1),
{_tree('high', 'tops')},
ends AS (SELECT node AS root FROM high WHERE n = 1),
folds AS (
  SELECT tree, pos AS first, 0 AS step, pos, n, node, CASE WHEN struck THEN other ELSE leaf END AS h, FALSE AS up, '' AS proof FROM leaves
  UNION ALL
  SELECT f.tree, first, step + 1, CASE WHEN f.n > 1 THEN f.pos // 2 ELSE t.pos END, CASE WHEN f.n > 1 THEN (f.n + 1) // 2 ELSE t.n END, f.node,
    CASE WHEN f.n = 1 THEN h WHEN f.pos % 2 = 0 THEN sha256(h || coalesce(s.node, '')) ELSE sha256(s.node || h) END,
    up OR f.n = 1, proof || CASE WHEN f.n = 1 THEN '' ELSE coalesce(s.node, '') END
  FROM folds AS f LEFT JOIN tops AS t ON t.group_ = f.tree
  LEFT JOIN (SELECT FALSE AS high_, * FROM low UNION ALL SELECT TRUE, * FROM high) AS s
    ON s.high_ = up AND s.tree = CASE WHEN up THEN '' ELSE f.tree END AND s.n = f.n AND f.n > 1 AND s.pos = xor(f.pos, 1)
  WHERE f.n > 1 OR NOT up),
done AS (SELECT * FROM folds WHERE up AND n = 1)
SELECT doc_id, leaf, tops.node AS subroot, root, sha256(done.proof) AS proof_sha256, done.h AS folded_root, done.h = root AS verified
FROM leaves JOIN done ON done.tree = leaves.tree AND done.first = leaves.pos JOIN tops ON tops.group_ = leaves.tree, ends"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secret_scans": _secrets(),
        "op2_license_scans": _licences(),
        "op3_decontamination": CONTAMINATION,
        "op4_chat_formatting": CHATS,
        "op5_quality_rules": _quality(),
        "op9_source_mixing": MIX,
        "op11_phrase_collocations": PHRASES,
        "op13_merkle_manifest": MANIFEST,
    }
