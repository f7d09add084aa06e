"""Secrets in texts, found through a trigram inverted index.

Every rule's regular expression is turned into a Boolean query over trigrams that any match
must contain, an OR of ANDs.  The index lists, for each trigram that some query names, the texts
that hold it.  Lists of one AND are intersected by counting, the ORs united, and only the texts
left are verified with the expression itself.  Rules whose expression demands no trigram are
run over all texts.
"""

from __future__ import annotations

import re._constants as ops
import re._parser as expressions
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from branchlore.llm.common import kept_columns, row_key, whole
from branchlore.staging import stage

KEY = "secret_scan_row_key"
MARK = "[SECRET]"
MOST_STRINGS = 64  # exact strings followed at once; beyond it a rule is merely less selective
MOST_CHOICES = 16  # characters of a class that are told apart


@dataclass(frozen=True)
class Rule:
    """``pattern`` matches from left to right; matches whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    possessive: str = ""  # the same matches with loops that Java runs without a stack

    @property
    def java(self) -> str:
        return self.possessive or self.pattern


# A key's header, with its body and END line where these follow; a body has no two dashes in a row.
KEY_BLOCK = r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[^-]|-[^-])*{}-----END [A-Z ]*PRIVATE KEY-----)?"
# The first three kinds are given, the others are formats of public services.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
RULES = (
    *BASE_RULES,
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]+"),
    Rule("private_key", KEY_BLOCK.format(""), possessive=KEY_BLOCK.format("+")),
    Rule("url_login", r"://[A-Za-z0-9._-]+:[A-Za-z0-9._-]{6,}@"),
)

Query = frozenset[frozenset[str]]
ALWAYS: Query = frozenset([frozenset()])


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _either(queries: Iterable[Query]) -> Query:
    """The ORs united; an AND that demands more than another is not needed."""
    terms = set().union(*queries)
    return frozenset(t for t in terms if not any(o < t for o in terms))


def _both(a: Query, b: Query) -> Query:
    return _either([frozenset(x | y for x, y in product(a, b))])


def _characters(items: list) -> set[str] | None:
    found: set[str] = set()
    for op, value in items:
        if op is ops.LITERAL:
            found.add(chr(value).lower())
        elif op is ops.RANGE and value[1] - value[0] < MOST_CHOICES:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= MOST_CHOICES else None


def _derive(parsed) -> tuple[set[str] | None, Query]:
    """All strings the expression matches (small letters), if few, and the query any match fulfils."""
    strings, query, exact = {""}, ALWAYS, True

    def close() -> None:
        nonlocal strings, query, exact
        query = _both(query, _either([frozenset(_trigrams(s) for s in strings)]))
        strings, exact = {""}, False

    def follow(more: set[str]) -> None:
        nonlocal strings
        if len(strings) * len(more) > MOST_STRINGS:
            close()
        if len(more) <= MOST_STRINGS:
            strings = {a + b for a, b in product(strings, more)}

    for op, value in parsed:
        if op is ops.LITERAL:
            follow({chr(value).lower()})
        elif op is ops.IN and (few := _characters(value)) is not None:
            follow(few)
        elif op is ops.SUBPATTERN or op is ops.BRANCH:
            parts = [_derive(p) for p in (value[1] if op is ops.BRANCH else [value[-1]])]
            if all(s is not None for s, _ in parts):
                follow(set().union(*(s for s, _ in parts)))
            else:
                close()
                query = _both(query, _either([q for _, q in parts]))
        elif op is ops.MAX_REPEAT or op is ops.MIN_REPEAT:
            least, most, inner = value
            some, demanded = _derive(inner)
            if some is not None and (least, most) == (0, 1):
                follow(some | {""})
            elif some is not None and least <= 3:
                for _ in range(least):
                    follow(some)
                if most != least:
                    close()
            else:
                close()
                if least:
                    query = _both(query, demanded)
        elif op is not ops.AT:
            close()
    if not exact:
        close()
        return None, query
    return strings, _either([frozenset(_trigrams(s) for s in strings)])


def trigram_query(pattern: str) -> Query | None:
    """The OR of ANDs of small-letter trigrams that a text matching ``pattern`` has; None if it demands none."""
    _, query = _derive(expressions.parse(pattern))
    return None if frozenset() in query else query


def _texts(docs: DataFrame) -> DataFrame:
    rows = kept_columns(docs, "doc_id", "text")
    return rows.select("doc_id", row_key(rows, "doc_id", "text").alias(KEY), whole("text").alias("text"))


def postings(texts: DataFrame, queries: Iterable[Query]) -> DataFrame:
    """The index: ``trigram``, ``doc`` (row key), for the trigrams that the queries name."""
    named = sorted(set().union(*(t for q in queries for t in q)))
    held = F.filter(F.array(*map(F.lit, named)), lambda t: F.contains(F.col("small"), t))
    return texts.select(F.col(KEY).alias("doc"), F.lower("text").alias("small")).select("doc", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """Which rules a text may match: ``doc``, ``kinds``."""
    spark = index.sparkSession
    rows = [
        F.struct(F.lit(kind).alias("kind"), F.lit(n).alias("term"), F.lit(trigram).alias("trigram"), F.lit(len(term)).alias("demanded"))
        for kind, query in queries.items()
        for n, term in enumerate(sorted(query, key=sorted))
        for trigram in sorted(term)
    ]
    terms = spark.range(1).select(F.inline(F.array(*rows)))
    met = index.join(F.broadcast(terms), "trigram").groupBy("doc", "kind", "term")  # the rules' own trigrams: a few dozen rows
    whole_terms = met.agg(F.count_distinct("trigram").alias("n"), F.first("demanded").alias("demanded")).where("n = demanded")
    return whole_terms.groupBy("doc").agg(F.collect_set("kind").alias("kinds"))


SPANS = "array<struct<start:int,end:int>>"


def _rule_spans(text: Column, rule: Rule) -> Column:
    """Start and end, in code points, of the rule's matches: the pieces between matches tell where these lie."""
    pattern = F.lit(rule.java)
    parts = F.arrays_zip(
        F.split(text, rule.java, -1).alias("between"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("match"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("value"),
    )

    def add(state: Column, part: Column) -> Column:
        start = state["at"] + F.char_length(part["between"])
        end = start + F.char_length(part["match"])
        longer = F.array_append(state["spans"], F.struct(start.alias("start"), end.alias("end")))
        spans = F.when(F.char_length(part["value"]) >= rule.least, longer).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.cast(SPANS).alias("spans"))

    # the piece after the last match has none
    matched = F.filter(parts, lambda p: p["match"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))
    found = F.aggregate(matched, start, add, lambda state: state["spans"])
    return F.when(text.rlike(rule.java), found).otherwise(F.array().cast(SPANS))


def _named(spans: Column, rank: int, kind: str) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")),
    )


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document row ``doc_id``, ``text``, the row key and ``spans``: (``start``, ``rank``, ``end``, ``kind``) by start and rule.

    Missing texts are empty and have no spans; spans of different rules may overlap; repeated
    rows stay, each with its spans; an empty table gives none; other columns are not looked at.
    """
    return found_in(_texts(docs), F.col("text"), rules).select("doc_id", KEY, "text", "spans")


def found_in(rows: DataFrame, text: Column, rules: tuple[Rule, ...]) -> DataFrame:
    """Rows that have the row key ``KEY``, with the ``spans`` of their text."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    if queries:
        index = stage(postings(rows.select(KEY, text.alias("text")), queries.values()), "secret-trigrams")
        may = candidates(index, queries).withColumnRenamed("doc", KEY)
        rows = rows.join(may, KEY, "left")
    else:
        rows = rows.withColumn("kinds", F.lit(None).cast("array<string>"))
    spans = []
    for rank, rule in enumerate(rules):
        found = _rule_spans(text, rule)
        if rule.kind in queries:
            asked = F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False))
            found = F.when(asked, found).otherwise(F.array().cast(SPANS))
        spans.append(_named(found, rank, rule.kind))
    return rows.withColumn("spans", F.array_sort(F.concat(*spans))).drop("kinds")


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secrets(docs: DataFrame) -> DataFrame:
    """The digest per document: counts of the base kinds, a hash of their spans, and all spans."""
    kinds = [r.kind for r in BASE_RULES]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return scan(docs).select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in kinds],
        F.sha2(listed(F.filter("spans", lambda s: s["rank"] < len(kinds))), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span, or run of overlapping spans, replaced by a mark."""
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def add(s: Column, span: Column) -> Column:
        between = F.substring(text, s["at"] + 1, span["start"] - s["at"])
        longer = F.concat(s["out"], F.array(between, F.lit(MARK)))
        return F.struct(
            F.greatest(s["at"], span["end"]).alias("at"),
            F.when(span["start"] >= s["at"], longer).otherwise(s["out"]).alias("out"),
        )

    def close(s: Column) -> Column:
        return F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.char_length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, state, add, close))


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with their secrets replaced by marks and ``n_chars``, if there, counted anew.

    Each row is searched and marked where it lies.  All rows and columns stay, whatever their
    names; a missing text stays missing and an empty one empty; texts of any length are searched
    whole; equal rows are marked alike; an empty table gives none.
    """
    rows = docs.select(F.struct("*").alias("doc"), row_key(docs, "doc_id", "text").alias(KEY))
    found = found_in(rows, whole(F.col("doc.text")), rules)
    text, some = F.col("doc.text"), F.size("spans") > 0
    made = {"text": F.when(some, redacted(text, F.col("spans"))).otherwise(text)}
    if "n_chars" in docs.columns:
        counted = F.char_length(made["text"]).cast(docs.schema["n_chars"].dataType)
        made["n_chars"] = F.when(some, counted).otherwise(F.col("doc.n_chars"))
    return found.select(*[made[c].alias(c) if c in made else F.col("doc")[c].alias(c) for c in docs.columns])
