"""Trailers, people and URLs from commit messages, as Column expressions.

Everything here stays in generated code except ``unique_text_array`` and
``message_lines``, which work on one short array per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from branchlore.functions.branches import as_column
from branchlore.schema import FIELD_NAMES, PERSON_FIELDS

# Only LF ends a line here ((?d)); a CR belongs to the line end when LF follows it.
# (?i) folds ASCII letters only.
FIELD_PREFIX = r"(?mid)^"
FIELD_VALUE = r": *([^ \n](?:[^\n]*?[^ \n])?) *(?=\r\n|(?<!\r)\n|\z)"
URL_PATTERN = r'(https?://[^\s<>()"]+)'
TRAILER_LINE = r"(?mid)^(?:" + "|".join(FIELD_NAMES) + r"):[^\n]*\n?"

EMPTY_TEXTS = "array<string>"


def check_field(field: str) -> str:
    if field not in FIELD_NAMES:
        raise ValueError(f"unknown trailer field: {field!r}")
    return field


def field_pattern(field: str) -> str:
    return FIELD_PREFIX + check_field(field) + FIELD_VALUE


def extract_field(message: Column | str, field: str | None) -> Column:
    """Values of one trailer field in line order, space-trimmed; duplicates kept, blanks dropped."""
    if field is None:
        return F.array().cast(EMPTY_TEXTS)
    text = F.coalesce(as_column(message), F.lit(""))
    return F.regexp_extract_all(text, F.lit(field_pattern(field)), F.lit(1))


def trailer_lines(message: Column | str) -> Column:
    """The catalogued trailer lines of a message, with their line ends, as one short text.

    One pass over the body; the ten per-field patterns then read only what it kept,
    which gives the same values as reading the whole message ten times.
    """
    text = F.coalesce(as_column(message), F.lit(""))
    return F.array_join(F.regexp_extract_all(text, F.lit(TRAILER_LINE), F.lit(0)), "")


def message_lines(message: Column | str) -> Column:
    """Lines of a message; a lone CR stays inside its line."""
    return F.split(F.coalesce(as_column(message), F.lit("")), "\r?\n")


def unique_text_array(values: Column | str) -> Column:
    """Space-trimmed, NULL and blank dropped, first occurrence kept."""
    trimmed = F.transform(_texts(values), lambda value: F.trim(value))
    return F.array_distinct(F.filter(trimmed, lambda value: value != ""))


def extract_urls(values: Column | str) -> Column:
    """Distinct http(s) URLs of the values, in order of first appearance."""
    # a URL holds no white space, so a newline between values separates them safely
    joined = F.array_join(_texts(values), "\n")
    return F.array_distinct(F.regexp_extract_all(joined, F.lit(URL_PATTERN), F.lit(1)))


def is_person_trailer(field: Column | str) -> Column:
    return as_column(field).isin(*PERSON_FIELDS)


def trailer_category(field: Column | str) -> Column:
    return F.when(is_person_trailer(field), "person").otherwise("reference")


def _texts(values: Column | str) -> Column:
    return F.coalesce(as_column(values), F.array().cast(EMPTY_TEXTS))
