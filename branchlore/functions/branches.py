"""Column functions over branch names and branch lists."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from branchlore.config import SUFFIX_LENGTH


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def ascii_lower(value: Column | str) -> Column:
    """Fold A-Z only, whatever the JVM locale."""
    return F.translate(as_column(value), string.ascii_uppercase, string.ascii_lowercase)


def branch_suffix(branch: Column | str) -> Column:
    """Relation suffix: lower case, non-alphanumerics to ``_``, 40 characters, ``head`` when empty."""
    lowered = ascii_lower(F.coalesce(as_column(branch), F.lit("")))
    cut = F.substring(F.regexp_replace(lowered, "[^a-z0-9]", "_"), 1, SUFFIX_LENGTH)
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("head"))


def branch_list(csv: Column | str, root: Column | str) -> Column:
    """Comma list to array: trimmed, blanks dropped, root first, first occurrence kept."""

    def trimmed(value: Column) -> Column:
        return F.regexp_replace(value, r"^\s+|\s+$", "")

    items = F.transform(F.split(F.coalesce(as_column(csv), F.lit("")), ","), trimmed)
    named = F.filter(items, lambda item: item != "")
    return F.array_distinct(F.concat(F.array(trimmed(as_column(root))), named))


def join_list(branches: Column | str) -> Column:
    return F.array_join(as_column(branches), ", ")


def suffix_of_relation(name: Column | str) -> Column:
    """``git_log_x`` to ``x``."""
    return F.regexp_replace(as_column(name), "^git_log_", "")


def root_first(branch: Column | str, root: str) -> Column:
    """0 for the root, 1 for any other branch."""
    return F.when(as_column(branch) == root, 0).otherwise(1)


def configured_position(branch: Column | str, branches: Sequence[str]) -> Column:
    """Zero-based index in the configured list, -1 when absent."""
    return F.array_position(F.lit(list(branches)), as_column(branch)) - 1


def short_label(branch: Column | str) -> Column:
    """First ``REL_`` to ``R``, first ``_STABLE`` removed."""
    # the anchor makes each replacement happen at most once
    shortened = F.regexp_replace(as_column(branch), r"(?s)^(.*?)REL_", "$1R")
    return F.regexp_replace(shortened, r"(?s)^(.*?)_STABLE", "$1")
