"""Build options, explorer filters and the branch-name rules that work on plain lists."""

from __future__ import annotations

import datetime as dt
import re
import string
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

DEFAULT_ROOT = "master"
# The branch set imported when none is configured.
DEFAULT_BRANCHES = (
    "master",
    "REL_14_STABLE",
    "REL_15_STABLE",
    "REL_16_STABLE",
    "REL_17_STABLE",
    "REL_18_STABLE",
)

SUFFIX_LENGTH = 40
METRICS = ("commit_count", "total_insertions", "total_deletions", "total_changed_files")

_ASCII_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def suffix_of(branch: str | None) -> str:
    """Relation suffix of one branch name (the column form is ``functions.branches.branch_suffix``)."""
    lowered = (branch or "").translate(_ASCII_LOWER)
    return re.sub(r"[^a-z0-9]", "_", lowered)[:SUFFIX_LENGTH] or "head"


def normalize_branches(branches: str | Iterable[str] | None, root: str) -> tuple[str, ...]:
    """Root first, then the trimmed, non-blank names in first-occurrence order."""
    items = branches.split(",") if isinstance(branches, str) else list(branches or ())
    names = [root.strip(string.whitespace), *(item.strip(string.whitespace) for item in items)]
    return tuple(dict.fromkeys(name for name in names if name))


def join_branches(branches: Sequence[str]) -> str:
    return ", ".join(branches)


@dataclass(frozen=True)
class BuildConfig:
    """What to import and how; ``branches=None`` asks for discovery in the catalog."""

    root_branch: str = DEFAULT_ROOT
    branches: str | Sequence[str] | None = DEFAULT_BRANCHES
    schema: str | None = None
    include_diff: bool = True
    max_commits: int = 0
    repository_path: str = ""

    def __post_init__(self):
        root = self.root_branch.strip(string.whitespace) or DEFAULT_ROOT
        object.__setattr__(self, "root_branch", root)
        if self.branches is not None:
            object.__setattr__(self, "branches", normalize_branches(self.branches, root))
        if self.max_commits < 0:
            raise ValueError("max_commits must be 0 (unlimited) or positive")

    def preset(self, name: str) -> tuple[str, ...]:
        """Branches of a picker preset: ``all``, ``stable`` (all but root) or ``root``."""
        if name == "all":
            return tuple(self.branches)
        if name == "stable":
            return tuple(b for b in self.branches if b != self.root_branch)
        if name == "root":
            return (self.root_branch,)
        raise ValueError(f"unknown branch preset: {name!r}")


def _day(value: str | dt.date | None) -> dt.date | None:
    if value in (None, ""):
        return None
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(value)


@dataclass(frozen=True)
class Filters:
    """One explorer selection; all panels derive from it.

    Empty ``authors`` means no author filter.  Bounds are inclusive days.
    """

    branches: Sequence[str] = ()
    authors: Sequence[str] = ()
    start: str | dt.date | None = None
    end: str | dt.date | None = None
    metric: str = "commit_count"
    search: str = ""

    def __post_init__(self):
        object.__setattr__(self, "branches", tuple(dict.fromkeys(self.branches)))
        object.__setattr__(self, "authors", tuple(dict.fromkeys(self.authors)))
        object.__setattr__(self, "start", _day(self.start))
        object.__setattr__(self, "end", _day(self.end))
        if self.metric not in METRICS:
            raise ValueError(f"unknown metric: {self.metric!r}")

    def normalized(self, config: BuildConfig, moved: str = "start") -> Filters:
        """Empty branch set becomes the root; crossed bounds follow the one ``moved`` last."""
        branches = self.branches or (config.root_branch,)
        start, end = self.start, self.end
        if start and end and start > end:
            start, end = (start, start) if moved == "start" else (end, end)
        return replace(self, branches=branches, start=start, end=end)


def last_days(as_of: dt.datetime, days: int = 90) -> tuple[dt.datetime, dt.datetime]:
    """The relative dashboard range, from an explicit instant rather than the clock."""
    return as_of - dt.timedelta(days=days), as_of
