"""Commit-history analytics as Spark DataFrames."""

from branchlore.config import BuildConfig, Filters
from branchlore.session import configure, new_session

__all__ = ["BuildConfig", "Filters", "configure", "new_session"]
