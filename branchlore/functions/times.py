"""Days, epoch milliseconds, ISO text and display text, all in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from branchlore.functions.branches import as_column


def commit_day(author_date: Column | str = "author_date") -> Column:
    return F.to_date(as_column(author_date))


def day_to_iso(day: Column | str) -> Column:
    """A day as ``YYYY-MM-DDT00:00:00Z``."""
    return F.date_format(as_column(day), "yyyy-MM-dd'T'00:00:00'Z'")


def instant_to_iso(instant: Column | str) -> Column:
    """An instant as ``YYYY-MM-DDTHH:MM:SSZ``."""
    return F.date_format(as_column(instant), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def epoch_millis(instant: Column | str) -> Column:
    """Milliseconds since the epoch, half a millisecond rounding away from zero."""
    micros = F.unix_micros(as_column(instant).cast("timestamp"))
    half = F.when(micros < 0, F.lit(-500)).otherwise(F.lit(500))
    return F.call_function("div", micros + half, F.lit(1000))


def iso_day(iso_text: Column | str) -> Column:
    """The day of an ISO timestamp text."""
    return F.substring(as_column(iso_text), 1, 10)


def display_instant(instant: Column | str) -> Column:
    """``Jan 5, 2024, 3:07 PM``, or ``n/a``."""
    shown = F.date_format(as_column(instant), "MMM d, yyyy, h:mm a")
    return F.coalesce(shown, F.lit("n/a"))


def display_number(value: Column | str) -> Column:
    """Thousands separated by commas; NULL shows as 0."""
    return F.format_number(F.coalesce(as_column(value), F.lit(0)), 0)
