"""Dates, timestamps and periods; all in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_date(text: Column) -> Column:
    """DATE from the leading YYYY-MM-DD; an impossible date gives NULL."""
    return F.regexp_extract(F.trim(text.cast("string")), r"^(\d{4}-\d{2}-\d{2})", 1).try_cast("date")


def parse_timestamp(text: Column) -> Column:
    """TIMESTAMP; a missing zone is UTC, a bare date is midnight, "unknown" is NULL."""
    value = F.trim(text.cast("string"))
    return F.when(value != "unknown", value.try_cast("timestamp"))


def days_inclusive(start: Column, end: Column) -> Column:
    """Number of days in a period, both ends counted."""
    return F.datediff(end, start) + 1


def parse_period(text: Column) -> Column:
    """STRUCT<start, end> from the first and last date in the text, NULL if fewer than two."""
    found = F.regexp_extract_all(text, F.lit(r"(\d{4}-\d{2}-\d{2})"), F.lit(1))
    start = F.try_element_at(found, F.lit(1)).try_cast("date")
    end = F.try_element_at(found, F.lit(-1)).try_cast("date")
    return F.when((F.size(found) >= 2) & (start <= end), F.struct(start.alias("start"), end.alias("end")))


def trailing_windows(through: Column, days: Column | int) -> dict[str, Column]:
    """The N days ending at ``through``, the N days before, and both a year (364 days) earlier."""
    length = F.lit(days) if isinstance(days, int) else days
    after_start = F.date_sub(through, length - 1)
    before_start = F.date_sub(after_start, length)
    before_end = F.date_sub(after_start, F.lit(1))
    return {
        "before_start": before_start,
        "before_end": before_end,
        "after_start": after_start,
        "after_end": through,
    }


def year_earlier(date: Column) -> Column:
    """The same weekday 52 weeks earlier."""
    return F.date_sub(date, 364)


def year_over_year(after_start: Column, after_end: Column) -> dict[str, Column]:
    """Compare a window with the same window 52 weeks earlier."""
    return {
        "before_start": year_earlier(after_start),
        "before_end": year_earlier(after_end),
        "after_start": after_start,
        "after_end": after_end,
    }
