"""Number parsing and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(value: Column, digits: int = 4) -> Column:
    """Round half towards plus infinity, also for negatives; NaN gives NULL."""
    factor = float(10**digits)
    number = F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    return F.floor(number * F.lit(factor) + F.lit(0.5)) / F.lit(factor)


def finite(value: Column) -> Column:
    """NULL out NaN and the infinities."""
    number = value.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != F.lit(float("inf"))), number)


def parse_number(text: Column) -> Column:
    """Number from export text: blanks and commas dropped, one trailing % dropped."""
    cleaned = F.regexp_replace(F.trim(text.cast("string")), r"[\s,]", "")
    bare = F.regexp_replace(cleaned, "%$", "")
    # "1d" and "1f" are doubles to the JVM but not numbers in an export
    numeric = bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return finite(F.when(numeric, bare.try_cast("double")))


def ctr_fraction(text: Column) -> Column:
    """Click-through rate as a fraction: percentages and numbers above 1 are divided by 100."""
    number = parse_number(text)
    percent = F.trim(text.cast("string")).endswith("%") | (number > 1)
    return F.when(percent, number / 100).otherwise(number)


def position_or_null(text: Column) -> Column:
    """Rank position; blank, "-", ">100" and "not ..." mean not ranking."""
    value = F.lower(F.trim(text.cast("string")))
    absent = value.isin("", "-", "n/a", "null") | value.startswith(">") | value.contains("not")
    return F.when(~absent, parse_number(value))


def parse_flag(text: Column) -> Column:
    """Boolean from text; blank is unknown, anything but a yes-word is false."""
    value = F.trim(text.cast("string"))
    return F.when(F.length(text.cast("string")) > 0, F.lower(value).isin("true", "yes", "1", "y"))


def split_list(text: Column) -> Column:
    """Items separated by ``|`` or ``;``; blanks dropped, NULL gives an empty list."""
    items = F.transform(F.split(F.coalesce(text.cast("string"), F.lit("")), "[|;]"), lambda x: F.trim(x))
    return F.filter(items, lambda x: x != "")


def or_null(text: Column) -> Column:
    """Empty text counts as missing."""
    return F.when(text != "", text)
