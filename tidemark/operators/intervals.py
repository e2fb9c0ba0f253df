"""Which periods overlap, by an equi-join on time buckets.

A period of up to 2^k days lies in at most two buckets of 2^k days. It is filed in
those of its own level, and in those of coarser levels that periods of the other
side have. Two periods that overlap share the bucket in which their common days
begin, at the coarser of their levels, so each pair is found exactly once and no
side is compared with all of the other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Span = tuple[str, str]


def level(start: Column, end: Column) -> Column:
    """The smallest k for which the period has at most 2^k days; NULL if it has none or no bounds."""
    days = F.datediff(end, start) + 1
    return F.when(days >= 1, F.ceil(F.log2(days.cast("double"))).cast("int"))


def _bucket(day: Column, k: Column) -> Column:
    return F.floor(F.unix_date(day) / F.pow(F.lit(2.0), k)).cast("int")


def _levels(rows: DataFrame, span: Span) -> list[int]:
    """Levels that occur: thirty or fewer numbers."""
    return sorted(r[0] for r in rows.select(level(F.col(span[0]), F.col(span[1])).alias("k")).where("k IS NOT NULL").distinct().collect())


def filed(rows: DataFrame, span: Span, other: Sequence[int], own: str) -> DataFrame:
    """The rows once per bucket that they are found in: at their own level and at the coarser ones among ``other``."""
    start, end = F.col(span[0]), F.col(span[1])
    k = level(start, end)
    coarser = F.filter(F.array(*[F.lit(n) for n in other]).cast("array<int>"), lambda n: n > F.col(own))
    placed = rows.withColumn(own, k).where(F.col(own).isNotNull()).withColumn("_level", F.explode(F.concat(F.array(F.col(own)), coarser)))
    return placed.withColumn("_bucket", F.explode(F.sequence(_bucket(start, F.col("_level")), _bucket(end, F.col("_level")))))


def overlap_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_span: Span, right_span: Span) -> DataFrame:
    """Pairs of rows that agree in ``on`` and whose periods share a day. The span columns must differ in name.

    Rows without both bounds, or that end before they start, overlap nothing.
    """
    a = filed(left, left_span, _levels(right, right_span), "_left")
    b = filed(right, right_span, _levels(left, left_span), "_right")
    met = a.join(b, [*on, "_level", "_bucket"])
    begin = F.greatest(F.col(left_span[0]), F.col(right_span[0]))
    once = (F.col("_level") == F.greatest("_left", "_right")) & (F.col("_bucket") == _bucket(begin, F.col("_level")))
    shared = (F.col(left_span[0]) <= F.col(right_span[1])) & (F.col(right_span[0]) <= F.col(left_span[1]))
    return met.where(once & shared).drop("_level", "_bucket", "_left", "_right")
