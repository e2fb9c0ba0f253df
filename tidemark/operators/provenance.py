"""Provenance and distinct counts without collected sets.

A request's pulls are summed up as a digest and a number. The pulls themselves
are listed once per distinct set, as rows that the digest names, so a million
requests over the same pulls share one list. Distinct values are counted exactly
by rows, or for any span of days from mergeable sketches kept per day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import row_hash
from .ledger import rows_digest

#: Registers of a sketch, as a power of two, and twice its relative standard error: 95 of 100 estimates are that near.
SKETCH_BITS = 12
SKETCH_ERROR = 2 * 1.04 / 2 ** (SKETCH_BITS / 2)


def member_sets(rows: DataFrame, keys: Sequence[str], member: str) -> tuple[DataFrame, DataFrame]:
    """(keys, set_id, n_members) of each group, and (set_id, member) of each distinct set; nulls are no members."""
    keys = list(keys)
    distinct = rows.where(F.col(member).isNotNull()).select(*keys, member).distinct()
    sets = rows_digest(distinct, keys, row_hash(F.col(member))).select(*keys, F.col("digest").alias("set_id"), F.col("rows").alias("n_members"))
    first = sets.groupBy("set_id").agg(F.min(F.struct(*keys)).alias("_first")).select("set_id", *[F.col(f"_first.{k}").alias(f"_{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return sets, distinct.join(first, same).select("set_id", member)


def day_sketches(rows: DataFrame, keys: Sequence[str], value: str, date: str = "date") -> DataFrame:
    """Per keys and day the exact number of distinct values, and a sketch that adds up over days."""
    held = rows.where(F.col(value).isNotNull()).groupBy(*keys, date, value).agg(F.count(F.lit(1)).alias("_n"))
    return held.groupBy(*keys, date).agg(F.count(F.lit(1)).alias("n_distinct"), F.hll_sketch_agg(value, SKETCH_BITS).alias("sketch"))


def sketched_distinct(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Estimated distinct values per keys over all days of the sketches, within ``SKETCH_ERROR`` of the truth in 95 of 100 cases."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def exact_distinct(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values per keys, counted as rows: no task holds a set."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_distinct"))
