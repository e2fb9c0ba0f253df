"""Two-period comparison from daily parts: deltas, significance, persistence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import days_inclusive
from ..functions.numbers import round_half_up
from ..functions.stats import poisson_rate_z, two_proportion_z, welch
from .metrics import PARTS, denominator, last_value, metric_value, missing_values, numerator, sample


def label_windows(rows: DataFrame, before: tuple[str, str], after: tuple[str, str]) -> DataFrame:
    """Rows of two fixed windows with the window's name and bounds; windows must not overlap."""
    bounds = [[F.lit(day).cast("date") for day in window] for window in (before, after)]
    in_before, in_after = (F.col("date").between(*pair) for pair in bounds)
    return rows.where(in_before | in_after).withColumns(
        {
            "label": F.when(in_before, "before").otherwise("after"),
            "before_days": days_inclusive(*bounds[0]),
            "after_days": days_inclusive(*bounds[1]),
        }
    )


def compare_periods(parts: DataFrame, keys: Sequence[str], mapping: Sequence[str] = ("aggregation", "scale", "kind")) -> DataFrame:
    """One row per key from labelled daily parts.

    ``parts`` has keys, mapping columns, ``label`` (before or after),
    ``before_days``, ``after_days``, ``overdispersion``, ``date`` and the parts.
    They are read once and shuffled once by key: a window numbers the after
    days, and one aggregation gives both sides and both halves. The middle
    day opens the second half.
    """
    carried = [*keys, *mapping, "before_days", "after_days", "overdispersion"]
    after_day = F.when(F.col("label") == "after", F.col("date"))
    by_key = Window.partitionBy(*carried)
    seen = F.count(after_day).over(by_key.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    total = F.count(after_day).over(by_key)
    half = F.when(after_day.isNotNull(), F.when(seen <= F.floor(total / 2), 1).otherwise(2))
    daily = F.when(F.col("date").isNotNull(), metric_value())
    numbered = parts.withColumns({"_half": half, "_day": daily})
    picks = {
        "before_": F.col("label") == "before", "after_": F.col("label") == "after", "h1_": F.col("_half") == 1, "h2_": F.col("_half") == 2,
    }
    summed = numbered.groupBy(*carried).agg(
        *[F.sum(F.when(where, F.col(name))).alias(side + name) for side, where in picks.items() for name in PARTS],
        *[last_value(where).alias(side + "last") for side, where in picks.items()],
        *[F.count(F.when(where, F.col("date"))).alias(side + "distinct_dates") for side, where in picks.items()],
        *[
            agg(F.when(picks[side], F.col("_day"))).alias(side + name)
            for side in ("before_", "after_")
            for name, agg in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))
        ],
    )
    sides = [
        value.alias(side + name)
        for side in ("before_", "after_")
        for name, value in (
            ("value", metric_value(side)), ("sample", sample(side)), ("numerator", numerator(side)), ("denominator", denominator(side)),
            ("row_count", F.col(side + "rows")), ("distinct_dates", F.col(side + "distinct_dates")), ("missing_values", missing_values(side)),
            ("n", F.col(side + "n")), ("mean", F.col(side + "mean")), ("var", F.col(side + "var")),
        )
    ]
    halves = [
        F.when(F.col("aggregation") == "sum", F.coalesce(metric_value(h), F.lit(0.0)) / F.nullif(F.col(h + "distinct_dates"), F.lit(0)))
        .otherwise(metric_value(h))
        .alias(name)
        for h, name in (("h1_", "first_half"), ("h2_", "second_half"))
    ]
    return finish_comparison(summed.select(*carried, *sides, *halves, F.col("after_distinct_dates").alias("dated_days")), keys)


def significance(aggregation: Column) -> tuple[Column, Column]:
    """(method, statistic): daily Welch, else two proportions, else Poisson rates, else none."""
    c = F.col
    daily = (c("before_n") >= 7) & (c("after_n") >= 7)
    rates = (
        (aggregation == "ratio_of_sums")
        & (c("before_denominator") > 0)
        & (c("after_denominator") > 0)
        & (c("before_numerator") <= c("before_denominator"))
        & (c("after_numerator") <= c("after_denominator"))
    )
    counts = (aggregation == "sum") & c("before_value").isNotNull() & c("after_value").isNotNull()
    method = F.when(daily, "welch_daily").when(rates, "two_proportion").when(counts, "poisson_rate").otherwise("none")
    statistic = (
        F.when(daily, welch(c("before_mean"), c("before_var"), c("before_n"), c("after_mean"), c("after_var"), c("after_n")))
        .when(
            rates,
            two_proportion_z(c("before_numerator"), c("before_denominator"), c("after_numerator"), c("after_denominator"), c("overdispersion")),
        )
        .when(counts, poisson_rate_z(c("before_value"), c("before_days"), c("after_value"), c("after_days"), c("overdispersion")))
    )
    return method, round_half_up(statistic, 3)


def finish_comparison(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Deltas, significance and persistence from one row per key with both sides."""
    c = F.col
    per_day = (c("aggregation") == "sum") & (c("before_days") != c("after_days"))
    before = F.when(per_day, c("before_value") / c("before_days")).otherwise(c("before_value"))
    after = F.when(per_day, c("after_value") / c("after_days")).otherwise(c("after_value"))
    compared = wide.withColumns({"_b": before, "_a": after})
    method, statistic = significance(c("aggregation"))
    base = F.when(c("aggregation") == "sum", c("before_value") / c("before_days")).otherwise(c("before_value"))
    checked = (F.coalesce(c("dated_days"), F.lit(0)) >= 14) & base.isNotNull()
    first, second = c("first_half") - base, c("second_half") - base
    same = F.coalesce((first != 0) & (F.signum(first) == F.signum(second)), F.lit(False))
    sides = [
        column
        for side in ("before", "after")
        for column in (
            round_half_up(c(f"{side}_value")).alias(f"{side}_value"),
            round_half_up(c("_b" if side == "before" else "_a")).alias(f"{side}_comparable"),
            round_half_up(c(f"{side}_sample"), 2).alias(f"{side}_sample"),
            F.coalesce(c(f"{side}_row_count"), F.lit(0)).alias(f"{side}_rows"),
            F.coalesce(c(f"{side}_distinct_dates"), F.lit(0)).alias(f"{side}_dates"),
            F.coalesce(c(f"{side}_missing_values"), F.lit(0)).alias(f"{side}_missing"),
        )
    ]
    delta_pct = F.when(c("_b") != 0, round_half_up((c("_a") - c("_b")) / F.abs(c("_b")) * 100, 2))
    return compared.select(
        *keys,
        "aggregation",
        "before_days",
        "after_days",
        F.when(per_day, "per_day").otherwise("total").alias("basis"),
        *sides,
        round_half_up(c("_a") - c("_b")).alias("delta_abs"),
        delta_pct.alias("delta_pct"),
        method.alias("method"),
        statistic.alias("statistic"),
        checked.alias("persistence_checked"),
        F.when(checked, same).alias("persistent"),
        F.when(checked, round_half_up(c("first_half"))).alias("first_half_value"),
        F.when(checked, round_half_up(c("second_half"))).alias("second_half_value"),
    )
