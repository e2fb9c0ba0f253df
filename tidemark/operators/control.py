"""Control pages, difference-in-differences, year-over-year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import days_inclusive, year_earlier
from ..functions.numbers import round_half_up
from ..functions.stats import welch
from ..functions.urls import market
from ..session import cut_lineage


def control_pages(
    page_days: DataFrame,
    requests: DataFrame,
    changed: DataFrame | None = None,
    prefixes: Sequence[str] = (),
    limit: int | None = None,
    planning: bool = False,
) -> DataFrame:
    """Untouched pages of the treated pages' markets with rows in both windows.

    ``page_days`` has source_id, page, date, impressions; ``requests`` has
    request_id, source_id, the four window dates and ``pages``; ``changed``
    has change_id, date and ``pages``. Windows shared by several requests are
    totalled once. ``planning`` needs before-window rows only. ``limit`` keeps the
    first pages by volume; without it all stay.
    """
    window = ["source_id", "before_start", "before_end", "after_start", "after_end"]
    asked = requests.select("request_id", *window, "pages")
    spans = asked.select(*window).distinct()
    daily = page_days.groupBy("source_id", "page", "date").agg(F.sum(F.coalesce("impressions", F.lit(0))).alias("impressions"))
    # a window becomes days, so that the facts meet it through an equi-join
    days = spans.select(*window, F.explode(F.sequence("before_start", "before_end")).alias("date"), F.lit("b").alias("side"))
    if not planning:
        days = days.unionByName(
            spans.select(*window, F.explode(F.sequence("after_start", "after_end")).alias("date"), F.lit("a").alias("side"))
        )
    seen = days.join(daily, ["source_id", "date"]).groupBy(*window, "page").agg(
        F.sum(F.when(F.col("side") == "b", F.col("impressions"))).alias("before_impressions"),
        F.count_if(F.col("side") == "a").alias("after_rows"),
    )
    present = seen.where(F.col("before_impressions").isNotNull() & (F.lit(planning) | (F.col("after_rows") > 0)))
    treated = asked.select("request_id", F.explode("pages").alias("page")).distinct()
    markets = asked.select("request_id", *window, F.explode(F.array_distinct(F.transform("pages", lambda p: market(p, prefixes)))).alias("market"))
    in_market = markets.join(present.withColumn("market", market(F.col("page"), prefixes)), [*window, "market"])
    free = in_market.join(treated, ["request_id", "page"], "left_anti")
    if changed is not None:
        # read twice below; the facts behind it are not
        free = cut_lineage(free)
        touched = changed.select("date", F.explode("pages").alias("page")).where(F.col("date").isNotNull()).distinct()
        end = F.col("before_end") if planning else F.col("after_end")
        hit = free.join(touched, "page").where(F.col("date").between(F.col("before_start"), end))
        free = free.join(hit.select("request_id", "page").distinct(), ["request_id", "page"], "left_anti")
    order = Window.partitionBy("request_id").orderBy(F.desc("before_impressions"), "page")
    ranked = free.withColumn("rank", F.row_number().over(order))
    if limit is not None:
        ranked = ranked.where(F.col("rank") <= limit)
    return ranked.select("request_id", "page", "market", "before_impressions", "rank")


def _half_stats(keys: Sequence[str]) -> list[Column]:
    sides = (("b", F.col("label") == "before"), ("a", F.col("label") == "after"), ("h1", F.col("_half") == 1), ("h2", F.col("_half") == 2))
    return [
        agg(F.when(where, F.col("diff"))).alias(f"{name}_{stat}")
        for name, where in sides
        for stat, agg in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))
    ]


def difference_in_differences(daily: DataFrame, keys: Sequence[str], index_mode: Column | bool = True) -> DataFrame:
    """Net effect per key from daily values of a treated and a control group.

    ``daily`` has keys, ``label`` (before, after), ``role`` (treated, control),
    date and value. In index mode each day is divided by its group's mean
    before day and the effect is in percent; otherwise levels are compared.
    """
    keys = list(keys)
    indexed = F.lit(index_mode) if isinstance(index_mode, bool) else index_mode
    daily = daily.withColumn("_indexed", indexed)
    paired = daily.groupBy(*keys, "_indexed", "label", "date").agg(
        F.max(F.when(F.col("role") == "treated", F.col("value"))).alias("t"), F.max(F.when(F.col("role") == "control", F.col("value"))).alias("c")
    )
    bases = paired.where(F.col("label") == "before").groupBy(*keys, "_indexed").agg(F.avg("t").alias("tb"), F.avg("c").alias("cb"))
    joined = paired.join(bases, [*keys, "_indexed"], "left").where(F.col("t").isNotNull() & F.col("c").isNotNull())
    diff = F.when(F.col("_indexed"), F.try_divide("t", "tb") - F.try_divide("c", "cb")).otherwise(F.col("t") - F.col("c"))
    order = Window.partitionBy(*keys, "label").orderBy("date")
    count = F.count(F.lit(1)).over(Window.partitionBy(*keys, "label"))
    half = F.when(F.col("label") == "before", F.when(F.row_number().over(order) <= F.floor(count / 2), 1).otherwise(2))
    stats = joined.withColumns({"diff": diff, "_half": half}).groupBy(*keys, "_indexed").agg(
        *_half_stats(keys), F.max("tb").alias("tb"), F.max("cb").alias("cb")
    )
    c = F.col
    volume = ~c("_indexed") | ((F.coalesce(c("tb"), F.lit(0.0)) != 0) & (F.coalesce(c("cb"), F.lit(0.0)) != 0))
    usable = volume & (c("b_n") >= 7) & (c("a_n") >= 7)
    effect = (c("a_mean") - c("b_mean")) * F.when(c("_indexed"), 100).otherwise(1)
    statistic = welch(c("b_mean"), c("b_var"), c("b_n"), c("a_mean"), c("a_var"), c("a_n"))
    trend = F.when(
        (c("h1_n") >= 3) & (c("h2_n") >= 3), welch(c("h1_mean"), c("h1_var"), c("h1_n"), c("h2_mean"), c("h2_var"), c("h2_n"))
    )
    reason = F.when(~volume, "a group has no volume in the before window").when(~usable, "needs >= 7 matched days per window")
    return stats.select(
        *keys,
        usable.alias("usable"),
        reason.alias("reason"),
        F.when(c("_indexed"), "index").otherwise("level").alias("mode"),
        F.when(usable, round_half_up(effect, 3)).alias("effect"),
        F.when(usable, round_half_up(statistic, 3)).alias("statistic"),
        F.when(usable, round_half_up(trend, 3)).alias("pre_trend"),
        F.when(usable, F.coalesce(F.abs(trend) < 2, F.lit(False))).alias("pre_trend_passed"),
        c("b_n").alias("matched_before"),
        c("a_n").alias("matched_after"),
    )


def control_change_pct(before: Column, after: Column, before_days: Column, after_days: Column, is_sum: Column) -> Column:
    """Change of the control group in percent, per day for sums."""
    one = F.lit(1)
    b = before / F.when(is_sum, before_days).otherwise(one)
    a = after / F.when(is_sum, after_days).otherwise(one)
    return F.when(before != 0, round_half_up((a / b - 1) * 100, 2))


def with_last_year(windows: DataFrame) -> DataFrame:
    """Each labelled window and the same window 52 weeks earlier (label ``ly_...``)."""
    shifted = windows.withColumns(
        {"start": year_earlier(F.col("start")), "end": year_earlier(F.col("end")), "label": F.concat(F.lit("ly_"), "label")}
    )
    return windows.unionByName(shifted)


def seasonal_check(values: DataFrame, keys: Sequence[str], is_sum: Column | bool = True) -> DataFrame:
    """Change between the windows a year earlier beside the observed change.

    ``values`` has keys, label (before, after, ly_before, ly_after), start,
    end, value and dates (days with rows). Half of the days must be covered
    on both sides of last year.
    """
    keys = list(keys)
    summed = F.lit(is_sum) if isinstance(is_sum, bool) else is_sum
    length = days_inclusive(F.col("start"), F.col("end"))
    marked = values.withColumns({"_len": length, "_cover": F.col("dates") / length, "_sum": summed})
    sides = ("before", "after", "ly_before", "ly_after")
    wide = marked.groupBy(*keys, "_sum").agg(
        *[F.max(F.when(F.col("label") == s, F.col(v))).alias(f"{s}_{v}") for s in sides for v in ("value", "_len", "_cover")]
    )

    def change(b: str, a: str) -> Column:
        per_day = F.col("_sum") & (F.col(f"{b}__len") != F.col(f"{a}__len"))
        before = F.col(f"{b}_value") / F.when(per_day, F.col(f"{b}__len")).otherwise(1)
        after = F.col(f"{a}_value") / F.when(per_day, F.col(f"{a}__len")).otherwise(1)
        return F.when(before != 0, round_half_up((after - before) / F.abs(before) * 100, 2))

    covered = F.coalesce((F.col("ly_before__cover") >= 0.5) & (F.col("ly_after__cover") >= 0.5), F.lit(False))
    return wide.select(
        *keys,
        covered.alias("checked"),
        F.when(covered, change("ly_before", "ly_after")).alias("last_year_change_pct"),
        change("before", "after").alias("observed_change_pct"),
    )


def context_shift(totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shift of average position and of demand, net of the control group when there is one.

    ``totals`` has keys, before_/after_ impressions, avg_position and days,
    and optionally the same with a ``control_`` prefix.
    """
    c = F.col
    has_control = "control_before_impressions" in totals.columns
    none = F.lit(None).cast("double")
    own = c("after_avg_position") - c("before_avg_position")
    other = c("control_after_avg_position") - c("control_before_avg_position") if has_control else none
    demand = (c("after_impressions") / c("after_days")) / (c("before_impressions") / c("before_days"))
    control = (
        F.when(
            (c("control_before_impressions") > 0) & (c("control_after_impressions") > 0),
            (c("control_after_impressions") / c("after_days")) / (c("control_before_impressions") / c("before_days")),
        )
        if has_control
        else none
    )
    shift = F.when(c("before_impressions") > 0, (F.coalesce(demand / control, demand) - 1) * 100)
    return totals.select(
        *keys,
        (own - F.coalesce(other, F.lit(0.0))).alias("position_shift"),
        other.isNotNull().alias("position_net"),
        shift.alias("demand_shift_pct"),
        control.isNotNull().alias("demand_net"),
    )
