"""Monitor outcomes of every day, and the alerts that they open and close."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .compare import finish_comparison
from .monitors import evaluate_monitors

#: Quiet days after which an open alert is closed.
CLOSE_AFTER = 7


def rolling_windows(daily: DataFrame, windows: DataFrame, through: Column) -> DataFrame:
    """Both windows of each monitor at the end of every day up to ``through``, side by side.

    ``daily`` has monitor_id, date and value; ``windows`` monitor_id and
    window_days. A day's value is sent to the days whose windows hold it, so long
    series spread over tasks. Days with two empty windows are left out.
    """
    sent = daily.join(windows.select("monitor_id", "window_days"), "monitor_id").withColumn("_back", F.explode(F.sequence(F.lit(0), 2 * F.col("window_days") - 1)))
    placed = sent.withColumn("day", F.date_add("date", F.col("_back"))).where(F.col("day") <= through)
    sides = {"before_": F.col("_back") >= F.col("window_days"), "after_": F.col("_back") < F.col("window_days")}
    stats = [
        agg(F.when(where, F.col("value").cast("double"))).alias(side + name)
        for side, where in sides.items()
        for name, agg in (("value", F.sum), ("n", F.count), ("mean", F.avg), ("var", F.var_samp))
    ]
    return placed.groupBy("monitor_id", "day", "window_days").agg(*stats)


def monitor_history(daily: DataFrame, monitors: DataFrame, through: Column) -> DataFrame:
    """Outcome of each rule at the end of each day: monitor_id, day, outcome, kind, severity, values and guards.

    For summed metrics: ``daily`` has the value of a monitor's metric and scope
    per day, ``monitors`` the rules. Days after ``through`` are not judged.
    """
    rules = monitors.withColumn("window_days", F.coalesce("window_days", F.lit(7)))
    none = lambda kind: F.lit(None).cast(kind)
    wide = rolling_windows(daily, rules, through).withColumns(
        {
            "aggregation": F.lit("sum"), "before_days": F.col("window_days"), "after_days": F.col("window_days"), "overdispersion": F.lit(2.0),
            **{f"{s}_sample": F.coalesce(f"{s}_value", F.lit(0.0)) for s in ("before", "after")}, **{f"{s}_row_count": F.col(f"{s}_n") for s in ("before", "after")},
            **{f"{s}_distinct_dates": F.col(f"{s}_n") for s in ("before", "after")}, **{f"{s}_{n}": none("double") for s in ("before", "after") for n in ("numerator", "denominator")},
            **{f"{s}_missing_values": F.lit(0) for s in ("before", "after")}, "first_half": none("double"), "second_half": none("double"), "dated_days": F.lit(0),
        }
    )
    compared = finish_comparison(wide, ["monitor_id", "day"]).withColumns({"data_quality": F.lit("high"), "min_sample": none("double")})
    return evaluate_monitors(rules.drop("window_days"), compared, keep=("day",)).where("day IS NOT NULL")


def alert_episodes(history: DataFrame, through: Column, close_after: int = CLOSE_AFTER) -> DataFrame:
    """Alerts as spans: opened by the first alert, kept open by further ones, closed ``close_after`` days after the last.

    An alert that is open on day ``through`` has no closing day.
    """
    order = Window.partitionBy("monitor_id").orderBy("day")
    alerts = history.where("outcome = 'alert'")
    fresh = F.coalesce((F.datediff("day", F.lag("day").over(order)) > close_after).cast("int"), F.lit(1))
    numbered = alerts.withColumn("_fresh", fresh).withColumn("_episode", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = numbered.groupBy("monitor_id", "_episode").agg(
        F.min("day").alias("opened"), F.max("day").alias("last_alert"), *[F.min_by(c, "day").alias(c) for c in ("kind", "severity", "before_value", "after_value", "delta_pct", "statistic")]
    )
    end = F.date_add("last_alert", close_after)
    return spans.withColumn("closed", F.when(end <= through, end)).drop("_episode", "last_alert")
