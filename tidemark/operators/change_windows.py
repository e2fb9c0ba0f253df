"""Changes inside windows: numbers from prefix counts, details once per distinct span.

The changes are counted per day and added up once. A window's number is then the
difference of two look-ups, at its end and before its start, and look-ups are
made once per distinct day. Details are listed per distinct span, which windows
name, so both outputs grow with the windows and not with windows times changes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .intervals import overlap_join


def prefix_counts(changes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per day with changes: how many there were up to it. ``changes`` has date and ``by``."""
    daily = changes.where(F.col("date").isNotNull()).groupBy(*by, "date").agg(F.count(F.lit(1)).alias("_n"))
    return daily.withColumn("upto", F.sum("_n").over(Window.partitionBy(*by).orderBy("date"))).drop("_n")


def _looked_up(days: DataFrame, counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """``upto`` at each day: that of the last day with changes."""
    marked = days.select(*by, "date", F.lit(None).cast("bigint").alias("upto"), F.lit(1).alias("_asks")).unionByName(counts.withColumn("_asks", F.lit(0)))
    last = F.last("upto", ignorenulls=True).over(Window.partitionBy(*by).orderBy("date", "_asks").rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_found", F.coalesce(last, F.lit(0))).where("_asks = 1").select(*by, "date", F.col("_found").alias("upto"))


def count_in_windows(changes: DataFrame, windows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``windows`` (start, end and ``by``) with ``n_changes``, those dated inside with the same ``by``.

    A window that ends before it starts, or has no bounds, holds none.
    """
    by = list(by) or ["_all"]
    whole = {"_all": F.lit(0)} if by == ["_all"] else {}
    asked, made = windows.withColumns(whole), changes.withColumns(whole)
    days = asked.select(*by, F.explode(F.array("end", F.date_sub("start", 1))).alias("date")).where("date IS NOT NULL").distinct()
    found = _looked_up(days, prefix_counts(made, by), by)
    at_end = found.withColumnsRenamed({"date": "end", "upto": "_end"})
    before = found.select(*by, F.date_add("date", 1).alias("start"), F.col("upto").alias("_before"))
    met = asked.join(at_end, [*by, "end"], "left").join(before, [*by, "start"], "left")
    number = F.greatest(F.coalesce(F.col("_end") - F.col("_before"), F.lit(0)), F.lit(0))
    return met.withColumn("n_changes", number).select(*windows.columns, "n_changes")


def span_changes(changes: DataFrame, windows: DataFrame) -> DataFrame:
    """The changes of each distinct (start, end) among the windows: start, end and the columns of ``changes``."""
    # long spans lie in one bucket each; as a broadcast they leave the changes spread as they are
    spans = broadcast_if_small(windows.select("start", "end").distinct())
    dated = changes.withColumns({"_first": F.col("date"), "_last": F.col("date"), "_any": F.lit(0)})
    return overlap_join(spans.withColumn("_any", F.lit(0)), dated, ["_any"], ("start", "end"), ("_first", "_last")).drop("_any", "_first", "_last")


def changes_near_alerts(changes: DataFrame, episodes: DataFrame, monitors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate explanations of alerts: per alert the span of both its windows with the number of changes, and the changes of each span."""
    width = F.coalesce("window_days", F.lit(7))
    spans = episodes.join(monitors.select("monitor_id", width.alias("_w")), "monitor_id").select(
        "monitor_id", "opened", F.date_sub("opened", 2 * F.col("_w") - 1).alias("start"), F.col("opened").alias("end")
    )
    return count_in_windows(changes, spans), span_changes(changes, spans)
