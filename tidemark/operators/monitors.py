"""Monitor rules, funnels, audits and experiments on top of measured comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import trailing_windows
from ..functions.numbers import round_half_up
from ..functions.stats import meets_threshold, parse_threshold

_SCOPE = "map<string,array<string>>"


def monitor_requests(monitors: DataFrame, metrics: DataFrame, sources: DataFrame) -> DataFrame:
    """Comparison requests of all enabled monitors: the last N days against the N before."""
    known = metrics.select("metric_id", "canonical_source")
    joined = monitors.where(F.coalesce("enabled", F.lit(True))).join(known, "metric_id")
    placed = joined.withColumn("source_id", F.coalesce("source_id", "canonical_source")).join(
        sources.select("source_id", "data_through"), "source_id"
    )
    windows = trailing_windows(F.col("data_through"), F.coalesce("window_days", F.lit(7)))
    return placed.where("data_through IS NOT NULL").select(
        F.col("monitor_id").alias("request_id"), "metric_id", "source_id", *[c.alias(n) for n, c in windows.items()],
        F.coalesce("scope", F.create_map().cast(_SCOPE)).alias("scope"),
        F.lit(None).cast("array<string>").alias("change_ids"), F.lit(None).cast("string").alias("experiment_id"),
        F.lit("observational").alias("design"), F.lit("none").alias("control"),
        F.lit(None).cast("array<string>").alias("control_pages"), F.lit(None).cast("array<string>").alias("context_refs"),
    )


def evaluate_monitors(
    monitors: DataFrame, compared: DataFrame, broken: DataFrame | None = None, down: DataFrame | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Outcome of each rule: alert needs every guard, a tracking break alerts on its own.

    ``compared`` has one comparison per monitor_id, or per monitor_id and the
    ``keep`` columns, with data_quality and min_sample; ``broken`` lists monitors whose after window drops to zero,
    ``down`` those whose source cannot be read.
    """
    c = F.col
    rules = monitors.where(F.coalesce("enabled", F.lit(True))).withColumnRenamed("min_sample", "_rule_sample")
    rows = rules.drop("metric_id", "source_id").join(compared, "monitor_id", "left")
    for frame, flag in ((broken, "_broken"), (down, "_down")):
        if frame is None:
            rows = rows.withColumn(flag, F.lit(False))
        else:
            rows = rows.join(frame.select("monitor_id", F.lit(True).alias(flag)).distinct(), "monitor_id", "left").fillna(False, [flag])
    minimum = F.coalesce("_rule_sample", "min_sample", F.lit(0.0))
    before, after = F.coalesce("before_sample", F.lit(0.0)), F.coalesce("after_sample", F.lit(0.0))
    volume = (before >= minimum) & (c("before_value") > 0)
    vanished = ~c("_down") & F.coalesce(volume, F.lit(False)) & (c("after_value").isNull() | (c("after_value") == 0) | c("_broken"))
    unusable = (c("data_quality") == "insufficient") | c("before_value").isNull() | c("after_value").isNull()
    direction = F.coalesce("direction", F.lit("both"))
    guards = {
        "relative": F.abs("delta_pct") >= F.coalesce("relative_threshold_pct", F.lit(25.0)),
        "absolute": F.abs("delta_abs") >= F.coalesce("absolute_threshold", F.lit(0.0)),
        "sample": F.when(c("aggregation") == "sum", before >= minimum).otherwise(F.least(before, after) >= minimum),
        "direction": F.when(direction == "decrease", c("delta_abs") < 0).when(direction == "increase", c("delta_abs") > 0).otherwise(True),
        "significance": F.abs("statistic") >= F.coalesce("min_significance", F.lit(2.0)),
    }
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in guards.items()]))
    outcome = (
        F.when(c("aggregation").isNull() & c("data_quality").isNull(), "misconfigured")
        .when(vanished, "alert")
        .when(unusable, "insufficient_data")
        .when(F.size("_failed") == 0, "alert")
        .otherwise("quiet")
    )
    kind = F.when(vanished, "tracking_break").when((F.size("_failed") == 0) & ~unusable, "threshold_breach")
    tested = rows.withColumn("_failed", failed)
    return tested.select(
        "monitor_id", *keep, outcome.alias("outcome"), kind.alias("kind"),
        F.when(kind == "tracking_break", "high").when(kind.isNotNull(), F.coalesce("severity", F.lit("medium"))).alias("severity"),
        "before_value", "after_value", "delta_abs", "delta_pct", "statistic",
        F.when(outcome == "quiet", F.array_join("_failed", ",")).alias("failed_guards"),
    )


def funnel_steps(stages: DataFrame, keys: Sequence[str] = ("funnel_id",)) -> DataFrame:
    """Conversion of each stage from the one before; an unknown stage gives NULL.

    ``stages`` has keys, stage_no, metric_id, source_id and value.
    """
    order = Window.partitionBy(*keys).orderBy("stage_no")
    before = F.lag("value").over(order)
    steps = stages.withColumns(
        {"_from": F.lag("metric_id").over(order), "_before": before, "_source": F.lag("source_id").over(order)}
    ).where(F.col("_from").isNotNull())
    rate = F.when(F.col("_before") != 0, round_half_up(F.col("value") / F.col("_before") * 100, 2))
    return steps.select(
        *keys, "stage_no", F.col("_from").alias("from_metric"), F.col("metric_id").alias("to_metric"), rate.alias("conversion_pct"),
        F.when(rate.isNull(), "unknown").when(F.col("_source") != F.col("source_id"), "mixed_sources").otherwise("same_source").alias("note"),
    )


def audit_requests(metrics: DataFrame, sources: DataFrame, scope: str = "growth", days: int = 28) -> DataFrame:
    """Requests for every confirmed metric of a scope: the last N days against the N before."""
    chosen = metrics.where(F.coalesce("status", F.lit("active")) != "proposed")
    if scope == "revenue":
        paid = F.col("tier").isin("payment", "willingness_to_pay", "retention") | (F.col("unit") == "currency")
        chosen = chosen.where(F.coalesce(paid, F.lit(False)))
    rules = chosen.select(
        F.col("metric_id").alias("monitor_id"), "metric_id", F.col("canonical_source").alias("source_id"), F.lit(days).alias("window_days"),
        F.lit(True).alias("enabled"), F.lit(None).cast(_SCOPE).alias("scope"),
    )
    return monitor_requests(rules, metrics, sources)


# ---- experiments -----------------------------------------------------------


def criteria_basis(experiments: DataFrame, overrides: DataFrame) -> DataFrame:
    """Whether an experiment's thresholds may be used: its definition is the locked one or an approved override covers it."""
    approved = overrides.where(F.col("status") == "approved").groupBy(
        F.col("prior_fingerprint").alias("locked_fingerprint"), F.col("replacement_fingerprint").alias("fingerprint")
    ).agg(F.min("override_id").alias("_override"))
    joined = experiments.join(approved, ["locked_fingerprint", "fingerprint"], "left")
    basis = (
        F.when(F.col("locked_fingerprint").isNull(), "criteria_not_locked")
        .when(F.col("fingerprint") == F.col("locked_fingerprint"), "review_lock")
        .when(F.col("_override").isNotNull(), F.concat(F.lit("override "), F.col("_override")))
        .otherwise("criteria_changed")
    )
    allowed = (basis == "review_lock") | basis.startswith("override ")
    return joined.withColumns({"criteria_basis": basis, "criteria_authorized": allowed}).drop("_override")


def threshold_result(observed: Column, quality: Column, success: Column, failure: Column) -> Column:
    """Observed value against the success and failure thresholds."""
    good, bad = parse_threshold(success), parse_threshold(failure)
    return (
        F.when((quality == "insufficient") | observed.isNull(), "insufficient_data")
        .when(good.isNull() | bad.isNull(), "thresholds_unparseable")
        .when(meets_threshold(observed, good), "success_threshold_met")
        .when(meets_threshold(observed, bad), "failure_threshold_met")
        .otherwise("between_thresholds")
    )


def evaluate_experiments(experiments: DataFrame, measured: DataFrame, now: Column) -> DataFrame:
    """Threshold result per experiment; withheld unless its criteria are authorized, marked while its window is open.

    ``experiments`` comes from :func:`criteria_basis` and has window_end;
    ``measured`` has experiment_id, after_value and data_quality.
    """
    joined = experiments.join(measured, "experiment_id", "left")
    result = threshold_result(F.col("after_value"), F.col("data_quality"), F.col("success_threshold"), F.col("failure_threshold"))
    still_open = now < F.date_add("window_end", 1).cast("timestamp")
    return joined.select(
        "experiment_id", "after_value", "data_quality", "criteria_basis",
        F.when(F.col("criteria_authorized"), result).otherwise(F.col("criteria_basis")).alias("threshold_result"),
        still_open.alias("window_open"),
    )


def open_window_issues(experiments: DataFrame, now: Column) -> DataFrame:
    """Major issues for experiments whose window is still open: what they show may yet change."""
    still_open = now < F.date_add("window_end", 1).cast("timestamp")
    return experiments.where(still_open).select(
        F.col("experiment_id").alias("request_id"), F.lit("after").alias("label"), F.lit("window_open").alias("code"), F.lit("major").alias("severity"), F.col("window_end").cast("string").alias("detail")
    )


def plan_experiments(experiments: DataFrame, changes: DataFrame) -> DataFrame:
    """Windows and page scope of each experiment: a baseline of the same length just before, pages of its changes."""
    pages = changes.where("experiment_id IS NOT NULL").select("experiment_id", F.explode("pages").alias("page")).groupBy("experiment_id").agg(
        F.array_sort(F.collect_set("page")).alias("pages")
    )
    length = F.datediff("window_end", "window_start") + 1
    return experiments.join(pages, "experiment_id", "left").select(
        "experiment_id", F.date_sub("window_start", length).alias("before_start"), F.date_sub("window_start", F.lit(1)).alias("before_end"),
        F.col("window_start").alias("after_start"), F.col("window_end").alias("after_end"),
        F.coalesce("pages", F.array().cast("array<string>")).alias("pages"),
    )


def experiment_readiness(experiments: DataFrame, plans: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """Next step of each experiment, first rule that applies."""
    joined = experiments.join(plans, "experiment_id", "full").join(sources.select("source_id", "data_through"), "source_id", "left")
    closed = now >= F.date_add("window_end", 1).cast("timestamp")
    step = (
        F.when(F.col("definition_status").isNull(), "confirm_definition")
        .when(F.col("definition_status") == "changed", "ask_about_changed_definition")
        .when(F.col("plan_status").isNull(), "create_plan")
        .when(F.col("baseline_id").isNull(), "record_baseline")
        .when(F.col("plan_status") == "evaluated", "await_decision")
        .when(~F.coalesce(closed, F.lit(False)), "wait_for_window")
        .when(F.col("data_through") < F.col("window_end"), "refresh_source")
        .otherwise("evaluate")
    )
    return joined.select("experiment_id", step.alias("next_step"))
