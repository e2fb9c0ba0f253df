"""One job for all monitor rules: requests, measurement, guards, and alerts not yet open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ledger import append_open
from ..operators.monitors import evaluate_monitors, monitor_requests
from .comparison import Evidence, analyze


def monitor_pass(evidence: Evidence, monitors: DataFrame, now: Column, scope_sets=((),)) -> DataFrame:
    """Outcome of every enabled monitor."""
    asked = monitor_requests(monitors, evidence.metrics, evidence.sources)
    result = analyze(evidence, asked, now, scope_sets, with_control=False, seasonality=False)
    issues = result["issues"].withColumnRenamed("request_id", "monitor_id")
    broken = issues.where((F.col("code") == "sudden_zero") & (F.col("label") == "after"))
    down = issues.where(F.col("code").isin("source_unavailable", "source_unconfigured", "source_disabled"))
    compared = result["evidence"].withColumnRenamed("request_id", "monitor_id").join(
        evidence.metrics.select("metric_id", "min_sample"), "metric_id", "left"
    )
    return evaluate_monitors(monitors, compared, broken, down)


def new_alerts(outcomes: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Alerts whose monitor has no open anomaly; a second run adds nothing."""
    alerts = outcomes.where("outcome = 'alert'").withColumn("dedupe_key", F.concat(F.lit("monitor:"), F.col("monitor_id")))
    return append_open(alerts, anomalies)
