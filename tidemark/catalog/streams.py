"""Streaming jobs run to their end over the event rows, and what they must agree with."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import alerts, change_windows
from ..session import ensure_checkpoint_dir
from ..streaming import pulls
from ..streaming.alerts import episodes, run_alerts
from .registry import query, rnd

EVENT_ROWS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
DELIVERIES = 4


def _monitor():
    return F.concat_ws("-", "event_type", (F.col("user_id") % 20).cast("string"))


def _workspace(t) -> str:
    ensure_checkpoint_dir(t.spark)
    return f"{t.spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4()}"


def _rules(t):
    names = t("events").select(_monitor().alias("monitor_id")).distinct()
    return names.select(
        "monitor_id", F.lit("m").alias("metric_id"), F.lit("events").alias("source_id"), F.lit(3).alias("window_days"), F.lit(25.0).alias("relative_threshold_pct"),
        F.lit(2.0).alias("absolute_threshold"), F.lit(4.0).alias("min_sample"), F.lit(1.0).alias("min_significance"), F.lit("both").alias("direction"),
        F.lit("medium").alias("severity"), F.lit(True).alias("enabled"),
    )


def _through(t):
    """The last day that is complete a day before the newest event."""
    last = t("events").agg(F.max("ts").alias("ts"))
    return last.select(F.date_sub(F.to_date(F.col("ts").cast("timestamp") - F.expr("INTERVAL 1 DAY")), 1)).first()[0]


def _history(t):
    daily = t("events").groupBy(_monitor().alias("monitor_id"), F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("value"))
    return alerts.monitor_history(daily, _rules(t), F.lit(_through(t)))


_HISTORY = f"""e AS (SELECT event_type || '-' || CAST(user_id % 20 AS VARCHAR) AS monitor_id, CAST(ts AS DATE) AS date, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY 1, 2),
th AS (SELECT CAST(max(ts) - INTERVAL 1 DAY AS DATE) - 1 AS d FROM events),
w AS (SELECT monitor_id, date + k AS day, k < 3 AS after, value FROM e, (SELECT CAST(unnest(range(6)) AS INTEGER) AS k) x WHERE date + k <= (SELECT d FROM th)),
s AS (SELECT monitor_id, day, sum(value) FILTER (WHERE NOT after) AS b, sum(value) FILTER (WHERE after) AS a FROM w GROUP BY 1, 2),
g AS (SELECT *, {rnd('a - b', 4)} AS da, {rnd('(a - b) / b * 100', 2)} AS dp, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN {rnd('greatest(-99.0, least(99.0, (a / 3 - b / 3) / sqrt(b / 9 + a / 9) / 1.4142135623730951))', 3)} END AS st FROM s),
h AS (SELECT *, CASE WHEN b >= 4 AND (a IS NULL OR a = 0) THEN 'tracking_break' WHEN abs(dp) >= 25 AND abs(da) >= 2 AND b >= 4 AND abs(st) >= 1 THEN 'threshold_breach' END AS kind FROM g)"""
_EPISODES = f"""WITH {_HISTORY},
n AS (SELECT *, CASE WHEN day - lag(day) OVER o <= {alerts.CLOSE_AFTER} THEN 0 ELSE 1 END AS fresh FROM h WHERE kind IS NOT NULL WINDOW o AS (PARTITION BY monitor_id ORDER BY day)),
m AS (SELECT *, sum(fresh) OVER (PARTITION BY monitor_id ORDER BY day) AS episode FROM n),
r AS (SELECT monitor_id, min(day) AS opened, max(day) AS last, arg_min(kind, day) AS kind, arg_min(b, day) AS before_value, first(a ORDER BY day) AS after_value, first(dp ORDER BY day) AS delta_pct, first(st ORDER BY day) AS statistic FROM m GROUP BY monitor_id, episode)
SELECT monitor_id, opened, CASE WHEN last + {alerts.CLOSE_AFTER} <= (SELECT d FROM th) THEN last + {alerts.CLOSE_AFTER} END AS closed, kind,
 CASE kind WHEN 'tracking_break' THEN 'high' ELSE 'medium' END AS severity, before_value, after_value, delta_pct, statistic FROM r"""


@query(
    "monitor_history",
    sql=f"""WITH {_HISTORY} SELECT monitor_id, day, CASE WHEN kind IS NOT NULL THEN 'alert' WHEN b IS NULL OR a IS NULL THEN 'insufficient_data' ELSE 'quiet' END AS outcome,
 kind, b AS before_value, a AS after_value, dp AS delta_pct, st AS statistic FROM h""",
)
def monitor_history(t):
    return _history(t).select("monitor_id", "day", "outcome", "kind", "before_value", "after_value", "delta_pct", "statistic")


@query("alert_episodes", sql=_EPISODES)
def alert_episodes(t):
    return alerts.alert_episodes(_history(t), F.lit(_through(t)))


def deliver(t, folder: str, parts: int = DELIVERIES):
    """The events in ``parts`` deliveries by time; yields after each is written."""
    events = t("events")
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    share = (F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lit(low).cast("timestamp"))) / max((high - low).total_seconds(), 1.0)
    part = F.least(F.floor(share * parts), F.lit(parts - 1))
    for number in range(parts):
        events.where(part == number).write.mode("append").parquet(folder)
        yield number


@query("stream_alerts", sql=_EPISODES)
def stream_alerts(t):
    """The monitors as a stream that is stopped and started again after each delivery."""
    home = _workspace(t)
    shaped = lambda rows: rows.select(_monitor().alias("monitor_id"), "ts", F.lit(1.0).alias("value"))
    rules = _rules(t)
    for _ in deliver(t, f"{home}/in"):
        run_alerts(t.spark, f"{home}/in", EVENT_ROWS, shaped, rules, f"{home}/alerts", f"{home}/state")
    return episodes(t.spark.read.parquet(f"{home}/alerts"))


def _with_late_rows(t, folder: str):
    """The deliveries of :func:`deliver`, but every twentieth event comes last, and every tenth of a delivery again with the next."""
    events = t("events")
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    share = (F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lit(low).cast("timestamp"))) / max((high - low).total_seconds(), 1.0)
    part = F.least(F.floor(share * DELIVERIES), F.lit(DELIVERIES - 1))
    held_back = F.col("event_id") % 20 == 7
    for number in range(DELIVERIES + 1):
        own = events.where((part == number) & ~held_back) if number < DELIVERIES else events.where(held_back)
        again = events.where((part == number - 1) & ~held_back & (F.col("event_id") % 10 == 3))
        own.unionByName(again).write.mode("append").parquet(folder)
        yield number


def _ingested(t) -> str:
    home = _workspace(t)
    shaped = t.spark.readStream.schema(EVENT_ROWS).parquet
    for _ in _with_late_rows(t, f"{home}/in"):
        stream = shaped(f"{home}/in").select(F.lit("events").alias("source_id"), "ts", F.col("event_type").alias("series"), F.lit(1).cast("bigint").alias("value"), "event_id")
        pulls.ingest_days(stream, f"{home}/store", f"{home}/state", lambda: F.lit("2024-02-01 00:00:00").cast("timestamp")).trigger(availableNow=True).start().awaitTermination()
    return f"{home}/store"


@query("stream_restated_days", sql="SELECT 'events' AS source_id, CAST(ts AS DATE) AS date, event_type AS series, count(*) AS value FROM events GROUP BY 2, 3")
def stream_restated_days(t):
    """Daily values after a stream whose last delivery restates closed days."""
    return pulls.all_days(t.spark, _ingested(t)).drop("kind")


@query(
    "stream_slice_index",
    sql="""WITH e AS (SELECT *, event_id % 20 = 7 AS held, least(floor((epoch(date_trunc('second', ts)) - epoch(date_trunc('second', (SELECT min(ts) FROM events)))) / greatest(epoch((SELECT max(ts) FROM events)) - epoch((SELECT min(ts) FROM events)), 1) * 4), 3) AS part FROM events),
b AS (SELECT CASE WHEN held THEN 4 ELSE part END AS batch, ts, event_type FROM e UNION ALL SELECT part + 1, ts, event_type FROM e WHERE NOT held AND event_id % 10 = 3)
SELECT CAST(batch AS INTEGER) AS batch, CAST(ts AS DATE) AS date, strftime(ts, '%Y-%m') AS month, event_type AS series, count(*) AS n_rows FROM b GROUP BY 1, 2, 3, 4""",
)
def stream_slice_index(t):
    """The slice index that ingest keeps in step with the facts."""
    return pulls.read_index(t.spark, _ingested(t)).select("batch", "date", "month", "series", F.col("rows").alias("n_rows"))


def _event_changes(t):
    """Every fifth sign-up counts as a change that went live then."""
    return t("events").where("event_type = 'signup' AND event_id % 5 = 0").select(F.col("event_id").alias("change_id"), F.to_date("ts").alias("date"))


@query(
    "changes_near_alerts",
    sql=f"""WITH p AS ({_EPISODES}),
c AS (SELECT event_id AS change_id, CAST(ts AS DATE) AS date FROM events WHERE event_type = 'signup' AND event_id % 5 = 0)
SELECT monitor_id, opened, opened - 5 AS start, opened AS "end", (SELECT count(*) FROM c WHERE c.date BETWEEN p.opened - 5 AND p.opened) AS n_changes FROM p""",
)
def changes_near_alerts(t):
    """How many changes lie in the windows of each alert."""
    found = alerts.alert_episodes(_history(t), F.lit(_through(t)))
    return change_windows.changes_near_alerts(_event_changes(t), found, _rules(t))[0]


@query(
    "alert_span_changes",
    sql=f"""WITH p AS ({_EPISODES}), s AS (SELECT DISTINCT opened - 5 AS start, opened AS "end" FROM p)
SELECT start, "end", event_id AS change_id, CAST(ts AS DATE) AS date FROM s JOIN events ON event_type = 'signup' AND event_id % 5 = 0 AND CAST(ts AS DATE) BETWEEN start AND "end\"""",
)
def alert_span_changes(t):
    """The changes themselves, once per distinct span."""
    found = alerts.alert_episodes(_history(t), F.lit(_through(t)))
    return change_windows.changes_near_alerts(_event_changes(t), found, _rules(t))[1]
