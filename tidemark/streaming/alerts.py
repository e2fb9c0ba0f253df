"""Monitors on a stream: one keyed state per monitor, alerts opened by guards and closed by timers.

A monitor's state holds the daily values that its two windows can still need, the
next day to judge, and its open alert. A timer fires when the watermark passes
the end of that day, so days are judged once, in order and complete, however the
rows are cut into batches; a replayed batch finds the day already judged. State
is bounded by twice the window plus the lateness limit, and is dropped when the
windows are empty and no alert is open.
"""

from __future__ import annotations

import datetime
import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.stats import STATISTIC_CAP
from ..operators.alerts import CLOSE_AFTER
from ..schemas import column_names

DAY_MS = 86_400_000
OVERDISPERSION = 2.0

#: transitions of alerts; days are dates
EVENTS = (
    "monitor_id STRING, event STRING, day DATE, opened DATE, kind STRING, severity STRING, before_value DOUBLE, after_value DOUBLE, delta_pct DOUBLE, statistic DOUBLE"
)
_COLUMNS = column_names(EVENTS)
_EPOCH = datetime.date(1970, 1, 1)
RULE = ("window_days", "relative_threshold_pct", "absolute_threshold", "min_sample", "min_significance", "direction", "severity")
_STATE = "rule string, days array<int>, sums array<double>, next int, opened int, last int"


def _rounded(value: float | None, digits: int = 4) -> float | None:
    return None if value is None else math.floor(value * 10**digits + 0.5) / 10**digits


def _statistic(before: list[float], after: list[float], days: int) -> float:
    if len(before) >= 7 and len(after) >= 7:
        means = [sum(x) / len(x) for x in (before, after)]
        error = math.sqrt(sum(sum((v - m) ** 2 for v in x) / (len(x) - 1) / len(x) for x, m in zip((before, after), means)))
        shift = means[1] - means[0]
        found = shift / error if error else math.copysign(STATISTIC_CAP, shift) if shift else 0.0
    else:
        error = math.sqrt((sum(before) + sum(after)) / days**2)
        found = (sum(after) - sum(before)) / days / error / math.sqrt(OVERDISPERSION) if error else 0.0
    return max(-STATISTIC_CAP, min(STATISTIC_CAP, found))


def judge(rule: dict, before: list[float], after: list[float]) -> dict | None:
    """The alert that the two windows' daily values raise, or None; the guards are those of ``evaluate_monitors``."""
    minimum = rule["min_sample"] or 0.0
    b, a = (sum(x) if x else None for x in (before, after))
    if b is None:
        return None
    if b >= minimum and b > 0 and not a:
        return {"kind": "tracking_break", "severity": "high", "before_value": _rounded(b), "after_value": _rounded(a), "delta_pct": None if a is None else _rounded((a - b) / abs(b) * 100, 2), "statistic": None if a is None else _rounded(_statistic(before, after, rule["window_days"]), 3)}
    if a is None:
        return None
    change, share = _rounded(a - b), _rounded((a - b) / abs(b) * 100, 2) if b else None
    statistic = _rounded(_statistic(before, after, rule["window_days"]), 3)
    direction = rule["direction"] or "both"
    bound = lambda name, default: default if rule[name] is None else rule[name]
    met = (
        share is not None and abs(share) >= bound("relative_threshold_pct", 25.0)
        and abs(change) >= bound("absolute_threshold", 0.0)
        and b >= minimum
        and (direction == "both" or (change < 0 if direction == "decrease" else change > 0))
        and abs(statistic) >= bound("min_significance", 2.0)
    )
    return {"kind": "threshold_breach", "severity": rule["severity"] or "medium", "before_value": _rounded(b), "after_value": _rounded(a), "delta_pct": share, "statistic": statistic} if met else None


class AlertState:
    """What is kept for one monitor, and the judging of its complete days."""

    def __init__(self, held: tuple | None, close_after: int):
        rule, days, sums, self.next, self.opened, self.last = held if held else (None, [], [], None, None, None)
        self.rule = json.loads(rule) if rule else None
        self.sums = dict(zip(days or [], sums or []))
        self.close_after = close_after

    def held(self) -> tuple:
        days = sorted(self.sums)
        return json.dumps(self.rule), days, [self.sums[d] for d in days], self.next, self.opened, self.last

    def add(self, day: int, value: float) -> None:
        self.next = day if self.next is None else min(self.next, day)
        self.sums[day] = self.sums.get(day, 0.0) + value

    def empty(self) -> bool:
        return not self.sums and self.opened is None

    def judged(self, until: int) -> Iterator[dict]:
        """Transitions of all days up to ``until`` that are not judged yet."""
        while not self.empty() and self.next is not None and self.next <= until:
            day, width = self.next, self.rule["window_days"]
            after = [v for d, v in sorted(self.sums.items()) if day - width < d <= day]
            before = [v for d, v in sorted(self.sums.items()) if day - 2 * width < d <= day - width]
            alert = judge(self.rule, before, after)
            if alert:
                if self.opened is None:
                    self.opened = day
                    yield {"event": "opened", "day": day, "opened": day, **alert}
                self.last = day
            elif self.opened is not None and day - self.last >= self.close_after:
                yield {"event": "closed", "day": day, "opened": self.opened}
                self.opened = self.last = None
            self.next = day + 1
            for d in [d for d in self.sums if d <= self.next - 2 * width]:
                del self.sums[d]
        if self.empty():
            self.next = None


class MonitorProcessor(StatefulProcessor):
    """Collects a monitor's daily values and judges a day when its timer fires."""

    def __init__(self, close_after: int = CLOSE_AFTER):
        self.close_after = close_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("monitor", _STATE)

    def _load(self) -> AlertState:
        return AlertState(tuple(self.state.get()) if self.state.exists() else None, self.close_after)

    def _save(self, kept: AlertState) -> None:
        if kept.empty():
            self.state.clear()
            return
        self.state.update(kept.held())
        self.handle.registerTimer((kept.next + 1) * DAY_MS)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kept = self._load()
        for row in rows:
            kept.rule = json.loads(row["rule"])
            kept.add(row["day"], row["value"])
        self._save(kept)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        kept = self._load()
        found = list(kept.judged(timerValues.getCurrentWatermarkInMs() // DAY_MS - 1))
        self._save(kept)
        for row in found:
            days = {name: _EPOCH + datetime.timedelta(row[name]) for name in ("day", "opened")}
            yield Row(**dict.fromkeys(_COLUMNS) | {"monitor_id": key[0], **row, **days})


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per monitor and day of a batch: a busy monitor's rows are added up before they are shuffled."""
    for rows in batches:
        if rows.num_rows:
            parts = pa.table(rows).group_by(["monitor_id", "day"]).aggregate([("value", "sum"), ("ts", "max"), ("rule", "max")])
            yield from parts.rename_columns(["monitor_id", "day", "value", "ts", "rule"]).to_batches()


def alert_events(rows: DataFrame, monitors: DataFrame, late: str = "1 day", close_after: int = CLOSE_AFTER) -> DataFrame:
    """Stream of alerts opened and closed.

    ``rows`` is a stream with monitor_id, ts and value; ``monitors`` the rules, a
    table that is read with each batch. Rows behind the watermark are dropped
    here: :mod:`tidemark.streaming.pulls` keeps them as a new pull.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rules = monitors.where(F.coalesce("enabled", F.lit(True))).withColumn("window_days", F.coalesce("window_days", F.lit(7)))
    rule = F.to_json(F.struct(*RULE), {"ignoreNullFields": "false"})
    ts = F.col("ts").cast("timestamp")
    keyed = rows.join(rules.select("monitor_id", rule.alias("rule")), "monitor_id").select("monitor_id", F.unix_date(F.to_date(ts)).alias("day"), F.col("value").cast("double").alias("value"), ts.alias("ts"), "rule")
    parts = keyed.mapInArrow(_combined, "monitor_id string, day int, value double, ts timestamp, rule string").withWatermark("ts", late)
    return parts.groupBy("monitor_id").transformWithState(MonitorProcessor(close_after), outputStructType=EVENTS, outputMode="Append", timeMode="EventTime")


def episodes(events: DataFrame) -> DataFrame:
    """The alerts of stored transitions, as ``alert_episodes`` gives them."""
    closed = events.where("event = 'closed'").select("monitor_id", "opened", F.col("day").alias("closed"))
    return events.where("event = 'opened'").drop("event", "day").join(closed, ["monitor_id", "opened"], "left")


def run_alerts(spark: SparkSession, source: str, schema: str, shaped, monitors: DataFrame, alerts_path: str, checkpoint: str, late: str = "1 day", close_after: int = CLOSE_AFTER) -> None:
    """Take in what is new in the folder ``source`` and append the transitions; a run after a failure repeats nothing.

    ``shaped`` maps the source's rows to monitor_id, ts and value.
    """
    stream = alert_events(shaped(spark.readStream.schema(schema).parquet(source)), monitors, late, close_after)
    stream.writeStream.format("parquet").option("path", alerts_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
