"""Stream and batch agree; replays, repeated and late events add nothing and lose nothing."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.operators.alerts import alert_episodes, monitor_history
from tidemark.streaming import pulls
from tidemark.streaming.alerts import AlertState, episodes, run_alerts
from tidemark.streaming.jobs import daily_counts, read_new_files

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
SOURCE = "/root/testdata/sf0.001/events.parquet"


def test_daily_counts_match_the_batch(spark, tmp_path):
    events = spark.read.parquet(SOURCE)
    folder, days = str(tmp_path / "in"), str(tmp_path / "days")
    events.where("event_id % 2 = 0").coalesce(1).write.mode("append").parquet(folder)
    # the second delivery repeats some events of the first
    events.where("event_id % 2 = 1 OR event_id % 10 = 0").coalesce(1).write.mode("append").parquet(folder)
    stream = daily_counts(read_new_files(spark, folder, EVENTS, 1), late="60 days")
    write = lambda batch, number: batch.withColumn("n", F.lit(number)).write.mode("append").parquet(days)
    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(days).groupBy("series", "date").agg(F.max_by("value", "n").alias("value"))
    want = events.groupBy("event_type", F.to_date("ts").alias("d")).agg(F.count("*").alias("n"))
    assert {(r.series, r.date): r.value for r in last.collect()} == {(r.event_type, r.d): r.n for r in want.collect()}


def _lose_last_commit(folder):
    last = max((p for p in folder.iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    (folder / f".{last.name}.crc").unlink(missing_ok=True)
    last.unlink()


def _rules(spark, names):
    schema = (
        "monitor_id STRING, metric_id STRING, source_id STRING, window_days INT, relative_threshold_pct DOUBLE, absolute_threshold DOUBLE, min_sample DOUBLE, "
        "min_significance DOUBLE, direction STRING, severity STRING, enabled BOOLEAN"
    )
    rows = [(n, "m", "s", 7 if i % 2 else 4, 1000.0 if i == 5 else 25.0, 1.0, 3.0, 2.0 if i % 2 else 1.0, "both" if i % 3 else "decrease", None, True) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, schema)


def test_alerts_match_the_batch_and_replay(spark, tmp_path):
    draw = random.Random(2)
    start = dt.datetime(2024, 1, 1)
    names = [f"m{i}" for i in range(6)]
    rows = []
    for name in names:
        level = draw.randrange(3, 12)
        for day in range(70):
            if day % 17 == 16 and name != "m5":
                level = draw.choice([0, 0, 3, 20])
            if name == "m5" and day > 20:
                continue  # goes silent
            rows += [(name, start + dt.timedelta(days=day, hours=draw.random() * 24), 1.0) for _ in range(max(0, level + draw.randrange(-1, 2)) if level else 0)]
    table = spark.createDataFrame(rows, "monitor_id STRING, ts TIMESTAMP, value DOUBLE")
    rules = _rules(spark, names)
    home = str(tmp_path)
    schema = "monitor_id STRING, ts TIMESTAMP, value DOUBLE"

    def deliver(low, high):
        table.where((F.col("ts") >= F.lit(start + dt.timedelta(days=low))) & (F.col("ts") < F.lit(start + dt.timedelta(days=high)))).write.mode("append").parquet(f"{home}/in")

    run = lambda: run_alerts(spark, f"{home}/in", schema, lambda s: s, rules, f"{home}/alerts", f"{home}/cp")
    for low, high in ((0, 30), (30, 33), (33, 70)):
        deliver(low, high)
        run()
    last = max(r[1] for r in rows) - dt.timedelta(days=1)
    through = F.lit(last.date() - dt.timedelta(days=1))
    daily = table.groupBy("monitor_id", F.to_date("ts").alias("date")).agg(F.sum("value").alias("value"))
    want = alert_episodes(monitor_history(daily, rules, through), through)
    got = episodes(spark.read.parquet(f"{home}/alerts"))
    columns = sorted(want.columns)
    key = lambda frame: sorted(map(str, frame.select(*columns).collect()))
    assert key(got) == key(want) and got.count() > 5
    assert {r.kind for r in got.collect()} == {"tracking_break", "threshold_breach"} and got.where("closed IS NOT NULL").count() > 0
    # the last batch runs again after its commit was lost
    _lose_last_commit(tmp_path / "cp" / "commits")
    run()
    assert key(episodes(spark.read.parquet(f"{home}/alerts"))) == key(want)


def test_alert_state_is_bounded():
    kept = AlertState(None, 7)
    kept.rule = dict(window_days=7, relative_threshold_pct=25.0, absolute_threshold=0.0, min_sample=1.0, min_significance=2.0, direction="both", severity=None)
    found = []
    for day in range(400):
        kept.add(day, 50.0 if day < 200 else 5.0)
        found += kept.judged(day - 1)
        assert len(kept.sums) <= 15
    assert [(f["event"], f["day"]) for f in found][0][0] == "opened" and found[-1]["event"] == "closed"
    found = list(kept.judged(1000))
    assert kept.empty() and kept.next is None and [f["event"] for f in found] == ["opened", "closed"]  # silence is a tracking break


def _ingest(spark, home):
    stream = read_new_files(spark, f"{home}/in", "event_id BIGINT, source_id STRING, ts TIMESTAMP, series STRING, value DOUBLE")
    now = lambda: F.lit("2024-06-01 08:00:00").cast("timestamp")
    pulls.ingest_days(stream, f"{home}/store", f"{home}/cp", now).trigger(availableNow=True).start().awaitTermination()


def _days(frame):
    return {(r.source_id, str(r.date), r.series): r.value for r in frame.collect()}


def test_late_days_are_pulled_again(spark, tmp_path):
    home = str(tmp_path)
    draw = random.Random(4)
    at = lambda month, day: dt.datetime(2024, month, day, draw.randrange(24))
    first = [(i, draw.choice(["a", "b"]), at(1, draw.randrange(1, 29)), draw.choice("xy"), 1.0) for i in range(200)]
    second = [(200 + i, draw.choice(["a", "b"]), at(2, draw.randrange(1, 28)), draw.choice("xy"), 1.0) for i in range(200)]
    late = [(500, "a", at(1, 5), "x", 7.0), (501, "a", at(1, 5), "new", 2.0), (502, "b", at(2, 27), "y", 1.0)] + first[:20]
    schema = "event_id BIGINT, source_id STRING, ts TIMESTAMP, series STRING, value DOUBLE"
    for rows in (first, second, late):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{home}/in")
        _ingest(spark, home)
    every = spark.createDataFrame(first + second + late[:3], schema)
    want = _days(every.groupBy("source_id", F.to_date("ts").alias("date"), "series").agg(F.sum("value").alias("value")))
    assert _days(pulls.all_days(spark, f"{home}/store")) == want
    restated = pulls.owned_days(spark, f"{home}/store").where("kind = 'restated'").collect()
    assert {(str(r.date), r.series) for r in restated} >= {("2024-01-05", "x"), ("2024-01-05", "new")}
    assert len(restated) < 30  # only the days concerned

    # a one-month request reads one month's files of one source
    january = pulls.read_facts(spark, f"{home}/store", "a", ["2024-01"])
    assert january.count() == sum(r[1] == "a" and r[2].month == 1 for r in first + late)
    assert all("source_id=a/month=2024-01" in r[0] for r in january.select(F.input_file_name()).distinct().collect())
    plan = january._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "2024-01" in plan

    # the last batch runs again after its commit was lost: files are replaced, nothing is added
    before = pulls.read_facts(spark, f"{home}/store").count(), pulls.read_index(spark, f"{home}/store").count()
    _lose_last_commit(tmp_path / "cp" / "commits")
    _ingest(spark, home)
    assert (pulls.read_facts(spark, f"{home}/store").count(), pulls.read_index(spark, f"{home}/store").count()) == before
    assert _days(pulls.all_days(spark, f"{home}/store")) == want
    headers = spark.read.parquet(f"{home}/store/headers")
    assert headers.count() == 6 and headers.agg(F.sum("row_count")).first()[0] == before[0]


def test_slices_beyond_the_broadcast_limit(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pulls, "SMALL_SLICES", 0)
    test_late_days_are_pulled_again(spark, tmp_path)
