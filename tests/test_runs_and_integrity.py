"""Zero runs over chunk borders, and integrity in one grouping."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import quality
from tidemark.operators.integrity import Keys, Recorded, References, integrity


def plain_runs(days):
    """(first day, length, days, mean before) of each run of zeros in a list of (day, value)."""
    out, i = [], 0
    while i < len(days):
        if days[i][1]:
            i += 1
            continue
        j = i
        while j < len(days) and not days[j][1]:
            j += 1
        before = [v or 0 for _, v in days[:i]]
        out.append((days[i][0], j - i, len(days), round(sum(before) / len(before), 6) if before else 0.0))
        i = j
    return out


@pytest.mark.parametrize("chunk_days", [1, 3, 10, 4096])
def test_runs_cross_chunks(spark, chunk_days):
    draw = random.Random(chunk_days)
    first = dt.date(1969, 12, 1)
    series = {}
    for key in ("a", "b", None):
        level, days = 1, []
        for n in range(90):
            level = draw.choice([level, level, level, 0, 4])
            if draw.random() < 0.85:  # some days are missing, and some values
                days.append((first + dt.timedelta(n), level if level or draw.random() < 0.7 else None))
        series[key] = days
    rows = [(k, d, v) for k, days in series.items() for d, v in days]
    frame = spark.createDataFrame(rows, "k STRING, date DATE, value INT").repartition(5)
    got = {}
    for r in quality.zero_runs(frame, ["k"], chunk_days=chunk_days).collect():
        got.setdefault(r.k, []).append((r.first_zero, r.zero_days, r.days, round(r.prior_average, 6)))
    assert {k: sorted(v) for k, v in got.items()} == {k: plain_runs(v) for k, v in series.items()}


def test_one_long_series_is_cut_into_tasks(spark):
    days = spark.range(200_000).select(F.lit("k").alias("k"), F.date_add(F.lit("1700-01-01").cast("date"), F.col("id").cast("int")).alias("date"), F.when(F.col("id") % 1000 < 3, 0).otherwise(7).alias("value"))
    runs = quality.zero_runs(days, ["k"], chunk_days=500)
    assert runs.count() == 200 and {r[0] for r in runs.select("zero_days").distinct().collect()} == {3}
    assert quality.zero_runs(days.where("false"), ["k"]).collect() == []


def test_integrity(spark):
    pulls = spark.createDataFrame([("p1", "h1"), ("p2", "h2"), ("p2", "h2"), ("p3", "x"), (None, "h"), ("p5", "h5")], "snapshot_id STRING, h STRING")
    evidence = spark.createDataFrame([(1, "p1"), (2, "p9"), (3, "p9"), (4, None), (5, "p3")], "evidence_id INT, snapshot_id STRING")
    headers = spark.createDataFrame([("p1", "h1"), ("p3", "h3"), ("p7", "h7")], "snapshot_id STRING, rows_hash STRING")
    keys = [Keys("pulls", pulls, "snapshot_id", F.col("h")), Keys("evidence", evidence, "evidence_id")]
    found = integrity(keys, [References("evidence", evidence, "evidence_id", "pulls", "snapshot_id")], [Recorded("pulls", headers, "snapshot_id", F.col("rows_hash"))])
    assert sorted((r["table"], r["id"] or "", r["violation"], r["records"], r["references"], r["referred_by"]) for r in found.collect()) == [
        ("pulls", "", "unnamed", 1, 0, None), ("pulls", "p2", "double", 2, 0, None), ("pulls", "p3", "changed", 1, 1, "evidence:5"),
        ("pulls", "p7", "lost", 0, 0, None), ("pulls", "p9", "dangling", 0, 2, "evidence:2"),
    ]
    assert integrity([Keys("pulls", pulls.where("h = 'h1'"), "snapshot_id")]).collect() == []
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1
