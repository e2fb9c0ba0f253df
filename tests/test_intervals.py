"""Bucketed overlaps find what comparing all pairs finds; equal windows are selected once."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.operators import selection
from tidemark.operators.intervals import overlap_join


def day(n):
    return dt.date(1969, 12, 20) + dt.timedelta(days=n)


def spans(draw, n):
    out = []
    for i in range(n):
        a = draw.randrange(400)
        out.append((i, draw.choice("xy"), day(a), day(a + draw.choice([0, 0, 1, 3, 30, 31, 32, 400, -2]))))
    return out + [(n, "x", None, day(3)), (n + 1, "y", day(3), None)]


def test_overlaps_match_all_pairs(spark):
    draw = random.Random(1)
    left, right = spans(draw, 120), spans(draw, 90)
    a = spark.createDataFrame(left, "l INT, k STRING, ls DATE, le DATE")
    b = spark.createDataFrame(right, "r INT, k STRING, rs DATE, re DATE")
    got = sorted((r.l, r.r) for r in overlap_join(a, b, ["k"], ("ls", "le"), ("rs", "re")).collect())
    fine = lambda rows: [r for r in rows if r[2] and r[3] and r[2] <= r[3]]
    want = sorted((x[0], y[0]) for x in fine(left) for y in fine(right) if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3])
    assert got == want
    assert overlap_join(a.where("false"), b, ["k"], ("ls", "le"), ("rs", "re")).collect() == []


def test_requests_share_windows(spark):
    headers = spark.createDataFrame(
        [("p1", "s", "timeseries", dt.datetime(2024, 1, 1), day(0), day(99), ["date"], None, False), ("p2", "s", "timeseries", dt.datetime(2024, 1, 2), day(50), day(60), ["date"], None, False)],
        "snapshot_id STRING, source_id STRING, kind STRING, retrieved_at TIMESTAMP, period_start DATE, period_end DATE, dimensions ARRAY<STRING>, filters MAP<STRING,STRING>, headline_safe BOOLEAN",
    )
    slices = spark.createDataFrame([("p1", day(i), "m", "") for i in range(100)] + [("p2", day(i), "m", "") for i in range(50, 61)], "snapshot_id STRING, date DATE, series STRING, segment STRING")
    none = F.array().cast("array<string>")
    asked = spark.range(2000).select(
        F.col("id").cast("string").alias("request_id"), F.lit("after").alias("label"), F.lit("s").alias("source_id"), F.lit("timeseries").alias("kind"),
        F.lit(day(45)).alias("period_start"), F.date_add(F.lit(day(45)), (F.col("id") % 10).cast("int")).alias("period_end"), none.alias("require"), none.alias("exclude"),
    )
    assert selection.distinct_windows(selection.with_window(asked)).count() == 10
    found = selection.select_slices(asked, headers, slices)
    owners = {(int(r.request_id) % 10, r.date, r.snapshot_id) for r in found.collect()}
    assert owners == {(n, day(d), "p2" if d >= 50 else "p1") for n in range(10) for d in range(45, 46 + n)}
    assert found.count() == sum(200 * (n + 1) for n in range(10))
