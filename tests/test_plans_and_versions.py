"""Prefix counts, versions as of a time, and plans that stay fixed, against plain restatements."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.operators import metrics, plans
from tidemark.operators.as_of import as_of, settings_as_of
from tidemark.operators.change_windows import count_in_windows, span_changes

FIRST = dt.date(2024, 1, 1)


def day(n):
    return FIRST + dt.timedelta(days=n)


def test_counts_and_spans(spark):
    draw = random.Random(3)
    changes = [(i, draw.choice("ab"), day(draw.randrange(60)) if draw.random() < 0.9 else None) for i in range(200)]
    windows = [(i, draw.choice("abc"), day(a := draw.randrange(-5, 65)), day(a + draw.randrange(-2, 20))) for i in range(150)] + [(900, "a", None, day(5)), (901, "a", day(5), None)]
    c = spark.createDataFrame(changes, "change_id INT, page STRING, date DATE")
    w = spark.createDataFrame(windows, "w INT, page STRING, start DATE, end DATE")
    inside = lambda d, s, e: bool(d and s and e and s <= d <= e)
    got = {r.w: r.n_changes for r in count_in_windows(c, w).collect()}
    assert got == {n: sum(inside(d, s, e) for _, _, d in changes) for n, _, s, e in windows}
    got = {r.w: r.n_changes for r in count_in_windows(c, w, ["page"]).collect()}
    assert got == {n: sum(inside(d, s, e) and p == q for _, q, d in changes) for n, p, s, e in windows}
    spans = {(s, e) for _, _, s, e in windows}
    got = sorted((r.start, r.end, r.change_id) for r in span_changes(c, w).collect())
    assert got == sorted((s, e, i) for s, e in spans for i, _, d in changes if inside(d, s, e))
    assert count_in_windows(c.where("false"), w).agg(F.sum("n_changes")).first()[0] == 0


def test_versions_valid_at_a_time(spark):
    draw = random.Random(4)
    moment = lambda n: dt.datetime(2023, 1, 1) + dt.timedelta(hours=n)
    versions = [(draw.choice(["m1", "m2", "hot"]), moment(draw.randrange(9000)), i) for i in range(60)] + [("m1", None, 99), ("m2", moment(10), 70), ("m2", moment(10), 71)]
    asked = [(i, draw.choice(["m1", "hot", "hot", "m2", "none", None]), moment(draw.randrange(-100, 9500)) if i % 20 else None) for i in range(800)]
    v = spark.createDataFrame(versions, "metric_id STRING, since TIMESTAMP, version INT")
    r = spark.createDataFrame(asked, "request_id INT, metric_id STRING, at TIMESTAMP")
    got = {x.request_id: x.version for x in as_of(r, v, "metric_id", "at", "since", ["version"]).collect()}

    def want(metric, at):
        fine = [(s, n) for m, s, n in versions if m == metric and s and at and s <= at]
        return max(fine)[1] if fine else None

    assert got == {i: want(m, at) for i, m, at in asked}


def test_two_versions_give_two_answers_in_one_run(spark):
    config = spark.createDataFrame([("fdr", 0.05, day(10)), ("fdr", None, day(20)), ("other", 1.0, day(0))], "name STRING, value DOUBLE, since DATE")
    asked = spark.createDataFrame([(1, day(9)), (2, day(10)), (3, day(25)), (4, None)], "id INT, at DATE")
    got = {r.id: (r.fdr, r.min_clicks) for r in settings_as_of(asked, config, {"fdr": 0.1, "min_clicks": 5.0}).collect()}
    assert got == {1: (0.1, 5.0), 2: (0.05, 5.0), 3: (0.1, 5.0), 4: (0.1, 5.0)}


def test_plans_are_fixed(spark):
    windows = "experiment_id STRING, before_start DATE, before_end DATE, after_start DATE, after_end DATE"
    experiments = spark.createDataFrame([(e, day(0), day(9), day(10), day(19)) for e in ("e1", "e2", "e3")], windows)
    controls = spark.createDataFrame([("e1", "/a"), ("e1", "/b"), ("e1", "/b"), ("e2", "/a")], "experiment_id STRING, page STRING")
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    made, pages = plans.fix_plans(experiments, controls, None, now)
    assert {r.experiment_id: r.n_pages for r in made.collect()} == {"e1": 2, "e2": 1, "e3": 0}
    # planning again with more pages changes nothing: each has its plan
    again, more = plans.fix_plans(experiments, controls.unionByName(spark.createDataFrame([("e1", "/new")], controls.schema)), made, now)
    assert again.count() == 0 and more.count() == 0
    facts = spark.createDataFrame([(p, day(d), 1) for p in ("/a", "/b", "/new") for d in range(25)], "page STRING, date DATE, impressions INT")
    tampered = pages.unionByName(spark.createDataFrame([("e2", "/new")], pages.schema))
    got = {r.experiment_id: (r.plan_status, r.before_total, r.after_total) for r in plans.evaluate_plans(made, tampered, facts).collect()}
    assert got == {"e1": ("fixed", 20, 20), "e2": ("changed", None, None), "e3": ("fixed", None, None)}
    lost = pages.where("page <> '/b'")
    assert {r.experiment_id for r in plans.checked_pages(made, lost)[1].where("plan_status = 'changed'").collect()} == {"e1"}


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_pages_of_a_plan_are_chosen_once(spark):
    asked = spark.createDataFrame([("e", "x")], "experiment_id STRING, z STRING").select("experiment_id", *[F.lit(d).cast("date").alias(n) for n, d in zip(plans.WINDOWS, ("2024-01-01", "2024-01-02", "2024-01-03", "2024-01-04"))])
    chosen = spark.range(3).selectExpr("'e' AS experiment_id", "concat('/p', id) AS page")
    made, pages = plans.fix_plans(asked, chosen, None, F.lit("2024-01-05").cast("timestamp"))
    held, judged = plans.checked_pages(made, pages)
    assert "Join" not in _plan(pages) and "Join" not in _plan(judged)  # stored, not derived again by each reader
    assert judged.first().plan_status == "fixed" and held.count() == 3


def test_few_spans_are_broadcast(spark):
    changes = spark.range(10).selectExpr("id AS change_id", "date_add(DATE '2024-01-01', CAST(id AS INT)) AS date")
    spans = spark.createDataFrame([("2024-01-02", "2024-01-04")], "a STRING, b STRING").selectExpr("CAST(a AS DATE) AS start", "CAST(b AS DATE) AS `end`")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = span_changes(changes, spans)
        assert "BroadcastHashJoin" in _plan(found) and "SortMergeJoin" not in _plan(found)
        assert sorted(r.change_id for r in found.collect()) == [1, 2, 3]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_facts_of_one_source_meet_the_dictionary_without_a_product(spark):
    facts = spark.range(4).select(F.lit("gsc").alias("source_id"), F.lit("gsc_rows").alias("kind"), F.col("id").alias("clicks"))
    names = ("source_id", "metric_id", "aggregation", "field", "series_field", "numerator", "denominator", "weight", "scale")
    one = spark.createDataFrame([("gsc", "m", "sum", "clicks", None, None, None, None, 1.0), ("db", "n", "sum", "value", None, None, None, None, 1.0)], ", ".join(f"{n} {'DOUBLE' if n == 'scale' else 'STRING'}" for n in names))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = metrics.join_mappings(facts, one)
        assert "CartesianProduct" not in _plan(met)
        assert sorted((r.clicks, r.metric_id) for r in met.collect()) == [(i, "m") for i in range(4)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
