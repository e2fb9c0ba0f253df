"""The whole measurement job on small inputs with known answers."""

import math

import pytest

from helpers import days, evidence, metric, now, pull, request, requests, series_rows, source, stamp
from tidemark.plans.comparison import analyze

EIGHT = days("2026-08-01", 56)
DAILY = ["date", "metric"]


def run(spark, pulls, facts, metrics, asked, changes=(), sources=None, **options):
    sources = sources or [source("db")]
    result = analyze(evidence(spark, pulls, facts, metrics, sources, changes), requests(spark, *asked), now(), **options)
    rows = {r["request_id"]: r.asDict() for r in result["evidence"].collect()}
    issues = {(r["request_id"], r["label"], r["code"], r["severity"]) for r in result["issues"].collect()}
    return rows, issues, result


def test_many_requests_in_one_job(spark):
    pulls, facts = [], []

    def add(name, values, segment=None, retrieved="2026-10-01 06:00:00", series=None):
        pulls.append(pull(name, "db", "timeseries", EIGHT, DAILY + (["segment"] if segment else []), retrieved, {"segment": segment} if segment else None))
        facts.extend(series_rows(name, "db", series or name, EIGHT, values, segment))

    add("sessions", [100] * 56)
    add("signups", [5] * 56)
    add("late", [40 if i < 28 else 0 for i in range(56)])
    add("latency", [None if i == 3 else 100 for i in range(56)])
    add("aov", [50 if i < 28 else 55 for i in range(56)])
    add("baskets", [10] * 56)
    rising = [20 + (i % 3) if i < 28 else 30 + (i % 3) for i in range(56)]
    add("rising", rising)
    metrics = [
        metric("sessions", "db"),
        metric("conversion", "db", "ratio_of_sums", numerator="signups", denominator="sessions", scale=100.0),
        metric("late", "db", min_sample=20.0),
        metric("latency", "db", "mean"),
        metric("aov", "db", "weighted_mean", field="aov", weight="baskets"),
        metric("refunds", "db"),
        metric("rising", "db", aliases=["growth"]),
    ]
    change = dict(change_id="c1", deploy_status="deployed", type="product_release", pages=[], confirmed=True)
    changes = [{**change, "live_at": stamp("2026-08-28 12:00:00")}, {**change, "change_id": "old", "live_at": stamp("2026-05-01 00:00:00")}]
    asked = [request(m["metric_id"], m["metric_id"]) for m in metrics]
    asked += [request("growth", "linked", change_ids=["c1"]), request("rising", "early", change_ids=["old"])]
    rows, issues, _ = run(spark, pulls, facts, metrics, asked, changes)
    assert rows["sessions"]["before_value"] == 2800 and rows["sessions"]["data_quality"] == "high"
    assert rows["conversion"]["after_value"] == 5
    assert rows["late"]["data_quality"] == "insufficient" and rows["late"]["delta_abs"] is None
    assert ("late", "after", "sudden_zero", "blocking") in issues
    assert rows["late"]["causal_confidence"] == "none"
    assert rows["latency"]["before_value"] == 100
    assert ("latency", "before", "missing_values", "minor") in issues
    assert (rows["aov"]["before_value"], rows["aov"]["after_value"]) == (50, 55)
    assert rows["refunds"]["data_quality"] == "insufficient"
    assert rows["rising"]["method"] == "welch_daily" and rows["rising"]["evidence_strength"] == "high"
    assert rows["rising"]["causal_reason"] == "no registered change or experiment is linked"
    # the linked change falls on the last baseline day; the unlinked old one lies outside
    assert rows["linked"]["metric_id"] == "rising" and rows["linked"]["causal_confidence"] == "medium"
    assert rows["early"]["causal_reason"] == "linked change predates both compared periods"


def test_segments_add_and_a_new_pull_replaces_its_slice(spark):
    pulls = [
        pull("de", "db", "timeseries", EIGHT, [*DAILY, "segment"], filters={"segment": "de"}),
        pull("fr", "db", "timeseries", EIGHT, [*DAILY, "segment"], filters={"segment": "fr"}),
    ]
    facts = series_rows("de", "db", "orders", EIGHT, [100] * 56, "de") + series_rows("fr", "db", "orders", EIGHT, [300] * 56, "fr")
    metrics = [metric("orders", "db")]
    asked = [request("orders", "all"), request("orders", "only", scope={"segment": ["de"]})]
    rows, _, _ = run(spark, pulls, facts, metrics, asked, scope_sets=((), ("segment",)))
    assert rows["all"]["before_value"] == 11200 and rows["only"]["before_value"] == 2800
    pulls.append(pull("de2", "db", "timeseries", EIGHT, [*DAILY, "segment"], "2026-10-01 09:00:00", {"segment": "de"}))
    facts += series_rows("de2", "db", "orders", EIGHT, [110] * 56, "de")
    rows, _, _ = run(spark, pulls, facts, metrics, asked, scope_sets=((), ("segment",)))
    assert rows["all"]["before_value"] == 11480


def page_facts(start, count, boundary, lift=1.2, seasonal=1.3, trend=0.0, name="pages"):
    treated, pages = ("/pl/a", "/pl/b"), ("/pl/a", "/pl/b", "/pl/c", "/pl/d", "/pl/e", "/pl/f", "/de/x")
    rows = []
    for index, day in enumerate(days(start, count)):
        week = 1 + 0.08 * math.sin(index * 2 * math.pi / 7)
        for page in pages:
            hit, after = page in treated, index >= boundary
            drift = (1 + trend * index / boundary) if hit and not after else 1 + (trend if hit and after else 0)
            shown = math.floor(1000 * week * (seasonal if after else 1) + 0.5)
            clicks = math.floor(30 * week * (seasonal if after else 1) * (lift if hit and after else 1) * drift + 0.5)
            rows.append(
                dict(snapshot_id=name, source_id="gsc", kind="gsc_rows", date=day, page=f"https://www.example.test{page}/", clicks=clicks, impressions=shown, position=6)
            )
    return rows


def controlled(spark, rows, extra_rows=(), **options):
    from decimal import Decimal

    facts = [{**r, "position": Decimal(6)} for r in [*rows, *extra_rows]]
    pulls = [pull(n, "gsc", "gsc_rows", [f["date"] for f in facts if f["snapshot_id"] == n], ["date", "page"]) for n in sorted({f["snapshot_id"] for f in facts})]
    change = dict(
        change_id="c1", type="seo_content_update", deploy_status="deployed", live_at=stamp("2026-08-28 18:00:00"), pages=["/pl/a", "/pl/b"], confirmed=True
    )
    asked = [
        request("organic_clicks", "did", scope={"page": ["/pl/a", "/pl/b"]}, change_ids=["c1"]),
        {**request("organic_clicks", "plain", scope={"page": ["/pl/a", "/pl/b"]}, change_ids=["c1"]), "control": "none"},
    ]
    metrics = [metric("organic_clicks", "gsc", field="clicks", min_sample=50.0)]
    return run(spark, pulls, facts, metrics, asked, [change], [source("gsc", "gsc_rows")], **options)


def test_difference_in_differences_isolates_the_lift(spark):
    rows, _, result = controlled(spark, page_facts("2026-08-01", 56, 28))
    did, plain = rows["did"], rows["plain"]
    assert did["design"] == "difference_in_differences" and did["control_pages"] == 4
    assert did["pre_trend_passed"] and abs(did["did_effect"] - 26) < 3
    assert did["causal_confidence"] == "high"
    assert plain["design"] == "before_after" and plain["delta_pct"] > 50 and plain["causal_confidence"] == "medium"
    codes = {(r["request_id"], r["code"]) for r in result["confounders"].collect()}
    assert ("did", "demand_shift") not in codes and ("plain", "demand_shift") in codes


def test_diverging_trends_are_a_major_confounder(spark):
    rows, _, result = controlled(spark, page_facts("2026-08-01", 56, 28, trend=0.6))
    assert rows["did"]["pre_trend_passed"] is False and rows["did"]["causal_confidence"] != "high"
    codes = {(r["request_id"], r["code"], r["severity"]) for r in result["confounders"].collect()}
    assert ("did", "parallel_trends_violated", "major") in codes


def test_last_years_jump_explains_the_change(spark):
    rows, _, result = controlled(
        spark, page_facts("2026-08-01", 56, 28), page_facts("2025-08-02", 56, 28, lift=1, seasonal=1.5, name="pages-ly")
    )
    assert rows["plain"]["seasonal_checked"] and rows["plain"]["last_year_change_pct"] > 40
    assert rows["plain"]["causal_confidence"] == "low"
    found = {(r["request_id"], r["code"], r["severity"]) for r in result["confounders"].collect()}
    assert ("plain", "seasonal_pattern", "major") in found and ("did", "seasonal_pattern", "info") in found


def test_sources_that_disagree_lower_the_quality(spark):
    dates = days("2026-09-01", 14)
    db = [6, 7, 6, 7, 6, 7, 6, 7, 6, 7, 6, 7, 6, 7]
    ga = [8, 7, 7, 7, 7, 7, 7, 7, 7, 7, 7, 7, 7, 8]
    pulls = [pull("a", "db", "timeseries", dates, DAILY), pull("b", "ga4", "timeseries", dates, DAILY)]
    facts = series_rows("a", "db", "signups", dates, db) + series_rows("b", "ga4", "signups", dates, ga)
    windows = (dates[0], dates[6], dates[7], dates[13])
    metrics = [metric("signups", "db", fallback_sources=["ga4"])]
    rows, issues, result = run(spark, pulls, facts, metrics, [request("signups", windows=windows)], sources=[source("db", through="2026-09-14"), source("ga4", through="2026-09-14")])
    assert rows["r1"]["data_quality"] == "low" and rows["r1"]["before_value"] + rows["r1"]["after_value"] == 91
    assert result["discrepancies"].count() == 2


def test_unequal_windows_compare_per_day(spark):
    dates = days("2026-08-01", 61)
    windows = (dates[0], dates[29], dates[30], dates[60])
    rows, _, _ = run(
        spark, [pull("s", "db", "timeseries", dates, DAILY)], series_rows("s", "db", "m", dates, [10] * 61), [metric("m", "db")],
        [request("m", windows=windows)], sources=[source("db", through="2026-09-30")],
    )
    assert rows["r1"]["basis"] == "per_day" and rows["r1"]["delta_pct"] == 0


@pytest.mark.parametrize("kind", ["site", "page"])
def test_property_totals_prefer_a_headline_safe_grain(spark, kind):
    dates = days("2026-08-01", 56)
    pages = [
        dict(snapshot_id="p", source_id="gsc", kind="gsc_rows", date=d, page=page, clicks=5, impressions=100) for d in dates for page in ("/a", "/b")
    ]
    site = [dict(snapshot_id="s", source_id="gsc", kind="gsc_rows", date=d, clicks=12, impressions=150) for d in dates]
    pulls = [pull("p", "gsc", "gsc_rows", dates, ["date", "page"])]
    if kind == "site":
        pulls.append(pull("s", "gsc", "gsc_rows", dates, ["date"]))
        pages += site
    rows, issues, _ = run(
        spark, pulls, pages, [metric("organic_clicks", "gsc", field="clicks")],
        [request("organic_clicks"), request("organic_clicks", "scoped", scope={"page": ["/a"]})], sources=[source("gsc", "gsc_rows")],
    )
    assert rows["r1"]["before_value"] == (12 * 28 if kind == "site" else 10 * 28)
    assert (("r1", "before", "headline_unsafe", "major") in issues) is (kind == "page")
    assert rows["scoped"]["before_value"] == 5 * 28
