"""Operators on small inputs with known answers, and against plain-Python versions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ledger, monitors, quality, search, selection, site
from tidemark.operators.fdr import fdr_keep
from tidemark.plans.skew import lookup_join
from tidemark.sources import adapters, changelog, html, readers

SEARCH = "query STRING, page STRING, impressions BIGINT, clicks BIGINT, position DOUBLE"


def naive_keep(values, q):
    order = sorted(range(len(values)), key=lambda i: values[i])
    last = max([r for r, i in enumerate(order) if values[i] <= (r + 1) / len(values) * q], default=-1)
    return {i for r, i in enumerate(order) if r <= last}


def test_false_discovery_textbook(spark):
    p = [0.0001, 0.0004, 0.0019, 0.0095, 0.0201, 0.0278, 0.0298, 0.0344, 0.0459, 0.3240, 0.4262, 0.5719, 0.6528, 0.7590, 1.0]
    kept = fdr_keep(spark.createDataFrame(list(enumerate(p)), "i INT, p_value DOUBLE"), q=0.05).where("keep")
    assert {r["i"] for r in kept.collect()} == {0, 1, 2, 3}


def test_false_discovery_per_family_against_the_ranked_form(spark):
    rng = random.Random(5)
    families = {f: [round(rng.random() ** rng.choice([1, 3, 8]), rng.choice([2, 6])) for _ in range(rng.randint(1, 120))] for f in range(12)}
    families[99] = [0.0] * 300 + [0.5] * 100
    rows = [(f, i, v) for f, vs in families.items() for i, v in enumerate(vs)]
    tests = spark.createDataFrame(rows, "family INT, i INT, p DOUBLE").repartition(5, "p")
    got = {}
    for r in fdr_keep(tests, "p", 0.1, ["family"]).where("keep").collect():
        got.setdefault(r["family"], set()).add(r["i"])
    assert got == {f: k for f, vs in families.items() if (k := naive_keep(vs, 0.1))}


def test_lookup_join_keeps_every_row_of_a_hot_key(spark):
    rows = [("hot" if i % 3 else f"k{i}" if i % 6 else None, i) for i in range(3000)]
    left = spark.createDataFrame(rows, "key STRING, i INT")
    right = left.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n")).where("n <> 7")
    for weight in (None, "n"):
        got = {r["i"]: r["n"] for r in lookup_join(left, right, ["key"], weight=weight, hot_keys=2).collect()}
        counts = {r["key"]: r["n"] for r in right.collect()}
        assert got == {i: counts.get(k) for k, i in rows}


def pooled(points):
    blocks = [[c * w, w, 1] for c, w in points]
    i = 0
    while i < len(blocks) - 1:
        if blocks[i][0] / blocks[i][1] < blocks[i + 1][0] / blocks[i + 1][1]:
            blocks[i] = [a + b for a, b in zip(blocks[i], blocks.pop(i + 1))]
            i = max(0, i - 1)
        else:
            i += 1
    return [s / w for s, w, n in blocks for _ in range(n)]


def test_curve_is_fitted_pooled_and_falls_back(spark):
    rows = [
        (f"q{p}-{k}", "/p", 400, int(400 * (0.08 if p == 6 else 0.3 / p) + 0.5), float(p)) for p in range(1, 11) for k in range(6)
    ]
    fit = search.fit_ctr_curve(spark.createDataFrame(rows, SEARCH)).first()
    ys = fit["curve"]["ys"]
    assert fit["source"] == "fitted" and fit["fitted_buckets"] == 10
    assert all(a >= b for a, b in zip(ys, ys[1:])) and abs(ys[0] - 30) < 0.5
    heuristic = [1.6, 1.4, 1.2, 1.1, 1.0, 0.92, 0.84, 0.76, 0.68, 0.6]
    points = [(sum(r[3] for r in rows if r[4] == p) / 2400 * 100, 2400) for p in range(1, 11)] + [(h, 50) for h in heuristic]
    assert ys[:20] == pytest.approx(pooled(points), abs=6e-4)


def test_opportunities_are_ranked_and_significant(spark):
    rows = [("big", "/a", 20000, 100, 6.0), ("small", "/b", 800, 4, 6.0), ("borderline", "/c", 520, 10, 9.0)]
    found = search.ctr_opportunities(spark.createDataFrame(rows, SEARCH), days=28).orderBy(F.desc("estimated_click_gain_28d")).collect()
    assert [r["query"] for r in found] == ["big", "small"]
    assert found[0]["estimated_click_gain_28d"] > found[1]["estimated_click_gain_28d"] * 10 and found[0]["p_value"] < 0.05


def test_winners_leave_out_chance_moves(spark):
    rng = random.Random(7)
    noise = lambda: max(0, int(8 + (rng.random() - 0.5) * 8 + 0.5))
    before = [(f"noise-{i}", 300, noise(), 8.0) for i in range(200)]
    after = [(f"noise-{i}", 300, noise(), 8.0) for i in range(200)]
    for name, b, a in (("real-win", 40, 160), ("real-drop", 150, 20), ("real-win-2", 60, 180)):
        before.append((name, 3000, b, 5.0))
        after.append((name, 3000, a, 5.0))
    schema = "query STRING, impressions BIGINT, clicks BIGINT, position DOUBLE"
    moves = search.snapshot_movement(spark.createDataFrame(before, schema), spark.createDataFrame(after, schema), ["query"])
    sides = [(r["side"], r["query"]) for r in search.winners_and_decliners(moves, ["query"]).orderBy("side", "rank").collect()]
    assert sides == [("declining", "real-drop"), ("winning", "real-win"), ("winning", "real-win-2")]


def test_cannibalization_lists_competing_pages(spark):
    rows = [("q", "/a", 500, 10, 8.0), ("q", "/b", 300, 5, 11.0), ("q", "/c", 200, 1, 17.0), ("q", "/far", 400, 1, 80.0), ("one", "/a", 900, 9, 3.0)]
    rows += [("q", f"/tail-{i}", 1, 0, 5.0) for i in range(200)]
    found = search.cannibalization(spark.createDataFrame(rows, SEARCH)).collect()
    assert [(r["query"], [(u["page"], u["avg_position"]) for u in r["urls"]]) for r in found] == [("q", [("/a", 8.0), ("/b", 11.0), ("/c", 17.0)])]
    assert found[0]["contested_impressions"] == 500 and found[0]["query_impressions"] == 1600


RANKS = "keyword STRING, location STRING, device STRING, engine STRING, position DOUBLE, url STRING, serp_features ARRAY<STRING>, observed_at STRING, provider STRING"


def test_rank_changes(spark):
    row = lambda k, p, u, f=(): (k, "RO", "mobile", "google", p, u, list(f), "2026-09-22", "x")
    old = [row("calc", 9.0, "/c/", ["paa"]), row("micro", 8.0, "/c/"), row("pfa", 30.0, "/b"), row("new", None, ""), row("gone", 3.0, "/g")]
    new = [row("Calc", 7.0, "/c", ["paa", "snippet"]), row("micro", 21.0, "/m"), row("pfa", None, None), row("new", 18.0, "/c")]
    got = {r["keyword"].lower(): r for r in search.rank_changes(spark.createDataFrame(old, RANKS), spark.createDataFrame(new, RANKS)).collect()}
    assert {k: r["movement"] for k, r in got.items()} == {"calc": "improved", "micro": "dropped", "pfa": "lost", "new": "new", "gone": "not_observed"}
    assert got["calc"]["features_added"] == ["snippet"] and not got["calc"]["url_changed"]
    assert got["micro"]["delta"] == 13 and got["micro"]["alert"] and got["micro"]["url_changed"] and got["pfa"]["alert"] and not got["gone"]["alert"]


CRAWL_CSV = """url,status,redirect_to,redirect_hops,canonical,title,meta_description,robots,in_sitemap,inlinks
https://e.test/calc/,200,,0,https://e.test/calc/,Calc,"Same, text",index follow,true,14
https://e.test/micro/,200,,0,https://e.test/micro/,Micro,"Same, text",index follow,true,6
https://e.test/guide/,200,,0,https://e.test/calc/,Guide,,index follow,true,9
https://e.test/old/,301,https://e.test/archive/,2,,,,,true,3
https://e.test/archive/,404,,0,,,,,false,1
https://e.test/tag/,200,,0,https://e.test/tag/,micro,Tag,noindex follow,true,2
https://e.test/landing/,200,,0,https://e.test/landing/,Landing,Old,index follow,true,0
"""


def test_crawl_findings_from_csv(spark, tmp_path):
    (tmp_path / "crawl.csv").write_text(CRAWL_CSV)
    rows = adapters.crawl(readers.read_csv(spark, str(tmp_path / "crawl.csv")))
    counts = {r["code"]: r["n"] for r in site.count_by(site.technical_findings(rows), "code").collect()}
    assert counts == {
        "client_error": 1, "redirect_chain": 1, "missing_meta_description": 1, "canonical_mismatch": 1, "noindex_in_sitemap": 1,
        "non_200_in_sitemap": 1, "orphan_page": 1, "duplicate_title": 2, "duplicate_meta_description": 2,
    }


def test_page_speed_regressions(spark):
    schema = "url STRING, form_factor STRING, lcp_p75_ms DOUBLE, inp_p75_ms DOUBLE, cls_p75 DOUBLE"
    now = spark.createDataFrame([("/a", "phone", 2400.0, 100.0, 0.01), ("/b/", "phone", 3100.0, 190.0, None)], schema)
    old = spark.createDataFrame([("/a/", "phone", 1900.0, 100.0, 0.01), ("/b", "phone", 2300.0, 180.0, 0.05)], schema)
    worse = {(r["url"], r["metric"]): (r["change_pct"], r["status"]) for r in site.cwv_findings(now, old).where("regressed").collect()}
    assert worse == {("/a", "lcp_p75_ms"): (26.3, "good"), ("/b/", "lcp_p75_ms"): (34.8, "needs_improvement")}


def test_html_fields(spark):
    page = """<html><head><TITLE> A &amp; B </TITLE><link rel="canonical" href="https://e.test/a"><meta name='robots' content='noindex'><meta name="description" content="d &#39;x&#39;"></head>"""
    got = html.page_fields(spark.createDataFrame([(page,)], "html STRING")).drop("html").first().asDict()
    assert got == {"canonical": "https://e.test/a", "title": "A & B", "meta_description": "d 'x'", "robots": "noindex"}


def test_json_envelopes_and_positional_keys(spark):
    docs = spark.createDataFrame([('{"rows":[{"keys":["q","/p"],"clicks":"3","impressions":"1,000","ctr":"0.3%","position":"8.7"}]}',), ('[{"keys":["r","/s"],"clicks":""}]',)], "body STRING")
    raw = readers.json_rows(docs, "body", "struct<keys:array<string>,clicks:string,impressions:string,ctr:string,position:string>")
    rows = {r["query"]: r for r in adapters.search_rows(raw, ["query", "page"]).collect()}
    assert (rows["q"]["page"], rows["q"]["clicks"], rows["q"]["impressions"], float(rows["q"]["position"])) == ("/p", 3, 1000, 8.7)
    assert rows["r"]["clicks"] is None and rows["r"]["impressions"] is None


def test_behaviour_is_weighted_by_sessions(spark):
    blocks = [
        ("Traffic", "https://e.test/a/", "Mobile", "300", None), ("Traffic", "https://e.test/a/", "PC", "100", None),
        ("DeadClickCount", "https://e.test/a/", "Mobile", None, "10"), ("DeadClickCount", "https://e.test/a/", "PC", None, "2"),
    ]
    frame = spark.createDataFrame([(n, u, d, s, None, None, p) for n, u, d, s, p in blocks], "metric_name STRING, url STRING, device STRING, sessions STRING, scroll_depth STRING, active_time STRING, pct STRING")
    pages = spark.createDataFrame([("/a",), ("/z",)], "page STRING")
    got = {r["page"]: (r["sessions"], r["dead_click_pct"], r["missing"]) for r in site.behavior_context(adapters.behavior(frame), pages).collect()}
    assert got == {"/a": (400, 8.0, False), "/z": (None, None, True)}


def test_sudden_zero(spark):
    rows = [("s", dt.date(2026, 9, i + 1), v) for i, v in enumerate([10, 12, 11, 0, 0, 9])] + [("t", dt.date(2026, 9, i + 1), v) for i, v in enumerate([1, 2, 0, 0])]
    got = quality.sudden_zero(spark.createDataFrame(rows, "k STRING, date DATE, value INT"), ["k"]).collect()
    assert [(r["k"], str(r["first_zero"])) for r in got] == [("s", "2026-09-04")]


def test_undated_pull_answers_its_own_period_only(spark):
    day = dt.date.fromisoformat
    heads = [("u1", "gsc", "gsc_rows", dt.datetime(2026, 9, 1), day("2026-08-01"), day("2026-08-28"), ["query"], None, False)]
    snapshots = spark.createDataFrame(heads, "snapshot_id STRING, source_id STRING, kind STRING, retrieved_at TIMESTAMP, period_start DATE, period_end DATE, dimensions ARRAY<STRING>, filters MAP<STRING,STRING>, headline_safe BOOLEAN")
    slices = spark.createDataFrame([("u1", None, "", "")], "snapshot_id STRING, date DATE, series STRING, segment STRING")
    asked = [("same", "x", "gsc", "gsc_rows", day("2026-08-01"), day("2026-08-28"), [], []), ("part", "x", "gsc", "gsc_rows", day("2026-08-01"), day("2026-08-14"), [], []), ("none", "x", "gsc", "gsc_rows", day("2027-01-01"), day("2027-01-14"), [], [])]
    requests = spark.createDataFrame(asked, "request_id STRING, label STRING, source_id STRING, kind STRING, period_start DATE, period_end DATE, require ARRAY<STRING>, exclude ARRAY<STRING>")
    found = selection.select_slices(requests, snapshots, slices)
    assert [(r["request_id"], r["expect_daily"]) for r in found.collect()] == [("same", False)]
    notes = {r["request_id"]: r["note"] for r in selection.selection_notes(requests, snapshots, found).collect()}
    assert notes == {"part": "only undated snapshots with a different period exist", "none": "no snapshot covers this period"}


def test_monitor_guards(spark):
    schema = "monitor_id STRING, aggregation STRING, before_value DOUBLE, after_value DOUBLE, before_sample DOUBLE, after_sample DOUBLE, delta_abs DOUBLE, delta_pct DOUBLE, statistic DOUBLE, data_quality STRING, min_sample DOUBLE, metric_id STRING, source_id STRING"
    rows = [
        ("drop", 141.0, 84.0, -9.1), ("noise", 140.0, 134.0, -0.7), ("small", 21.0, 6.0, -4.0), ("gone", 141.0, 0.0, -30.0),
    ]
    compared = spark.createDataFrame([(m, "sum", b, a, b, a, a - b, round((a - b) / b * 100, 2), z, "high", 50.0, "m", "s") for m, b, a, z in rows], schema)
    rules = spark.createDataFrame([(m, "m", "s", 25.0, 10.0, 50.0, 2.0, "decrease", "medium", True) for m in ("drop", "noise", "small", "gone", "ghost")], "monitor_id STRING, metric_id STRING, source_id STRING, relative_threshold_pct DOUBLE, absolute_threshold DOUBLE, min_sample DOUBLE, min_significance DOUBLE, direction STRING, severity STRING, enabled BOOLEAN")
    got = {r["monitor_id"]: (r["outcome"], r["kind"]) for r in monitors.evaluate_monitors(rules, compared).collect()}
    assert got == {
        "drop": ("alert", "threshold_breach"), "noise": ("quiet", None), "small": ("quiet", None), "gone": ("alert", "tracking_break"), "ghost": ("misconfigured", None),
    }


def test_ledger_import_and_deploy(spark):
    schema = "change_id STRING, origin_ref STRING, live_at TIMESTAMP, deploy_status STRING, confirmed BOOLEAN, supersedes STRING"
    changes = spark.createDataFrame([("a", "r1", None, "pending", False, None), ("b", "r2", None, "pending", False, None)], schema)
    live = spark.createDataFrame([("a", dt.datetime(2026, 9, 1))], "change_id STRING, deployed_at TIMESTAMP")
    after = changes.unionByName(ledger.deploy(changes, live))
    current = {r["origin_ref"]: r["deploy_status"] for r in selection.active_records(after, "change_id").collect()}
    assert current == {"r1": "deployed", "r2": "pending"}
    assert ledger.deploy(selection.active_records(after, "change_id").select(*schema_names(schema)), relink(after, live)).count() == 0
    new = spark.createDataFrame([("r1", dt.datetime(2026, 9, 2)), ("r3", dt.datetime(2026, 9, 2)), ("r3", dt.datetime(2026, 9, 2))], "origin_ref STRING, live_at TIMESTAMP")
    assert [r["origin_ref"] for r in ledger.import_changes(new, after).collect()] == ["r3"]


def test_equal_rows_of_a_change_log_all_count(spark):
    rows = [("Deploy", "2026-09-01", "/a", k) for k in (1, 2, 2, 2, 3)]
    log = spark.createDataFrame(rows, "title STRING, deployed_at STRING, pages STRING, task INT")
    found = changelog.change_log(log, "log.csv", carry=["task"])
    refs = [r["origin_ref"] for r in found.collect()]
    assert len(set(refs)) == 5 and all(len(ref.rpartition(":")[2]) == 64 for ref in refs)
    held = changelog.change_log(log.limit(2), "log.csv").select(F.col("origin_ref").alias("change_id"), F.lit(None).cast("string").alias("supersedes"), "origin_ref")
    assert sorted(r["task"] for r in ledger.import_changes(found, held).collect()) == [2, 2, 3]


def schema_names(schema):
    return [part.split(" ")[0] for part in schema.split(", ")]


def relink(after, live):
    """The deployment addressed to the current record of its chain."""
    ends = selection.resolve_chains(after, "change_id")
    return live.join(ends, "change_id").select(F.col("current_id").alias("change_id"), "deployed_at")


def test_digest_ignores_order_and_sees_changes(spark):
    rows = [("s", i, float(i)) for i in range(50)]
    frame = spark.createDataFrame(rows, "snapshot_id STRING, i INT, v DOUBLE")
    digest = lambda f: ledger.rows_digest(f, ["snapshot_id"], F.sha2(F.concat_ws("|", "i", "v"), 256)).first()["digest"]
    assert digest(frame) == digest(frame.repartition(7)) != digest(frame.where("i <> 3"))


def test_digest_sums_equal_those_of_whole_quarters(spark):
    rows = spark.range(500).select((F.col("id") % 7).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    rows = rows.withColumn("h", F.when(F.col("k") == 3, F.lit("f" * 64)).when(F.col("k") == 4, F.lit("0" * 64)).when((F.col("k") == 5), F.lit(None)).otherwise(F.col("h")))
    quarter = lambda i: F.sum(F.conv(F.substring("h", 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)")).cast("string")
    want = rows.groupBy("k").agg(F.count(F.lit(1)).alias("rows"), *[quarter(i).alias(f"q{i}") for i in range(4)])
    want = want.select("k", "rows", F.sha2(F.concat_ws(":", "rows", "q0", "q1", "q2", "q3"), 256).alias("digest"))
    found = ledger.rows_digest(rows, ["k"], F.col("h"))
    assert sorted(found.collect()) == sorted(want.collect())
    # no decimal is added up row by row
    assert "decimal(20,0)" not in found._jdf.queryExecution().optimizedPlan().toString()
