"""The search audit and its ledger rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators.ledger import append_open
from tidemark.plans.search_audit import finding_rows, recordable, search_audit

BEFORE, AFTER = ("2026-08-01", "2026-08-28"), ("2026-08-29", "2026-09-25")


def test_audit_findings_are_recorded_once(spark):
    day = dt.date.fromisoformat
    rows = []
    for window, clicks in ((BEFORE, 70), (AFTER, 5)):
        rows.append((day(window[0]), "big", "https://e.test/a/", 20000, 100, 6.0))
        rows.append((day(window[1]), "decayed", "/old", 3000, clicks, 5.0))
        rows += [(day(window[0]), "shared", page, 400, 30, position) for page, position in (("/x", 4.0), ("/y", 9.0))]
    frame = spark.createDataFrame(rows, "date DATE, query STRING, page STRING, impressions BIGINT, clicks BIGINT, position DOUBLE")
    audit = search_audit(frame, BEFORE, AFTER)
    assert audit["ctr_opportunities"].where("query = 'big' AND page = '/a'").count() == 1
    assert [r["page"] for r in audit["content_decay"].collect()] == ["/old"]
    findings = recordable(finding_rows(audit))
    keys = {r["dedupe_key"] for r in findings.collect()}
    assert {"ctr:big:/a", "decay:/old", "cannibalization:shared"} <= keys
    ledger = spark.createDataFrame([(k, "open") for k in keys], "dedupe_key STRING, status STRING")
    assert append_open(findings, ledger).isEmpty()
    assert append_open(findings, ledger.withColumn("status", F.lit("dismissed"))).count() == len(keys)


@pytest.mark.parametrize("name", ["control_pages_all_days", "planned_controls_all_days", "new_and_lost_all_days", "rank_changes_all_days", "rank_summary_all_days"])
def test_queries_of_all_days_equal_their_sql(spark, name):
    from check_catalog import compare

    from tidemark.catalog import load

    registry = load()
    assert "DATE '1995-01-02'" in registry.CHECKS[name] and "2001-07-" not in registry.CHECKS[name]
    assert compare(spark, "/root/testdata/sf0.001", name, registry.QUERIES[name], registry.CHECKS[name])[0] == "equal"
