"""Schemas of snapshots, observation rows and ledgers, as DDL text."""

from __future__ import annotations


def column_names(ddl: str) -> list[str]:
    """Column names of one of the schemas below."""
    return [part.split(" ")[0] for part in ddl.split(", ")]


#: one row per pull
SNAPSHOTS = (
    "snapshot_id STRING, source_id STRING, kind STRING, adapter STRING, adapter_version INT, property STRING, "
    "retrieved_at TIMESTAMP, period_start DATE, period_end DATE, dimensions ARRAY<STRING>, filters MAP<STRING,STRING>, "
    "headline_safe BOOLEAN, row_count BIGINT, rows_hash STRING, warnings ARRAY<STRING>"
)

#: rows of the two kinds that can supply metric values
FACTS = (
    "snapshot_id STRING, source_id STRING, kind STRING, date DATE, query STRING, page STRING, country STRING, device STRING, "
    "segment STRING, series STRING, value DOUBLE, clicks BIGINT, impressions BIGINT, ctr DOUBLE, position DECIMAL(9,2)"
)

RANKINGS = (
    "keyword STRING, location STRING, device STRING, engine STRING, position DECIMAL(6,1), url STRING, "
    "serp_features ARRAY<STRING>, observed_at TIMESTAMP, provider STRING"
)
CRAWL = (
    "url STRING, status INT, redirect_to STRING, redirect_hops INT, canonical STRING, title STRING, meta_description STRING, "
    "robots STRING, in_sitemap BOOLEAN, inlinks INT, structured_data_errors INT"
)
CWV = ("url STRING, form_factor STRING, lcp_p75_ms DOUBLE, inp_p75_ms DOUBLE, cls_p75 DOUBLE, date DATE")
INDEXATION = (
    "url STRING, verdict STRING, coverage_state STRING, google_canonical STRING, user_canonical STRING, "
    "last_crawl TIMESTAMP, in_sitemap BOOLEAN"
)
BEHAVIOR = (
    "url STRING, device STRING, sessions BIGINT, dead_click_pct DOUBLE, rage_click_pct DOUBLE, quickback_pct DOUBLE, "
    "excessive_scroll_pct DOUBLE, error_click_pct DOUBLE, script_error_pct DOUBLE, scroll_depth_pct DOUBLE, active_time_s DOUBLE"
)

METRICS = (
    "metric_id STRING, status STRING, version INT, unit STRING, tier STRING, aggregation STRING, field STRING, series STRING, "
    "numerator STRING, denominator STRING, weight STRING, scale DOUBLE, canonical_source STRING, fallback_sources ARRAY<STRING>, "
    "min_sample DOUBLE, overdispersion DOUBLE, tolerance_pct DOUBLE, definition STRING, aliases ARRAY<STRING>"
)
#: per-source overrides of a metric's mapping; NULL keeps the metric's own value
METRIC_OVERRIDES = (
    "metric_id STRING, source_id STRING, aggregation STRING, field STRING, series STRING, numerator STRING, denominator STRING, "
    "weight STRING, scale DOUBLE"
)
SOURCES = (
    "source_id STRING, type STRING, adapter STRING, kind STRING, timezone STRING, status STRING, stale_after_hours DOUBLE, "
    "data_through DATE, last_success_at TIMESTAMP, last_error_at TIMESTAMP, last_error STRING"
)
CHANGES = (
    "change_id STRING, title STRING, live_at TIMESTAMP, deploy_status STRING, applied_at TIMESTAMP, origin STRING, origin_ref STRING, "
    "type STRING, pages ARRAY<STRING>, experiment_id STRING, confirmed BOOLEAN, recorded_at TIMESTAMP, supersedes STRING"
)
MONITORS = (
    "monitor_id STRING, metric_id STRING, source_id STRING, window_days INT, relative_threshold_pct DOUBLE, absolute_threshold DOUBLE, "
    "min_sample DOUBLE, min_significance DOUBLE, direction STRING, severity STRING, enabled BOOLEAN, scope MAP<STRING,ARRAY<STRING>>"
)
REQUESTS = (
    "request_id STRING, metric_id STRING, source_id STRING, before_start DATE, before_end DATE, after_start DATE, after_end DATE, "
    "scope MAP<STRING,ARRAY<STRING>>, change_ids ARRAY<STRING>, experiment_id STRING, design STRING, control STRING, "
    "control_pages ARRAY<STRING>, context_refs ARRAY<STRING>"
)
