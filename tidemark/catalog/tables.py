"""The test tables and the views derived from them.

A view is one SQL text that both Spark and the checking engine read, but for ``SPARK_VIEWS``. Every
view covers its whole base tables, so its rows grow with them.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

BASE = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

#: The two windows used throughout; together they cover every row.
BEFORE = ("1995-01-02", "1998-06-03")
AFTER = ("1998-06-04", "2001-11-04")
BEFORE_DAYS, AFTER_DAYS = 1249, 1250

VIEWS: dict[str, str] = {
    # search rows: date x query x page x country
    "search_rows": """
SELECT CAST(l_shipdate AS DATE) AS date, p_name AS query,
 '/' || lower(p_type) || '/' || lower(replace(p_brand, '#', '-')) AS page, n_name AS country,
 CAST(floor(l_quantity * 10) AS BIGINT) AS impressions,
 CAST(floor(l_quantity * 10 * l_discount) AS BIGINT) AS clicks,
 CAST((l_partkey * 7 + l_linenumber) % 30 + 1 AS BIGINT) AS position
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    # one page per part, with a click rate that differs by part and falls for some parts in the second window
    "detail_rows": """
SELECT CAST(l_shipdate AS DATE) AS date, p_name AS query,
 '/' || lower(substr(p_type, 1, 2)) || '/part-' || CAST(l_partkey AS VARCHAR(20)) AS page, n_name AS country,
 CAST(floor(l_quantity * 10) AS BIGINT) AS impressions,
 CAST(floor(l_quantity * 10 * l_discount / (1 + l_partkey % 4 + CASE WHEN l_partkey % 10 = 3 AND l_shipdate >= DATE '1998-06-04' THEN 2 ELSE 0 END)) AS BIGINT) AS clicks,
 CAST((l_partkey * 7 + l_linenumber) % 30 + 1 AS BIGINT) AS position
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    # time series: metric x day
    "series": """
SELECT CAST(ts AS DATE) AS date, event_type AS metric, COUNT(*) AS value FROM events GROUP BY CAST(ts AS DATE), event_type""",
    # a second source that disagrees
    "series_alt": """
SELECT CAST(ts AS DATE) AS date, event_type AS metric, COUNT(*) AS value FROM events WHERE event_id % 11 <> 0 GROUP BY CAST(ts AS DATE), event_type""",
    # daily counts per user, with zero days inside each user's span, for run detection
    "user_daily": """
SELECT u.user_id, d.date, COALESCE(c.value, 0) AS value
FROM (SELECT user_id, MIN(CAST(ts AS DATE)) AS lo, MAX(CAST(ts AS DATE)) AS hi FROM events GROUP BY user_id) u
JOIN (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events) d ON d.date >= u.lo AND d.date <= u.hi
LEFT JOIN (SELECT user_id, CAST(ts AS DATE) AS date, COUNT(*) AS value FROM events GROUP BY user_id, CAST(ts AS DATE)) c
 ON c.user_id = u.user_id AND c.date = d.date""",
    # change registry; page NULL means unknown scope
    "changes": """
SELECT o_orderkey AS change_id, CAST(o_orderdate AS DATE) AS live_date,
 CASE o_orderstatus WHEN 'F' THEN 'deployed' WHEN 'O' THEN 'pending' ELSE 'unknown' END AS deploy_status,
 CASE WHEN o_orderkey % 5 = 0 THEN 'tracking_change' ELSE 'content_update' END AS type,
 CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE page END AS page
FROM orders JOIN (SELECT l_orderkey, MIN('/' || lower(p_type) || '/' || lower(replace(p_brand, '#', '-'))) AS page FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey) x ON o_orderkey = l_orderkey""",
    # two pulls of the search rows; the second restates 2001
    "pulls": """
SELECT 1 AS pull_id, DATE '2002-01-01' AS retrieved_at, s.* FROM search_rows s
UNION ALL SELECT 2, DATE '2002-01-02', date, query, page, country, impressions, clicks + 1, position FROM search_rows WHERE date >= DATE '2001-01-01'""",
}

#: Views that Spark reads in words of its own: the same rows, without a range join.
SPARK_VIEWS = {
    "user_daily": """
SELECT d.user_id, d.date, COALESCE(c.value, 0) AS value
FROM (SELECT user_id, explode(sequence(MIN(CAST(ts AS DATE)), MAX(CAST(ts AS DATE)))) AS date FROM events GROUP BY user_id) d
JOIN (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events) p ON p.date = d.date
LEFT JOIN (SELECT user_id, CAST(ts AS DATE) AS date, COUNT(*) AS value FROM events GROUP BY user_id, CAST(ts AS DATE)) c
 ON c.user_id = d.user_id AND c.date = d.date""",
}

_NEEDS = {"pulls": ("search_rows",)}


class Tables:
    """DataFrames of the base tables and views under one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(os.path.join(self.folder, f"{name}.parquet"))
        for base in BASE:
            if base in VIEWS[name] or any(base in VIEWS[need] for need in _NEEDS.get(name, ())):
                self(base).createOrReplaceTempView(base)
        for need in _NEEDS.get(name, ()):
            self.spark.sql(VIEWS[need]).createOrReplaceTempView(need)
        return self.spark.sql(SPARK_VIEWS.get(name, VIEWS[name]))


def with_views(sql: str, *names: str) -> str:
    """The SQL with the named views in front of it as common table expressions."""
    ordered = list(dict.fromkeys(need for name in names for need in (*_NEEDS.get(name, ()), name)))
    parts = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in ordered)
    if not parts:
        return sql
    body = sql.lstrip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {parts},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {parts},\n{body[5:]}"
    return f"WITH {parts}\n{body}"
