"""Queries that run single operators over whole tables: lookups, periods, rules, keys and ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import ledger, monitors, quality, selection
from ..settings import SEARCH_CHANGE_TYPES
from ..sources import changelog
from .registry import query, rnd

_DAY = "CAST(CAST(o_orderdate AS DATE) AS VARCHAR)"


def _day():
    return F.to_date("o_orderdate").cast("string")


@query(
    "latest_snapshot",
    sql="SELECT o_custkey AS source_id, arg_max(o_orderkey, (CAST(o_orderdate AS DATE), o_orderkey)) AS snapshot_id, max(CAST(o_orderdate AS DATE)) AS day FROM orders GROUP BY o_custkey",
)
def latest_snapshot(t):
    headers = t("orders").select(F.col("o_custkey").alias("source_id"), F.to_date("o_orderdate").alias("retrieved_at"), F.col("o_orderkey").alias("snapshot_id"))
    return selection.latest_snapshot(headers, ["source_id"]).withColumnRenamed("retrieved_at", "day")


@query("first_of_type", sql="SELECT p_brand AS type, arg_min(p_partkey, p_size * 1000000 + p_partkey) AS source_id FROM part GROUP BY p_brand")
def first_of_type(t):
    sources = t("part").select(F.col("p_brand").alias("type"), F.col("p_partkey").alias("source_id"), (F.col("p_size") * 1000000 + F.col("p_partkey")).alias("position"))
    return selection.first_of_type(sources)


@query(
    "baseline_drift",
    sql=f"""WITH v AS (SELECT o_custkey, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) AS r, CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS DOUBLE) AS m FROM orders GROUP BY o_custkey),
d AS (SELECT o_custkey, CASE WHEN r = 0 THEN CASE WHEN m = 0 THEN 0.0 ELSE 100.0 END ELSE abs((m - r) / r * 100) END AS d FROM v)
SELECT o_custkey AS baseline_id, {rnd('d', 4)} AS drift, CASE WHEN d > 10 THEN 'major' WHEN d > 1 THEN 'minor' END AS severity FROM d""",
)
def baseline_drift(t):
    from ..functions.numbers import round_half_up

    per = t("orders").groupBy(F.col("o_custkey").alias("baseline_id")).agg(
        F.count_if(F.col("o_orderstatus") == "F").cast("double").alias("r"), F.count_if(F.col("o_orderstatus") == "O").cast("double").alias("m")
    )
    drift = per.withColumn("d", quality.baseline_drift(F.col("m"), F.col("r")))
    return drift.select("baseline_id", round_half_up(F.col("d"), 4).alias("drift"), quality.baseline_severity(F.col("d")).alias("severity"))


@query(
    "period_text",
    sql="""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 < 2 THEN CAST(o_orderdate AS DATE) END AS first_day,
 CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderdate AS DATE) + 7 WHEN 1 THEN CAST(o_orderdate AS DATE) + 20 END AS last_day FROM orders""",
)
def period_text(t):
    """Two dates, three dates, one date, and two in the wrong order."""
    k, day = F.col("o_orderkey") % 4, lambda n: F.date_add(F.to_date("o_orderdate"), n).cast("string")
    written = (
        F.when(k == 0, F.concat(F.lit("from "), day(0), F.lit(" to "), day(7))).when(k == 1, F.concat_ws(", ", day(0), day(9), day(20)))
        .when(k == 2, F.concat(F.lit("since "), day(0))).otherwise(F.concat_ws("..", day(7), day(0)))
    )
    return t("orders").select(F.col("o_orderkey").alias("id"), dates.parse_period(written).alias("p")).select("id", F.col("p.start").alias("first_day"), F.col("p.end").alias("last_day"))


@query(
    "timestamps",
    sql="""SELECT o_orderkey AS id, CAST(CASE o_orderkey % 5 WHEN 0 THEN epoch(CAST(o_orderdate AS DATE)) WHEN 1 THEN epoch(CAST(o_orderdate AS DATE)) + 36000
 WHEN 2 THEN epoch(CAST(o_orderdate AS DATE)) + 28800 END AS BIGINT) AS seconds FROM orders""",
)
def timestamps(t):
    """A bare date, a time in UTC, a time two hours ahead, "unknown" and nonsense, as seconds."""
    k = F.col("o_orderkey") % 5
    written = (
        F.when(k == 0, _day()).when(k == 1, F.concat(_day(), F.lit("T10:00:00Z"))).when(k == 2, F.concat(_day(), F.lit("T10:00:00+02:00")))
        .when(k == 3, F.lit(" unknown ")).otherwise(F.concat(F.lit("x"), _day()))
    )
    return t("orders").select(F.col("o_orderkey").alias("id"), F.unix_seconds(dates.parse_timestamp(written)).alias("seconds"))


@query(
    "year_windows",
    sql="""SELECT DISTINCT CAST(o_orderdate AS DATE) AS after_start, CAST(o_orderdate AS DATE) + 27 AS after_end, CAST(o_orderdate AS DATE) - 364 AS before_start, CAST(o_orderdate AS DATE) - 337 AS before_end FROM orders""",
)
def year_windows(t):
    days = t("orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return days.select(*[c.alias(n) for n, c in dates.year_over_year(F.col("d"), F.date_add("d", 27)).items()])


@query(
    "availability",
    sql="""WITH a AS (SELECT p_partkey AS area, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 150 END AS source_id, p_partkey % 8 = 0 AS optional FROM part),
h AS (SELECT s_suppkey AS source_id, CASE WHEN s_suppkey % 3 = 0 THEN 'stale' ELSE 'ok' END AS health FROM supplier),
j AS (SELECT a.*, CASE WHEN a.source_id IS NULL THEN CASE WHEN optional THEN 'not_configured (optional)' ELSE 'not_configured' END ELSE coalesce(h.health, 'unconfigured') END AS state FROM a LEFT JOIN h USING (source_id))
SELECT area, state AS health, CASE WHEN source_id IS NULL THEN NOT optional ELSE state <> 'ok' END AS is_gap FROM j""",
)
def availability(t):
    k = F.col("p_partkey")
    areas = t("part").select(k.alias("area"), F.when(k % 4 != 0, k % 150).alias("source_id"), (k % 8 == 0).alias("optional"))
    health = t("supplier").select(F.col("s_suppkey").alias("source_id"), F.when(F.col("s_suppkey") % 3 == 0, "stale").otherwise("ok").alias("health"), F.lit(None).cast("date").alias("data_through"))
    return quality.availability(areas, health).select("area", "health", "is_gap")


@query(
    "quality_rules",
    sql="""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber * 5 > 0 AND l_quantity < l_linenumber * 5 THEN 'major' END AS sample,
 CASE WHEN l_linenumber % 2 = 1 THEN CASE WHEN l_quantity >= 7 THEN 'info' ELSE 'minor' END END AS zone,
 CASE WHEN l_linenumber - 1 > 0 THEN CASE WHEN (l_linenumber - 1) / CAST(greatest(1, l_quantity) AS DOUBLE) > 0.1 THEN 'major' ELSE 'minor' END END AS missing FROM lineitem""",
)
def quality_rules(t):
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    zone = F.when(n % 2 == 1, "Europe/Rome").otherwise("UTC")
    return t("lineitem").select(
        "l_orderkey", "l_linenumber", quality.sample_issue(q.cast("double"), (n * 5).cast("double")).alias("sample"),
        quality.timezone_issue(zone, F.lit("UTC"), q).alias("zone"), quality.missing_share_issue(n - 1, q).alias("missing"),
    )


@query(
    "distinct_issues",
    sql="""WITH i AS (SELECT o_custkey AS request_id, CASE WHEN o_orderkey % 2 = 0 THEN 'before' ELSE 'after' END AS label, CASE o_orderkey % 3 WHEN 0 THEN 'source_stale' WHEN 1 THEN 'timezone_mismatch' ELSE 'missing_dates' END AS code,
 CASE WHEN o_orderkey % 5 = 0 THEN 'major' ELSE 'minor' END AS severity, o_orderstatus AS detail FROM orders),
m AS (SELECT DISTINCT request_id, code, CASE WHEN code LIKE 'source%' THEN '' WHEN code = 'timezone_mismatch' THEN severity ELSE label || ':' || detail END AS mark FROM i)
SELECT request_id, code, count(*) AS issues FROM m GROUP BY request_id, code""",
)
def distinct_issues(t):
    k = F.col("o_orderkey")
    issues = t("orders").select(
        F.col("o_custkey").alias("request_id"), F.when(k % 2 == 0, "before").otherwise("after").alias("label"),
        F.when(k % 3 == 0, "source_stale").when(k % 3 == 1, "timezone_mismatch").otherwise("missing_dates").alias("code"),
        F.when(k % 5 == 0, "major").otherwise("minor").alias("severity"), F.col("o_orderstatus").alias("detail"),
    )
    return quality.distinct_issues(issues).groupBy("request_id", "code").agg(F.count(F.lit(1)).alias("issues"))


@query(
    "change_import",
    sql="""SELECT 'o' || o_orderkey AS origin_ref FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1997-01-01'
 AND NOT (o_orderkey % 3 = 0 AND o_orderkey % 2 = 1)""",
)
def change_import(t):
    """Registry rows hold every third order; of those the even ones are superseded and so no longer count."""
    ref = F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))
    new = t("orders").select(ref.alias("origin_ref"), F.col("o_orderdate").cast("timestamp").alias("live_at"))
    held = t("orders").where("o_orderkey % 3 = 0")
    first = held.select(ref.alias("change_id"), F.lit(None).cast("string").alias("supersedes"), ref.alias("origin_ref"))
    later = held.where("o_orderkey % 2 = 0").select(F.concat(ref, F.lit("+")).alias("change_id"), ref.alias("supersedes"), F.lit(None).cast("string").alias("origin_ref"))
    return ledger.import_changes(new, first.union(later), "1997-01-01").select("origin_ref")


@query(
    "change_log_import",
    sql="""SELECT o_orderpriority AS title, CAST(o_orderdate AS DATE) AS live_date, '/c/' || (o_custkey % 10) AS pages, count(*) FILTER (WHERE o_orderkey % 3 <> 0) AS n
FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1997-01-01' GROUP BY 1, 2, 3 HAVING n > 0""",
)
def change_log_import(t):
    """A log with equal rows, of which an earlier state is held: each row that was added is imported."""

    def log(orders):
        page = F.concat(F.lit("/c/"), (F.col("o_custkey") % 10).cast("string"))
        rows = orders.select(F.col("o_orderpriority").alias("title"), page.alias("pages"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("deployed_at"))
        return changelog.change_log(rows, "orders.csv")

    none = F.lit(None).cast("string")
    held = log(t("orders").where("o_orderkey % 3 = 0")).select(F.col("origin_ref").alias("change_id"), none.alias("supersedes"), "origin_ref")
    fresh = ledger.import_changes(log(t("orders")), held, "1997-01-01")
    return fresh.groupBy("title", F.to_date("live_at").alias("live_date"), F.array_join("pages", ",").alias("pages")).agg(F.count(F.lit(1)).alias("n"))


_TYPES = ", ".join(f"'{x}'" for x in SEARCH_CHANGE_TYPES)


@query(
    "recent_changes",
    sql=f"""WITH c AS (SELECT o_orderkey AS change_id, CASE WHEN o_orderkey % 4 = 0 THEN 'pricing' ELSE list_extract([{_TYPES}], CAST(o_orderkey % {len(SEARCH_CHANGE_TYPES)} AS INT) + 1) END AS type, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT change_id, type FROM c WHERE type IN ({_TYPES}) AND d >= DATE '1999-01-01'""",
)
def recent_changes(t):
    k = F.col("o_orderkey")
    kind = F.when(k % 4 == 0, "pricing").otherwise(F.element_at(F.array(*map(F.lit, SEARCH_CHANGE_TYPES)), (k % len(SEARCH_CHANGE_TYPES) + 1).cast("int")))
    changes = t("orders").select(k.alias("change_id"), kind.alias("type"), F.col("o_orderdate").cast("timestamp").alias("live_at"))
    return ledger.recent_changes(changes, F.lit("1999-01-01").cast("date")).select("change_id", "type")


@query(
    "valid_transitions",
    sql="SELECT o_orderkey AS record_id, o_orderpriority AS kind, o_orderstatus AS status FROM orders WHERE (o_orderpriority = '1-URGENT' AND o_orderstatus IN ('O', 'F')) OR (o_orderpriority = '2-HIGH' AND o_orderstatus = 'P')",
)
def valid_transitions(t):
    events = t("orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("status"))
    return ledger.valid_transitions(events, {"1-URGENT": ("O", "F"), "2-HIGH": ("P",)})


@query(
    "record_keys",
    sql=f"SELECT o_orderkey, sha256(CAST(o_orderkey AS VARCHAR) || chr(1) || coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END, '') || chr(1) || {_DAY}) AS record_id FROM orders",
)
def record_keys(t):
    return t("orders").select("o_orderkey", ledger.record_key(F.col("o_orderkey"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")), F.to_date("o_orderdate")).alias("record_id"))


@query(
    "fingerprints",
    sql="SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN sha256('## Hypothesis' || chr(10) || p_name || chr(10) || chr(10) || p_type) END AS fingerprint FROM part",
)
def fingerprints(t):
    """Definitions with trailing blanks and either line end; every fifth has no criteria lock."""
    end = F.when(F.col("p_partkey") % 2 == 0, "\r\n").otherwise("\n")
    lock = F.when(F.col("p_partkey") % 5 != 0, "## Criteria lock").otherwise("## Results")
    body = F.concat(F.lit("# T"), end, F.lit("## Hypothesis"), end, F.col("p_name"), F.lit("  \t"), end, end, F.col("p_type"), F.lit(" "), end, end, lock, end, F.lit("later"))
    return t("part").select("p_partkey", text.definition_fingerprint(body).alias("fingerprint"))


@query(
    "open_windows",
    sql=f"SELECT o_orderkey AS request_id, 'after' AS label, 'window_open' AS code, 'major' AS severity, {_DAY} AS detail FROM orders WHERE CAST(o_orderdate AS DATE) + 1 > DATE '1998-06-01'",
)
def open_windows(t):
    experiments = t("orders").select(F.col("o_orderkey").alias("experiment_id"), F.to_date("o_orderdate").alias("window_end"))
    return monitors.open_window_issues(experiments, F.lit("1998-06-01 00:00:00").cast("timestamp"))


@query(
    "experiment_readiness",
    sql="""WITH e AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT k AS experiment_id, CASE WHEN k % 9 = 0 THEN 'confirm_definition' WHEN k % 9 = 1 THEN 'ask_about_changed_definition' WHEN k % 5 = 0 THEN 'create_plan' WHEN k % 7 = 0 THEN 'record_baseline'
 WHEN k % 6 = 0 THEN 'await_decision' WHEN d >= DATE '1998-06-01' THEN 'wait_for_window' WHEN k % 3 <> 2 AND d > (CASE k % 3 WHEN 0 THEN DATE '1996-01-01' ELSE DATE '1997-01-01' END) THEN 'refresh_source' ELSE 'evaluate' END AS next_step FROM e""",
)
def experiment_readiness(t):
    k = F.col("o_orderkey")
    orders = t("orders")
    experiments = orders.select(
        k.alias("experiment_id"), F.when(k % 9 == 1, "changed").when(k % 9 != 0, "locked").alias("definition_status"), F.to_date("o_orderdate").alias("window_end"), (k % 3).alias("source_id")
    )
    plans = orders.where(k % 5 != 0).select(k.alias("experiment_id"), F.when(k % 6 == 0, "evaluated").otherwise("planned").alias("plan_status"), F.when(k % 7 != 0, k).alias("baseline_id"))
    seen = orders.select((k % 3).alias("source_id")).distinct()
    sources = seen.select("source_id", F.when(F.col("source_id") == 0, F.lit("1996-01-01").cast("date")).when(F.col("source_id") == 1, F.lit("1997-01-01").cast("date")).alias("data_through"))
    return monitors.experiment_readiness(experiments, plans, sources, F.lit("1998-06-01 00:00:00").cast("timestamp"))
