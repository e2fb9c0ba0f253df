"""Queries on sources, change logs, ledgers and experiments."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import as_of, change_windows, compaction, confidence, ledger, monitors, provenance, quality, selection
from ..operators import integrity as checks
from ..session import ensure_checkpoint_dir
from ..sources import changelog
from .registry import query, rnd
from .tables import VIEWS

_NOW = "2024-02-01 08:00:00"
#: Rows of one writer of the store that is compacted.
_WRITER_ROWS = 2_000_000


def _now():
    return F.lit(_NOW).cast("timestamp")


@query(
    "source_health",
    sql=f"""WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 11 = 0 THEN 'disabled' WHEN s_suppkey % 13 = 0 THEN 'unavailable' ELSE 'configured' END AS st, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE TIMESTAMP '2024-01-30 06:00:00' END AS ok,
 CASE WHEN s_suppkey % 5 = 0 THEN TIMESTAMP '2024-01-30 07:00:00' END AS er, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE DATE '2024-01-31' - CAST(s_suppkey % 9 AS INT) END AS th FROM supplier),
a AS (SELECT *, date_diff('second', coalesce(CAST(th + 1 AS TIMESTAMP), ok), TIMESTAMP '{_NOW}') / CAST(3600 AS DOUBLE) AS age FROM s),
h AS (SELECT *, CASE WHEN st = 'disabled' THEN 'disabled' WHEN st = 'unavailable' OR (er IS NOT NULL AND (ok IS NULL OR er > ok)) THEN 'unavailable' WHEN ok IS NULL THEN 'unknown' WHEN age > 48 THEN 'stale' ELSE 'ok' END AS health FROM a)
SELECT s_suppkey AS source_id, health, CASE WHEN health IN ('ok', 'stale') THEN floor(age + 0.5) END AS age_hours,
 CAST(CASE WHEN health = 'stale' THEN CASE WHEN th IS NULL THEN floor(age / 24) ELSE date_diff('day', th, DATE '2024-02-01') END END AS BIGINT) AS age_days,
 CASE WHEN health IN ('disabled', 'unavailable') THEN 'blocking' WHEN health = 'stale' THEN 'major' WHEN health = 'unknown' THEN 'minor' END AS severity FROM h""",
)
def source_health(t):
    k = F.col("s_suppkey")
    stamp = lambda s: F.lit(s).cast("timestamp")
    sources = t("supplier").select(
        k.alias("source_id"), F.when(k % 11 == 0, "disabled").when(k % 13 == 0, "unavailable").otherwise("configured").alias("status"),
        F.when(k % 7 != 0, stamp("2024-01-30 06:00:00")).alias("last_success_at"), F.when(k % 5 == 0, stamp("2024-01-30 07:00:00")).alias("last_error_at"),
        F.when(k % 3 != 0, F.date_sub(F.lit("2024-01-31").cast("date"), (k % 9).cast("int"))).alias("data_through"), F.lit(None).cast("double").alias("stale_after_hours"),
    )
    found = quality.source_health(sources, _now())
    return found.select("source_id", "health", "age_hours", "age_days", quality.health_severity(F.col("health")).alias("severity"))


@query(
    "quality_levels",
    sql="""SELECT o_custkey AS request_id, CASE max(CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 1 ELSE 0 END) WHEN 3 THEN 'insufficient' WHEN 2 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS data_quality
FROM orders GROUP BY o_custkey""",
)
def quality_levels(t):
    p = F.col("o_orderpriority")
    severity = F.when(p == "1-URGENT", "blocking").when(p == "2-HIGH", "major").when(p == "3-MEDIUM", "minor").otherwise("info")
    return quality.quality_levels(t("orders").select(F.col("o_custkey").alias("request_id"), severity.alias("severity")), ["request_id"])


_TITLES = ("Update meta title", "GA4 tracking", "Pricing page", "Launch new page", "Deploy release", "Nothing")


@query(
    "change_log",
    sql="""SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'seo_content_update' WHEN 1 THEN 'tracking_change' WHEN 2 THEN 'pricing_change' WHEN 3 THEN 'content_publish' WHEN 4 THEN 'deployment' ELSE 'other' END AS type,
 CASE WHEN o_orderstatus = 'F' THEN 'deployed' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'unknown' END AS deploy_status,
 CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) END AS live_date, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE '/c/' || o_custkey || ',/x' END AS pages FROM orders""",
)
def change_log(t):
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    title = F.element_at(F.array(*[F.lit(x) for x in _TITLES]), (k % 6 + 1).cast("int"))
    pages = F.when(k % 4 == 0, "56 items `/c/*`").otherwise(F.concat(F.lit("see `https://www.example.com/c/"), F.col("o_custkey").cast("string"), F.lit("/` and /x")))
    rows = t("orders").select(
        title.alias("title"), pages.alias("pages"), k.cast("string").alias("task"), F.when(status == "F", day).otherwise("").alias("deployed_at"),
        F.when(status != "P", day).otherwise("").alias("applied_at"),
    )
    keyed = rows.withColumn("notes", F.col("task"))
    found = changelog.change_log(keyed, "orders.csv", carry=["task"])
    return found.select(
        F.col("task").cast("bigint").alias("id"), "type", "deploy_status", F.to_date("live_at").alias("live_date"), F.array_join("pages", ",").alias("pages")
    )


@query(
    "publications",
    sql="""WITH l AS (SELECT o_custkey AS task_id, o_orderkey AS asset_id, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderstatus = 'F'),
e AS (SELECT o_custkey AS task_id, o_orderkey AS asset_id, CAST(o_orderdate AS DATE) + 2 AS d FROM orders WHERE o_orderkey % 2 = 0)
SELECT l.task_id, l.asset_id, CASE WHEN l.asset_id % 3 = 0 THEN l.d + 1 ELSE l.d END AS published_on, CASE WHEN l.asset_id % 3 = 0 THEN 'deploy_log' ELSE 'publish_ledger' END AS timestamp_basis, e.task_id IS NOT NULL AS has_url FROM l LEFT JOIN e USING (task_id, asset_id)
UNION ALL SELECT e.task_id, e.asset_id, e.d, 'execution_result', true FROM e LEFT JOIN l USING (task_id, asset_id) WHERE l.task_id IS NULL""",
)
def publications(t):
    orders = t("orders").withColumns({"task_id": F.col("o_custkey"), "asset_id": F.col("o_orderkey"), "at": F.col("o_orderdate").cast("timestamp")})
    none = F.lit(None).cast("timestamp")
    log = orders.where("o_orderstatus = 'F'").select(
        "task_id", "asset_id", F.lit("published").alias("status"), F.lit("web").alias("channel"), none.alias("deployed_at"),
        F.when(F.col("asset_id") % 3 == 0, F.col("at") + F.expr("INTERVAL 1 DAY")).alias("live_at"), none.alias("actual_publish_time"), F.col("at").alias("written_at"),
    )
    events = orders.where("o_orderkey % 2 = 0").select(
        "task_id", "asset_id", F.lit("published").alias("status"), F.lit("web").alias("channel"), (F.col("at") + F.expr("INTERVAL 2 DAY")).alias("event_at"), F.lit("/x").alias("publication_url")
    )
    assets = orders.select("task_id", "asset_id", F.lit("t").alias("title"), F.lit("blog").alias("channel"), F.lit("article").alias("asset_type"))
    found = changelog.publications(log, assets, events)
    return found.select("task_id", "asset_id", F.to_date("published_at").alias("published_on"), "timestamp_basis", F.col("publication_url").isNotNull().alias("has_url"))


@query("exports_state", sql="SELECT o_orderkey AS export_id, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS consumed FROM orders")
def exports_state(t):
    exports = t("orders").select(F.col("o_orderkey").alias("export_id"))
    held = t("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("export_id"))
    return ledger.exports_state(exports, held, ["export_id"])


VIEWS["versions"] = "SELECT o_orderkey AS record_id, CASE WHEN o_orderkey % 12 <> 0 OR o_orderkey BETWEEN 100 AND 400 THEN o_orderkey - 1 END AS supersedes FROM orders"


@query("active_records", views=("versions",), sql="SELECT record_id FROM versions v WHERE NOT EXISTS (SELECT 1 FROM versions w WHERE w.supersedes = v.record_id)")
def active_records(t):
    return selection.active_records(t("versions"), "record_id").select("record_id")


@query(
    "supersede_chains",
    views=("versions",),
    sql="""WITH RECURSIVE w AS (SELECT record_id, record_id AS cur, 0 AS n FROM versions UNION ALL SELECT w.record_id, v.record_id, n + 1 FROM w JOIN versions v ON v.supersedes = w.cur)
SELECT record_id, arg_max(cur, n) AS current_id FROM w GROUP BY record_id""",
)
def supersede_chains(t):
    return selection.resolve_chains(t("versions"), "record_id")


@query(
    "append_open",
    sql="""SELECT 'k' || c_custkey AS dedupe_key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')""",
)
def append_open(t):
    key = lambda c: F.concat(F.lit("k"), F.col(c).cast("string")).alias("dedupe_key")
    status = F.when(F.col("o_orderstatus") == "O", "open").otherwise("resolved").alias("status")
    return ledger.append_open(t("customer").select(key("c_custkey")), t("orders").select(key("o_custkey"), status))


@query("current_status", sql="SELECT user_id AS record_id, arg_max(event_type, (ts, event_type)) AS status, max(ts) AS since, count(*) AS events FROM events GROUP BY user_id")
def current_status(t):
    return ledger.current_status(t("events").select(F.col("user_id").alias("record_id"), F.col("ts").alias("at"), F.col("event_type").alias("status")))


@query(
    "registry_versions",
    sql="""WITH e AS (SELECT user_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events)
SELECT user_id AS metric_id, arg_max(event_type, ts) AS aggregation, CAST(sum(CASE WHEN event_type IS DISTINCT FROM p THEN 1 ELSE 0 END) AS BIGINT) AS version FROM e GROUP BY user_id""",
)
def registry_versions(t):
    events = t("events").select(F.col("user_id").alias("metric_id"), F.col("ts").alias("at"), F.col("event_type").alias("aggregation"))
    return ledger.registry_versions(events, "metric_id", ["aggregation"], ["aggregation"]).drop("at")


@query(
    "prune_plan",
    sql="""WITH s AS (SELECT l_suppkey AS source_id, date_trunc('month', l_shipdate) AS m, CAST(max(l_shipdate) AS DATE) AS d, count(*) AS n FROM lineitem GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY d DESC) AS r FROM s)
SELECT source_id, d AS period_end, n AS row_count FROM k WHERE d < DATE '2001-05-05' AND r > 1 AND (source_id + n) % 5 <> 0""",
)
def prune_plan(t):
    month = F.date_format("l_shipdate", "yyyy-MM")
    pulls = t("lineitem").groupBy(F.col("l_suppkey").alias("source_id"), month.alias("month")).agg(
        F.to_date(F.min("l_shipdate")).alias("period_start"), F.to_date(F.max("l_shipdate")).alias("period_end"), F.count(F.lit(1)).alias("row_count")
    )
    headers = pulls.withColumns(
        {
            "snapshot_id": F.concat_ws("-", F.col("source_id").cast("string"), "month"), "kind": F.lit("gsc_rows"), "rows_hash": F.lit(""),
            "retrieved_at": F.col("period_end").cast("timestamp"),
        }
    )
    used = headers.where((F.col("source_id") + F.col("row_count")) % 5 == 0)
    now = F.lit("2001-11-01 00:00:00").cast("timestamp")
    return ledger.prune_plan(headers, used, now).select("source_id", "period_end", "row_count")


_Q = "CASE o_orderkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'insufficient' END"
_S = "CASE o_orderkey % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'insufficient' END"
_C = "CASE o_orderkey % 7 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'none' END"
VIEWS["judged"] = f"SELECT CAST(o_orderkey AS VARCHAR(20)) AS evidence_id, CAST(o_custkey AS VARCHAR(20)) AS metric_id, {_Q} AS q, {_S} AS s, {_C} AS c, o_orderkey % 3 AS d, o_orderkey % 6 AS l FROM orders"


@query(
    "ledger_violations",
    views=("judged",),
    sql="""WITH r AS (SELECT *, CASE q WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END AS qr, CASE s WHEN 'insufficient' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS sr,
 CASE c WHEN 'none' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS cr FROM judged)
SELECT evidence_id, 'strength_over_quality' AS violation FROM r WHERE s <> 'insufficient' AND qr > 3 - sr UNION ALL SELECT evidence_id, 'causality_over_strength' FROM r WHERE cr > sr
UNION ALL SELECT evidence_id, 'strength_from_insufficient' FROM r WHERE q = 'insufficient' AND s <> 'insufficient' UNION ALL SELECT evidence_id, 'delta_from_insufficient' FROM r WHERE q = 'insufficient' AND d > 0
UNION ALL SELECT evidence_id, 'causality_without_link' FROM r WHERE c <> 'none' AND l = 0 UNION ALL SELECT evidence_id, 'unknown_metric' FROM r WHERE metric_id NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 50 <> 0)
UNION ALL SELECT evidence_id, 'unknown_change' FROM r WHERE l > 0 AND CAST(evidence_id AS BIGINT) % 9 = 0""",
)
def ledger_violations(t):
    rows = t("judged").select(
        "evidence_id", "metric_id", F.col("q").alias("data_quality"), F.col("s").alias("evidence_strength"), F.col("c").alias("causal_confidence"),
        F.when(F.col("d") > 0, F.col("d").cast("double")).alias("delta_abs"), F.when(F.col("l") > 0, F.array("evidence_id")).alias("change_ids"),
        F.lit(None).cast("string").alias("experiment_id"), F.lit(None).cast("string").alias("supersedes"),
    )
    changes = t("judged").where(F.col("evidence_id").cast("bigint") % 9 != 0).select(F.col("evidence_id").alias("change_id"))
    known = t("customer").where("c_custkey % 50 <> 0").select(F.col("c_custkey").cast("string").alias("metric_id"))
    return ledger.ledger_violations(rows, changes, known).select("evidence_id", "violation")


@query(
    "experiment_results",
    sql=f"""WITH e AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'f' || (c_custkey % 3) END AS locked, 'f' || (c_custkey % 4) AS fp FROM customer),
m AS (SELECT o_custkey AS k, {rnd('avg(CAST(o_orderkey % 100 AS DOUBLE))', 4)} AS v, count(*) AS n FROM orders GROUP BY 1),
b AS (SELECT e.k, v, n, CASE WHEN locked IS NULL THEN 'criteria_not_locked' WHEN fp = locked THEN 'review_lock' WHEN locked = 'f0' AND fp = 'f1' THEN 'override CO-1' ELSE 'criteria_changed' END AS criteria_basis FROM e LEFT JOIN m USING (k))
SELECT k AS experiment_id, criteria_basis, CASE WHEN criteria_basis IN ('review_lock', 'override CO-1') THEN CASE WHEN v IS NULL OR n < 2 THEN 'insufficient_data' WHEN v >= 50.5 THEN 'success_threshold_met' WHEN v <= 45 THEN 'failure_threshold_met' ELSE 'between_thresholds' END ELSE criteria_basis END AS threshold_result FROM b""",
)
def experiment_results(t):
    from ..functions.numbers import round_half_up

    k = F.col("c_custkey")
    tag = lambda n: F.concat(F.lit("f"), (k % n).cast("string"))
    experiments = t("customer").select(
        k.alias("experiment_id"), F.when(k % 5 != 0, tag(3)).alias("locked_fingerprint"), tag(4).alias("fingerprint"), F.lit(">= 50.5 percent").alias("success_threshold"),
        F.lit("<= 45").alias("failure_threshold"), F.lit("2024-01-30").cast("date").alias("window_end"),
    )
    overrides = t("region").select(
        F.concat(F.lit("CO-"), (F.col("r_regionkey") + 1).cast("string")).alias("override_id"), F.when(F.col("r_regionkey") == 0, "approved").otherwise("draft").alias("status"),
        F.lit("f0").alias("prior_fingerprint"), F.lit("f1").alias("replacement_fingerprint"),
    )
    measured = t("orders").groupBy(F.col("o_custkey").alias("experiment_id")).agg(
        round_half_up(F.avg((F.col("o_orderkey") % 100).cast("double"))).alias("after_value"), F.when(F.count(F.lit(1)) < 2, "insufficient").otherwise("high").alias("data_quality")
    )
    found = monitors.evaluate_experiments(monitors.criteria_basis(experiments, overrides), measured, _now())
    return found.select("experiment_id", "criteria_basis", "threshold_result")


@query(
    "dictionary_violations",
    sql="""SELECT p_partkey AS metric_id, 'unknown_aggregation' AS violation FROM part WHERE p_partkey % 6 = 5 UNION ALL SELECT p_partkey, 'ratio_without_parts' FROM part WHERE p_partkey % 6 = 1 AND p_size % 2 = 0
UNION ALL SELECT p_partkey, 'mean_without_weight' FROM part WHERE p_partkey % 6 = 2 AND p_size % 3 = 0 UNION ALL SELECT p_partkey, 'active_without_source' FROM part WHERE p_partkey % 10 = 0
UNION ALL SELECT p_partkey, 'source_not_registered' FROM part WHERE p_partkey % 10 <> 0 AND p_brand NOT IN (SELECT 'Brand#' || n_nationkey FROM nation)""",
)
def dictionary_violations(t):
    k, size = F.col("p_partkey"), F.col("p_size")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("sum", "ratio_of_sums", "weighted_mean", "mean", "last", "median")]), (k % 6 + 1).cast("int"))
    dictionary = t("part").select(
        k.alias("metric_id"), F.lit("active").alias("status"), kind.alias("aggregation"), F.lit("a").alias("numerator"), F.when(size % 2 != 0, "b").alias("denominator"),
        F.when(size % 3 != 0, "w").alias("weight"), F.when(k % 10 != 0, F.col("p_brand")).alias("canonical_source"),
    )
    sources = t("nation").select(F.concat(F.lit("Brand#"), F.col("n_nationkey").cast("string")).alias("source_id"))
    return ledger.dictionary_violations(dictionary, sources)


@query(
    "rows_digest",
    sql="""WITH h AS (SELECT o_orderpriority, sha256(concat_ws('|', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus, o_orderpriority)) AS h FROM orders),
q AS (SELECT o_orderpriority, count(*) AS rows, sum(CAST('0x' || substr(h, 1, 16) AS UBIGINT)) AS a, sum(CAST('0x' || substr(h, 17, 16) AS UBIGINT)) AS b,
 sum(CAST('0x' || substr(h, 33, 16) AS UBIGINT)) AS c, sum(CAST('0x' || substr(h, 49, 16) AS UBIGINT)) AS d FROM h GROUP BY o_orderpriority)
SELECT o_orderpriority, rows, sha256(concat_ws(':', CAST(rows AS VARCHAR), CAST(a AS VARCHAR), CAST(b AS VARCHAR), CAST(c AS VARCHAR), CAST(d AS VARCHAR))) AS digest FROM q""",
)
def rows_digest(t):
    """Order-free digest of the order rows per priority."""
    fields = [F.col(n).cast("string") for n in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")]
    return ledger.rows_digest(t("orders"), ["o_orderpriority"], F.sha2(F.concat_ws("|", *fields), 256))


VIEWS["chained_changes"] = """
SELECT o_orderkey AS change_id, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey - 1 END AS supersedes,
 CASE o_orderstatus WHEN 'F' THEN 'deployed' WHEN 'O' THEN 'pending' ELSE 'unknown' END AS deploy_status, CAST(o_orderdate AS DATE) AS live_date FROM orders"""


@query(
    "linked_successors",
    views=("chained_changes",),
    sql="""WITH RECURSIVE w AS (SELECT change_id AS request_id, change_id AS cur, 0 AS n FROM chained_changes UNION ALL SELECT w.request_id, c.change_id, n + 1 FROM w JOIN chained_changes c ON c.supersedes = w.cur),
e AS (SELECT request_id, arg_max(cur, n) AS change_id FROM w GROUP BY request_id)
SELECT e.request_id, e.change_id, 'linked' AS relation FROM e JOIN chained_changes c USING (change_id) WHERE c.deploy_status <> 'pending'""",
)
def linked_successors(t):
    """Requests that name a superseded change are linked with its newest successor."""
    none = F.lit(None)
    changes = t("chained_changes").select(
        "change_id", "supersedes", "deploy_status", "live_date", F.lit("content_update").alias("type"), none.cast("array<string>").alias("pages"),
        none.cast("string").alias("experiment_id"), F.lit(True).alias("confirmed"),
    )
    requests = changes.select(
        F.col("change_id").alias("request_id"), F.array("change_id").alias("change_ids"), none.cast("string").alias("experiment_id"), none.cast("array<string>").alias("scope_pages"),
        F.lit("1995-01-01").cast("date").alias("before_start"), F.lit("2001-12-31").cast("date").alias("after_end"),
    )
    return confidence.classify_changes(changes, requests).select("request_id", "change_id", "relation")


@query(
    "unknown_changes",
    sql="SELECT o_orderkey AS request_id, 'unknown_change' AS code, 'blocking' AS severity, CAST(o_orderkey AS VARCHAR) AS detail FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
)
def unknown_changes(t):
    registry = t("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("change_id"))
    requests = t("orders").select(F.col("o_orderkey").alias("request_id"), F.array("o_orderkey").alias("change_ids"))
    return confidence.unknown_changes(registry, requests)


@query(
    "compacted_parts",
    sql="""SELECT l_returnflag AS source_id, strftime(l_shipdate, '%Y') AS month, count(*) AS n_rows, CAST(sum(l_quantity) AS DOUBLE) AS quantity, count(DISTINCT l_suppkey) AS pulls
FROM lineitem WHERE l_suppkey % 10 <> 3 GROUP BY 1, 2""",
)
def compacted_parts(t):
    """A store of many small files, compacted under its headers without the pruned pulls, and read back."""
    rows = t("lineitem").select(
        F.col("l_suppkey").cast("string").alias("snapshot_id"), F.col("l_returnflag").alias("source_id"), F.date_format("l_shipdate", "yyyy").alias("month"),
        F.to_date("l_shipdate").alias("date"), F.col("l_quantity").alias("value"), "l_orderkey", "l_linenumber",
    )
    ensure_checkpoint_dir(t.spark)
    root = f"{t.spark.sparkContext.getCheckpointDir()}/store-{uuid.uuid4()}"
    compaction.create(rows.repartition(max(3, -(-rows.count() // _WRITER_ROWS))), root)
    parts = ["source_id", "month"]
    headers = compaction.pull_digests(rows, parts).select("snapshot_id", F.col("rows").alias("row_count"), F.col("digest").alias("rows_hash"))
    pruned = rows.where(F.col("snapshot_id").cast("bigint") % 10 == 3).select("snapshot_id").distinct()
    compaction.compact(t.spark, root, headers, pruned)
    return compaction.read(t.spark, root).groupBy("source_id", "month").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("value").cast("double").alias("quantity"), F.countDistinct("snapshot_id").alias("pulls")
    )


@query(
    "integrity",
    sql="""WITH o AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 97 <> 0 UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 89 = 0 UNION ALL SELECT o_orderkey, o_totalprice + 1 FROM orders WHERE o_orderkey % 83 = 0),
k AS (SELECT 'orders' AS tab, CAST(o_orderkey AS VARCHAR) AS id, count(*) AS records, min(o_totalprice) AS a, max(o_totalprice) AS b FROM o GROUP BY 2
 UNION ALL SELECT 'suppliers', CAST(s_suppkey AS VARCHAR), count(*), NULL, NULL FROM supplier WHERE s_suppkey % 7 <> 0 GROUP BY 2),
r AS (SELECT 'orders' AS tab, CAST(l_orderkey AS VARCHAR) AS id, count(*) AS refs, min('lines:' || l_linenumber) AS referred_by FROM lineitem GROUP BY 2
 UNION ALL SELECT 'suppliers', CAST(l_suppkey AS VARCHAR), count(*), min('lines:' || l_linenumber) FROM lineitem GROUP BY 2),
n AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 79 = 0 THEN -1 ELSE o_totalprice END AS d FROM orders),
j AS (SELECT coalesce(k.tab, r.tab) AS tab, coalesce(k.id, r.id) AS id, coalesce(records, 0) AS records, coalesce(refs, 0) AS refs, referred_by, a, b FROM k FULL JOIN r ON k.tab = r.tab AND k.id = r.id),
f AS (SELECT coalesce(j.tab, 'orders') AS tab, coalesce(j.id, n.id) AS id, coalesce(records, 0) AS records, coalesce(refs, 0) AS refs, referred_by, a, b, n.d FROM j FULL JOIN n ON j.tab = 'orders' AND j.id = n.id)
SELECT tab AS "table", id, 'dangling' AS violation, records, refs AS "references", referred_by FROM f WHERE records = 0 AND refs > 0
UNION ALL SELECT tab, id, 'double', records, refs, referred_by FROM f WHERE records > 1
UNION ALL SELECT tab, id, 'changed', records, refs, referred_by FROM f WHERE records > 0 AND (a <> b OR a <> d OR b <> d)
UNION ALL SELECT tab, id, 'lost', records, refs, referred_by FROM f WHERE records = 0 AND d IS NOT NULL""",
)
def integrity(t):
    """Orders of which some are missing, doubled or changed, and the lines that refer to them, in one grouping."""
    orders, key, price = t("orders"), F.col("o_orderkey"), F.col("o_totalprice")
    held = orders.where(key % 97 != 0).select("o_orderkey", "o_totalprice").unionByName(orders.where(key % 89 == 0).select("o_orderkey", "o_totalprice"))
    held = held.unionByName(orders.where(key % 83 == 0).select("o_orderkey", (price + 1).alias("o_totalprice")))
    text = lambda c: F.format_number(c.cast("double"), 2)
    noted = F.when(key % 79 == 0, F.lit("-1")).otherwise(text(price))
    lines, suppliers = t("lineitem"), t("supplier").where("s_suppkey % 7 <> 0")
    return checks.integrity(
        [checks.Keys("orders", held, "o_orderkey", text(price)), checks.Keys("suppliers", suppliers, "s_suppkey")],
        [checks.References("lines", lines, "l_linenumber", "orders", "l_orderkey"), checks.References("lines", lines, "l_linenumber", "suppliers", "l_suppkey")],
        [checks.Recorded("orders", orders, "o_orderkey", noted)],
    )


@query(
    "tracking_changes",
    views=("changes",),
    sql="""WITH w AS (SELECT p_partkey AS request_id, DATE '1995-01-01' + CAST(p_partkey * 13 % 2400 AS INTEGER) AS start, DATE '1995-01-01' + CAST(p_partkey * 13 % 2400 AS INTEGER) + CAST(p_partkey % 60 AS INTEGER) AS "end" FROM part),
k AS (SELECT * FROM changes WHERE type = 'tracking_change' AND deploy_status <> 'pending')
SELECT request_id, start, "end", (SELECT count(*) FROM k WHERE live_date BETWEEN w.start AND w."end") AS n_changes FROM w""",
)
def tracking_changes(t):
    """Tracking changes in the window of each request, by prefix counts."""
    start = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("p_partkey") * 13 % 2400).cast("int"))
    windows = t("part").select(F.col("p_partkey").alias("request_id"), start.alias("start"), F.date_add(start, (F.col("p_partkey") % 60).cast("int")).alias("end"))
    live = quality.deployed_tracking(t("changes").withColumnRenamed("live_date", "live_at"))
    return change_windows.count_in_windows(live, windows)


@query(
    "metric_as_of",
    sql="""WITH v AS (SELECT s_suppkey % 50 AS metric_id, DATE '1995-01-01' + CAST(s_suppkey * 37 % 2400 AS INTEGER) AS valid_from, max(s_suppkey) AS version FROM supplier GROUP BY 1, 2),
r AS (SELECT o_orderkey AS request_id, o_custkey % 50 AS metric_id, CAST(o_orderdate AS DATE) AS at FROM orders)
SELECT r.request_id, r.metric_id, v.version, v.valid_from FROM r ASOF LEFT JOIN v ON r.metric_id = v.metric_id AND r.at >= v.valid_from""",
)
def metric_as_of(t):
    """The definition that was valid when each order asked for its metric."""
    day = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("s_suppkey") * 37 % 2400).cast("int"))
    versions = t("supplier").select((F.col("s_suppkey") % 50).alias("metric_id"), day.alias("valid_from"), F.col("s_suppkey").alias("version"))
    asked = t("orders").select(F.col("o_orderkey").alias("request_id"), (F.col("o_custkey") % 50).alias("metric_id"), F.to_date("o_orderdate").alias("at"))
    return as_of.as_of(asked, versions, "metric_id", "at", "valid_from", ["version"]).select("request_id", "metric_id", "version", "valid_from")


@query(
    "settings_as_of",
    sql="""WITH c AS (SELECT CASE c_custkey % 3 WHEN 0 THEN 'min_clicks' WHEN 1 THEN 'fdr' ELSE 'unused' END AS name, DATE '1995-01-01' + CAST(c_custkey * 7 % 2400 AS INTEGER) AS since, c_custkey FROM customer WHERE c_custkey % 10 = 1),
v AS (SELECT name, since, arg_max(CASE WHEN c_custkey % 4 = 1 THEN NULL ELSE c_custkey END, (CASE WHEN c_custkey % 4 = 1 THEN -1 ELSE c_custkey END)) AS value, max(CASE WHEN c_custkey % 4 = 1 THEN NULL ELSE c_custkey END) AS best FROM c GROUP BY 1, 2),
r AS (SELECT o_orderkey AS request_id, CAST(o_orderdate AS DATE) AS at FROM orders)
SELECT r.request_id, coalesce(CAST(a.best AS DOUBLE), 5.0) AS min_clicks, coalesce(CAST(b.best AS DOUBLE), 0.1) AS fdr FROM r
ASOF LEFT JOIN (SELECT * FROM v WHERE name = 'min_clicks') a ON r.at >= a.since ASOF LEFT JOIN (SELECT * FROM v WHERE name = 'fdr') b ON r.at >= b.since""",
)
def settings_as_of(t):
    """Stored thresholds as they were at each order's time."""
    key = F.col("c_custkey")
    name = F.when(key % 3 == 0, "min_clicks").when(key % 3 == 1, "fdr").otherwise("unused")
    since = F.date_add(F.lit("1995-01-01").cast("date"), (key * 7 % 2400).cast("int"))
    config = t("customer").where(key % 10 == 1).select(name.alias("name"), F.when(key % 4 != 1, key.cast("double")).alias("value"), since.alias("since"))
    asked = t("orders").select(F.col("o_orderkey").alias("request_id"), F.to_date("o_orderdate").alias("at"))
    return as_of.settings_as_of(asked, config, {"min_clicks": 5.0, "fdr": 0.1}).drop("at")


@query(
    "evidence_lineage",
    sql="""WITH l AS (SELECT l_partkey AS request_id, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS n_artifacts, CAST(sum(DISTINCT l_suppkey) AS BIGINT) AS members FROM lineitem GROUP BY 1)
SELECT p_partkey AS request_id, coalesce(n_artifacts, 0) AS n_artifacts, members FROM part LEFT JOIN l ON p_partkey = request_id""",
)
def evidence_lineage(t):
    """Evidence of each part with the sum of the pulls that its lineage lists."""
    evidence = t("part").select(F.col("p_partkey").alias("request_id"), F.lit("m").alias("metric_id"), F.lit("s").alias("source_id"), F.lit("2001-11-04").cast("date").alias("after_end"))
    linked = t("orders").select(F.col("o_orderkey").alias("change_id"), (F.col("o_custkey") % 100).alias("request_id"), F.lit("linked").alias("relation")).where("change_id % 50 = 0")
    selected = t("lineitem").select(F.col("l_partkey").alias("request_id"), F.col("l_suppkey").alias("snapshot_id"))
    rows, lineage = ledger.evidence_rows(evidence, linked, selected, _now())
    members = lineage.groupBy("set_id").agg(F.sum("snapshot_id").alias("members"))
    return rows.join(members, F.col("artifact_set") == F.col("set_id"), "left").select("request_id", "n_artifacts", "members")


@query(
    "distinct_pages",
    views=("search_rows",),
    sql="SELECT country, count(DISTINCT page) AS n_distinct, true AS sketch_near FROM search_rows GROUP BY country",
)
def distinct_pages(t):
    """Distinct pages per country, exactly, and whether the sketches of all days come within their stated error."""
    rows = t("search_rows")
    near = provenance.sketched_distinct(provenance.day_sketches(rows, ["country"], "page"), ["country"])
    met = provenance.exact_distinct(rows, ["country"], "page").join(near, "country")
    return met.select("country", "n_distinct", (F.abs(F.col("estimate") - F.col("n_distinct")) <= F.col("n_distinct") * 2 * provenance.SKETCH_ERROR + 1).alias("sketch_near"))
