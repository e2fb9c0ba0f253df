"""Queries on metrics, windows, quality, control groups and changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import trailing_windows
from ..operators import compare, confidence, control, metrics, monitors, plans, quality, selection
from ..session import cut_lineage
from .registry import also, query, rnd
from .tables import AFTER, AFTER_DAYS, BEFORE, BEFORE_DAYS

_B = f"date BETWEEN DATE '{BEFORE[0]}' AND DATE '{BEFORE[1]}'"
_LABEL = f"CASE WHEN {_B} THEN 'before' ELSE 'after' END"


def _compare(rows, keys, **mapping):
    mapped = metrics.with_mapping(compare.label_windows(rows, BEFORE, AFTER), "m", **mapping).withColumn("overdispersion", F.lit(2.0))
    held = [*keys, "label", "before_days", "after_days", "overdispersion", "aggregation", "scale", "kind"]
    return compare.compare_periods(metrics.metric_parts(mapped, [*held, "date"]), keys)


def _welch(m1, v1, n1, m2, v2, n2):
    error = f"sqrt({v1} / {n1} + {v2} / {n2})"
    return rnd(f"CASE WHEN {error} = 0 THEN sign({m2} - {m1}) * 99.0 ELSE greatest(-99.0, least(99.0, ({m2} - {m1}) / {error})) END", 3)


def _compare_sql(rows: str, key: str, num: str, den: str | None) -> str:
    """SQL for a ratio (num and den) or a sum (num) compared between both windows."""
    value = f"CASE WHEN sum({den}) > 0 THEN CAST(sum({num}) AS DOUBLE) / CAST(sum({den}) AS DOUBLE) * 100.0 END" if den else f"CAST(sum({num}) AS DOUBLE)"
    first = value if den else f"{value} / count(*)"
    comparable = lambda side, n: f"{side}.v" if den else f"{side}.v / {n}"
    b, a = comparable("b", BEFORE_DAYS), comparable("a", AFTER_DAYS)
    return f"""day AS (SELECT {key} AS k, date, {_LABEL} AS label, CAST(sum({num}) AS BIGINT) AS {num}{f', CAST(sum({den}) AS BIGINT) AS {den}' if den else ''}, {value} AS v, count(*) AS n FROM {rows} GROUP BY 1, 2, 3),
p AS (SELECT k, label, {value} AS v, CAST(sum(n) AS BIGINT) AS row_count, count(*) AS dates, count(v) AS nv, avg(v) AS m, var_samp(v) AS var, CAST(sum({den or num}) AS DOUBLE) AS sample FROM day GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY date) AS rn, count(*) OVER (PARTITION BY k) AS c FROM day WHERE label = 'after'),
h AS (SELECT k, CASE WHEN rn <= c // 2 THEN 1 ELSE 2 END AS half, {first} AS v FROM r GROUP BY 1, 2),
j AS (SELECT b.k, b.v AS before_v, a.v AS after_v, {b} AS cb, {a} AS ca, b.m AS bm, b.var AS bvar, b.nv AS bn, a.m AS am, a.var AS avar, a.nv AS an, a.dates,
 {b} AS base, (SELECT v FROM h WHERE h.k = b.k AND half = 1) AS h1, (SELECT v FROM h WHERE h.k = b.k AND half = 2) AS h2, b.row_count AS before_rows, a.row_count AS after_rows
 FROM p b JOIN p a ON b.k = a.k AND b.label = 'before' AND a.label = 'after')
SELECT k AS {key}, {rnd('before_v', 4)} AS before_value, {rnd('after_v', 4)} AS after_value, {rnd('ca - cb', 4)} AS delta_abs, CASE WHEN cb <> 0 THEN {rnd('(ca - cb) / abs(cb) * 100', 2)} END AS delta_pct,
 {_welch('bm', 'bvar', 'bn', 'am', 'avar', 'an')} AS statistic, before_rows, after_rows,
 (h1 - base) <> 0 AND sign(h1 - base) = sign(h2 - base) AS persistent, {rnd('h1', 4)} AS first_half_value, {rnd('h2', 4)} AS second_half_value FROM j"""


_SHOWN = ("before_value", "after_value", "delta_abs", "delta_pct", "statistic", "before_rows", "after_rows", "persistent", "first_half_value", "second_half_value")


@query("ctr_period_compare", views=("search_rows",), sql="WITH " + _compare_sql("search_rows", "page", "clicks", "impressions"))
def ctr_period_compare(t):
    rows = _compare(t("search_rows"), ["page"], aggregation="ratio_of_sums", numerator="clicks", denominator="impressions", scale=100)
    return rows.select("page", *_SHOWN)


@query("clicks_period_compare", views=("search_rows",), sql="WITH " + _compare_sql("search_rows", "country", "clicks", None))
def clicks_period_compare(t):
    return _compare(t("search_rows"), ["country"], aggregation="sum", field="clicks").select("country", *_SHOWN)


@query(
    "metric_aggregations",
    views=("search_rows",),
    sql=f"""WITH m AS (SELECT page, CAST(sum(clicks) AS DOUBLE) AS s, CAST(sum(clicks) AS DOUBLE) / CAST(sum(impressions) AS DOUBLE) * 100 AS r,
 CAST(sum(position * impressions) AS DOUBLE) / CAST(sum(impressions) AS DOUBLE) AS w, avg(CAST(clicks AS DOUBLE)) AS a, CAST(arg_max(clicks, (date, clicks)) AS DOUBLE) AS l,
 count(*) AS n, count(DISTINCT date) AS d FROM search_rows GROUP BY page)
SELECT page, 'sum' AS aggregation, {rnd('s', 4)} AS value, n AS row_count, d AS distinct_dates FROM m UNION ALL SELECT page, 'ratio_of_sums', {rnd('r', 4)}, n, d FROM m
UNION ALL SELECT page, 'weighted_mean', {rnd('w', 4)}, n, d FROM m UNION ALL SELECT page, 'mean', {rnd('a', 4)}, n, d FROM m UNION ALL SELECT page, 'last', {rnd('l', 4)}, n, d FROM m""",
)
def metric_aggregations(t):
    spark = t.spark
    dictionary = spark.createDataFrame(
        [
            ("sum", "sum", "clicks", None, None, None, 1.0), ("ratio", "ratio_of_sums", None, "clicks", "impressions", None, 100.0),
            ("position", "weighted_mean", "position", None, None, "impressions", 1.0), ("mean", "mean", "clicks", None, None, None, 1.0),
            ("last", "last", "clicks", None, None, None, 1.0),
        ],
        "metric_id STRING, aggregation STRING, field STRING, numerator STRING, denominator STRING, weight STRING, scale DOUBLE",
    ).withColumns({"series": F.lit(None).cast("string"), "canonical_source": F.lit("gsc"), "fallback_sources": F.lit(None).cast("array<string>")})
    facts = t("search_rows").withColumns({"source_id": F.when(F.col("date").isNotNull(), "gsc"), "kind": F.lit("gsc_rows")})
    mapped = metrics.join_mappings(facts, metrics.resolve_mappings(dictionary)).drop("series_field").withColumn("series_field", F.lit(None).cast("string"))
    keys = ["page", "metric_id", "aggregation", "scale", "kind"]
    values = metrics.period_values(metrics.metric_parts(mapped, [*keys, "date"]), keys)
    from ..functions.numbers import round_half_up

    return values.select("page", "aggregation", round_half_up(F.col("value")).alias("value"), "row_count", "distinct_dates")


@query(
    "daily_series",
    views=("search_rows",),
    sql=f"SELECT country, date, {rnd('CAST(sum(clicks) AS DOUBLE) / CAST(sum(impressions) AS DOUBLE) * 100', 4)} AS value FROM search_rows GROUP BY country, date",
)
def daily_series(t):
    from ..functions.numbers import round_half_up

    mapped = metrics.with_mapping(t("search_rows"), "ctr", "ratio_of_sums", numerator="clicks", denominator="impressions", scale=100)
    parts = metrics.metric_parts(mapped, ["country", "aggregation", "scale", "kind", "date"])
    return metrics.daily_series(parts, ["country"]).withColumn("value", round_half_up(F.col("value")))


@query(
    "missing_dates",
    views=("search_rows",),
    sql="""SELECT q.query, CAST(d AS DATE) AS date FROM (SELECT query, min(date) AS a, max(date) AS b FROM search_rows GROUP BY 1) q,
 unnest(generate_series(CAST(q.a AS TIMESTAMP), CAST(q.b AS TIMESTAMP), INTERVAL 1 DAY)) AS g(d)
 WHERE NOT EXISTS (SELECT 1 FROM search_rows s WHERE s.query = q.query AND s.date = CAST(d AS DATE))""",
)
def missing_dates(t):
    present = t("search_rows").select("query", "date").distinct()
    spans = present.groupBy("query").agg(F.min("date").alias("start"), F.max("date").alias("end"))
    return quality.missing_dates(present, spans, ["query"])


@query(
    "duplicate_keys",
    views=("search_rows",),
    sql="SELECT date, query, page, country, count(*) AS n FROM search_rows GROUP BY 1, 2, 3, 4 HAVING count(*) > 1",
)
def duplicate_keys(t):
    return quality.duplicate_keys(t("search_rows"), ["date"], ["query", "page", "country"])


@query(
    "period_issues",
    views=("search_rows",),
    sql=f"""WITH w AS (SELECT 'before' AS label, DATE '{BEFORE[0]}' AS a, DATE '{BEFORE[1]}' AS b UNION ALL SELECT 'after', DATE '{AFTER[0]}', DATE '{AFTER[1]}'),
k AS (SELECT DISTINCT country, label, a, b FROM search_rows, w),
i AS (SELECT country, {_LABEL} AS label, date, query, page, count(*) AS n FROM search_rows GROUP BY 1, 2, 3, 4, 5),
x AS (SELECT country, label, count(*) FILTER (WHERE n > 1) AS dup, count(DISTINCT date) AS days FROM i GROUP BY 1, 2),
y AS (SELECT k.country, k.label, date_diff('day', a, b) + 1 AS len, coalesce(dup, 0) AS dup, coalesce(days, 0) AS days FROM k LEFT JOIN x USING (country, label))
SELECT country, label, 'duplicate_rows' AS code, 'major' AS severity FROM y WHERE dup > 0
UNION ALL SELECT country, label, 'missing_dates', CASE WHEN (len - days) / CAST(len AS DOUBLE) > 0.5 THEN 'blocking' WHEN (len - days) / CAST(len AS DOUBLE) > 0.1 THEN 'major' ELSE 'minor' END FROM y WHERE days > 0 AND days < len
UNION ALL SELECT country, label, 'no_rows', 'blocking' FROM y WHERE days = 0
UNION ALL SELECT country, 'after', 'incomplete_period', 'major' FROM y WHERE label = 'after' AND days > 0""",
)
def period_issues(t):
    rows = compare.label_windows(t("search_rows"), BEFORE, AFTER)
    spans = F.array(
        *[
            F.struct(F.lit(n).alias("label"), F.lit(w[0]).cast("date").alias("start"), F.lit(w[1]).cast("date").alias("end"))
            for n, w in (("before", BEFORE), ("after", AFTER))
        ]
    )
    windows = t("search_rows").select("country").distinct().select("country", F.inline(spans)).withColumns(
        {"data_through": F.lit("2001-11-01").cast("date"), "expect_daily": F.lit(True)}
    )
    found = quality.period_checks(rows, windows, ["country", "label"], ["query", "page"], ["clicks", "impressions", "position"])
    return found.select("country", "label", "code", "severity")


_RUNS = """z AS (SELECT user_id, date, value, row_number() OVER w AS i, avg(CAST(value AS DOUBLE)) OVER (PARTITION BY user_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior,
 count(*) OVER (PARTITION BY user_id) AS days FROM user_daily WINDOW w AS (PARTITION BY user_id ORDER BY date)),
g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id ORDER BY date) AS island FROM z WHERE value = 0),
runs AS (SELECT user_id, min(date) AS first_zero, count(*) AS zero_days, max(days) AS days, coalesce(arg_min(prior, i), 0) AS prior_average FROM g GROUP BY user_id, island)"""


@query("zero_runs", views=("user_daily",), sql=f"WITH {_RUNS} SELECT user_id, first_zero, zero_days, days, {rnd('prior_average', 6)} AS prior_average FROM runs")
def zero_runs(t):
    from ..functions.numbers import round_half_up

    return quality.zero_runs(t("user_daily"), ["user_id"]).withColumn("prior_average", round_half_up(F.col("prior_average"), 6))


@query(
    "sudden_zero",
    views=("user_daily",),
    sql=f"WITH {_RUNS} SELECT user_id, min(first_zero) AS first_zero FROM runs WHERE days >= 4 AND zero_days >= 2 AND prior_average >= 2 GROUP BY user_id",
)
def sudden_zero(t):
    return quality.sudden_zero(t("user_daily"), ["user_id"], min_average=2).select("user_id", "first_zero")


@query(
    "boundary_zero",
    views=("user_daily",),
    sql="""WITH d AS (SELECT user_id, date, value, CASE WHEN date < DATE '2024-01-16' THEN 'before' ELSE 'after' END AS label FROM user_daily),
s AS (SELECT user_id, count(*) FILTER (WHERE label = 'before') AS bd, count(*) FILTER (WHERE label = 'after') AS ad, avg(CAST(value AS DOUBLE)) FILTER (WHERE label = 'before') AS m,
 count(*) FILTER (WHERE label = 'after' AND value = 0) AS zero_days FROM d GROUP BY 1),
z AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date) AS i FROM d WHERE label = 'after'),
g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id ORDER BY date) AS island FROM z WHERE value = 0),
r AS (SELECT user_id, max(n) AS longest_run, min(f) AS first_zero FROM (SELECT user_id, count(*) AS n, min(date) AS f FROM g GROUP BY user_id, island) x GROUP BY user_id)
SELECT user_id, first_zero, zero_days, longest_run, CASE WHEN zero_days / CAST(ad AS DOUBLE) >= 0.5 THEN 'blocking' ELSE 'major' END AS severity
FROM s JOIN r USING (user_id) WHERE bd >= 3 AND ad >= 2 AND m >= 1 AND longest_run >= 2""",
)
def boundary_zero(t):
    split = F.when(F.col("date") < F.lit("2024-01-16").cast("date"), "before").otherwise("after")
    found = quality.boundary_zero(t("user_daily").withColumn("label", split), ["user_id"], min_average=1)
    return found.select("user_id", "first_zero", "zero_days", "longest_run", "severity")


# ---- selection -------------------------------------------------------------


@query(
    "latest_wins",
    views=("pulls",),
    sql="""WITH o AS (SELECT *, dense_rank() OVER (PARTITION BY date, country ORDER BY retrieved_at DESC, pull_id DESC) AS r FROM pulls)
SELECT date, country, CAST(max(pull_id) AS INT) AS pull_id, count(*) AS n, CAST(sum(clicks) AS BIGINT) AS clicks FROM o WHERE r = 1 GROUP BY 1, 2""",
)
def latest_wins(t):
    kept = selection.latest_wins(t("pulls"), ["date", "country"], "retrieved_at", "pull_id")
    return kept.groupBy("date", "country").agg(
        F.max("pull_id").alias("pull_id"), F.count(F.lit(1)).alias("n"), F.sum("clicks").alias("clicks")
    )


def _snapshots(t):
    """The pulls as a headers table and facts: one site grain and one page grain per country."""
    facts = t("pulls").select(
        F.concat_ws("-", F.lit("p"), "pull_id", "country").alias("snapshot_id"), F.col("country").alias("source_id"), F.lit("gsc_rows").alias("kind"),
        "date", "page", "clicks", "impressions", "position", "retrieved_at", F.when(F.col("pull_id") == 1, "date,page").otherwise("date").alias("grain"),
        F.lit(None).cast("string").alias("series"), F.lit(None).cast("string").alias("segment"),
    )
    headers = facts.groupBy("snapshot_id", "source_id", "kind", "grain").agg(
        F.max("retrieved_at").cast("timestamp").alias("retrieved_at"), F.min("date").alias("period_start"), F.max("date").alias("period_end")
    )
    headers = headers.select(
        "*", F.split("grain", ",").alias("dimensions"), F.lit(None).cast("map<string,string>").alias("filters"), F.lit(False).alias("headline_safe")
    ).drop("grain")
    return headers, facts


@query(
    "grain_choice",
    views=("pulls",),
    sql=f"""WITH c AS (SELECT country, label, CASE WHEN pull_id = 1 THEN 'date,page' ELSE 'date' END AS grain, count(DISTINCT date) AS covered, max(retrieved_at) AS latest
 FROM (SELECT *, CASE WHEN date < DATE '2001-01-01' THEN 'old' ELSE 'new' END AS label FROM pulls) x GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY country, label ORDER BY covered DESC, latest DESC) AS rn FROM c)
SELECT country AS request_id, label, grain, covered FROM r WHERE rn = 1""",
)
def grain_choice(t):
    headers, facts = _snapshots(t)
    none = F.array().cast("array<string>")
    spans = F.array(
        F.struct(F.lit("old").alias("label"), F.lit("1995-01-01").cast("date").alias("period_start"), F.lit("2000-12-31").cast("date").alias("period_end")),
        F.struct(F.lit("new").alias("label"), F.lit("2001-01-01").cast("date").alias("period_start"), F.lit("2001-12-31").cast("date").alias("period_end")),
    )
    asked = headers.select("source_id", "kind").distinct().select(
        F.col("source_id").alias("request_id"), "source_id", "kind", none.alias("require"), none.alias("exclude"), F.inline(spans)
    )
    found = selection.candidates(asked, headers).where("dated")
    best = selection.choose_grain(selection.grain_coverage(found, selection.slice_index(facts)))
    return best.select("request_id", "label", "grain", "covered")


_WINDOWS = (("1995-03-01", "1996-02-29"), ("1997-01-01", "2000-12-31"), ("2000-07-01", "2001-12-31"))


@query(
    "selected_rows",
    views=("pulls",),
    sql="""WITH w AS (SELECT * FROM (VALUES (0, DATE '1995-03-01', DATE '1996-02-29'), (1, DATE '1997-01-01', DATE '2000-12-31'), (2, DATE '2000-07-01', DATE '2001-12-31')) v(n, a, b)),
c AS (SELECT country, n, a, b, pull_id, count(DISTINCT date) AS covered, max(retrieved_at) AS latest FROM pulls JOIN w ON date BETWEEN a AND b GROUP BY 1, 2, 3, 4, 5),
r AS (SELECT *, row_number() OVER (PARTITION BY country, n ORDER BY covered DESC, latest DESC) AS rn FROM c),
s AS (SELECT r.country, r.n, count(*) AS n_rows, CAST(sum(clicks) AS BIGINT) AS clicks FROM r JOIN pulls p ON p.country = r.country AND p.pull_id = r.pull_id AND p.date BETWEEN r.a AND r.b WHERE rn = 1 GROUP BY 1, 2)
SELECT c_custkey AS request_id, n_rows, clicks FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN s ON s.country = n_name AND s.n = c_custkey % 3""",
)
def selected_rows(t):
    """One request per customer over a few windows per source: each window is selected and summed once."""
    headers, facts = _snapshots(t)
    none = F.array().cast("array<string>")
    spans = F.array(*[F.struct(*[F.lit(d).cast("date").alias(n) for d, n in zip(w, ("period_start", "period_end"))]) for w in _WINDOWS])
    asked = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("request_id"), F.lit("only").alias("label"), F.col("n_name").alias("source_id"), F.lit("gsc_rows").alias("kind"), none.alias("require"), none.alias("exclude"),
        F.element_at(spans, (F.col("c_custkey") % 3 + 1).cast("int")).alias("w"),
    )
    asked = selection.with_window(asked.select("*", "w.*").drop("w"))
    found = selection.window_slices(selection.distinct_windows(asked), headers, selection.slice_index(facts))
    sums = selection.select_rows(facts, found, ["window_id"]).groupBy("window_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("clicks").alias("clicks"))
    return asked.join(sums, "window_id").select("request_id", "n_rows", "clicks")


@query(
    "latest_two",
    views=("pulls",),
    sql="""WITH h AS (SELECT country, pull_id, max(date) AS d, max(retrieved_at) AS r FROM pulls GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY d DESC, r DESC, pull_id DESC) AS n FROM h)
SELECT country AS source_id, 'p-' || pull_id || '-' || country AS snapshot_id, CASE n WHEN 1 THEN 'current' ELSE 'previous' END AS version FROM k WHERE n <= 2""",
)
def latest_two(t):
    return selection.latest_two(_snapshots(t)[0]).select("source_id", "snapshot_id", "version")


# ---- control groups and seasonality ---------------------------------------


def _page_days(t):
    return t("detail_rows").withColumn("source_id", F.lit("gsc"))


def _control_requests(t):
    """One request per market for the tenth of its pages whose click rate changed."""
    pages = t("detail_rows").select("page").distinct().where(F.col("page").endswith("3"))
    grouped = pages.groupBy(F.regexp_extract("page", r"^/(..)/", 1).alias("request_id")).agg(F.array_sort(F.collect_list("page")).alias("pages"))
    day = lambda d: F.lit(d).cast("date")
    return grouped.withColumns(
        {"source_id": F.lit("gsc"), "before_start": day(BEFORE[0]), "before_end": day(BEFORE[1]), "after_start": day(AFTER[0]), "after_end": day(AFTER[1])}
    )


_CONTROL = f"""w AS (SELECT page, substr(page, 2, 2) AS m, sum(impressions) FILTER (WHERE date BETWEEN DATE '{BEFORE[0]}' AND DATE '{BEFORE[1]}') AS b,
 count(*) FILTER (WHERE date BETWEEN DATE '{AFTER[0]}' AND DATE '{AFTER[1]}') AS a FROM detail_rows GROUP BY page),
tr AS (SELECT page FROM w WHERE page LIKE '%3'),
ch AS (SELECT DISTINCT page FROM changed WHERE date BETWEEN DATE '{BEFORE[0]}' AND DATE '{AFTER[1]}'),
cp AS (SELECT m AS request_id, page, CAST(b AS BIGINT) AS before_impressions, row_number() OVER (PARTITION BY m ORDER BY b DESC, page) AS rank FROM w
 WHERE b IS NOT NULL AND a > 0 AND page NOT IN (SELECT page FROM tr) AND page NOT IN (SELECT page FROM ch))"""
_CHANGED = "changed AS (SELECT CAST(o_orderdate AS DATE) AS date, '/ec/part-' || (o_orderkey % 997) AS page FROM orders UNION ALL SELECT CAST(o_orderdate AS DATE), '/sm/part-' || (o_orderkey % 991) FROM orders)"


def _changed(t):
    orders = t("orders").select(F.to_date("o_orderdate").alias("date"), "o_orderkey")
    name = lambda prefix, mod: F.concat(F.lit(prefix), (F.col("o_orderkey") % mod).cast("string"))
    return orders.select("date", F.array(name("/ec/part-", 997), name("/sm/part-", 991)).alias("pages"))


@query(
    "control_pages",
    views=("detail_rows",),
    sql=f"WITH {_CHANGED}, {_CONTROL} SELECT request_id, page, before_impressions, CAST(rank AS INT) AS rank FROM cp WHERE rank <= 200",
)
def control_pages(t):
    chosen = control.control_pages(_page_days(t), _control_requests(t), _changed(t), limit=200)
    return chosen.select("request_id", "page", "before_impressions", "rank")


@query(
    "planned_controls",
    views=("detail_rows",),
    sql=f"""WITH {_CHANGED}, w AS (SELECT page, substr(page, 2, 2) AS m, sum(impressions) AS b FROM detail_rows WHERE {_B} GROUP BY page),
ch AS (SELECT DISTINCT page FROM changed WHERE {_B})
SELECT m AS request_id, page, CAST(b AS BIGINT) AS before_impressions, CAST(row_number() OVER (PARTITION BY m ORDER BY b DESC, page) AS INT) AS rank FROM w
 WHERE page NOT LIKE '%3' AND page NOT IN (SELECT page FROM ch)""",
)
def planned_controls(t):
    """Control pages fixed before any outcome: only the window before counts, and all of them stay."""
    chosen = control.control_pages(_page_days(t), _control_requests(t), _changed(t), planning=True)
    return chosen.select("request_id", "page", "before_impressions", "rank")


also("control_pages_all_days", "control_pages")
also("planned_controls_all_days", "planned_controls")


@query(
    "fixed_plans",
    views=("detail_rows",),
    sql=f"""WITH {_CHANGED}, w AS (SELECT page, substr(page, 2, 2) AS m, sum(impressions) AS b FROM detail_rows WHERE {_B} GROUP BY page),
ch AS (SELECT DISTINCT page FROM changed WHERE {_B}),
cp AS (SELECT m, page FROM w WHERE page NOT LIKE '%3' AND page NOT IN (SELECT page FROM ch)),
s AS (SELECT m, count(DISTINCT cp.page) AS n_pages, CAST(sum(impressions) FILTER (WHERE {_B}) AS BIGINT) AS before_total, CAST(sum(impressions) FILTER (WHERE NOT {_B}) AS BIGINT) AS after_total FROM cp JOIN detail_rows USING (page) GROUP BY m)
SELECT m AS experiment_id, CASE WHEN m = 'sm' THEN 'changed' ELSE 'fixed' END AS plan_status, n_pages, CASE WHEN m <> 'sm' THEN before_total END AS before_total, CASE WHEN m <> 'sm' THEN after_total END AS after_total FROM s""",
)
def fixed_plans(t):
    """Plans fixed on the window before, judged on the one after; a set that was added to later is refused."""
    requests = cut_lineage(_control_requests(t))
    asked = requests.withColumnRenamed("request_id", "experiment_id")
    chosen = control.control_pages(_page_days(t), requests, _changed(t), planning=True).select(F.col("request_id").alias("experiment_id"), "page")
    made, pages = plans.fix_plans(asked, chosen, None, F.lit("1998-06-04 00:00:00").cast("timestamp"))
    added = pages.where("experiment_id = 'sm'").select("experiment_id", F.concat("page", F.lit("-new")).alias("page"))
    return plans.evaluate_plans(made, pages.unionByName(added), t("detail_rows"))


def _did_daily(t):
    rows = compare.label_windows(t("detail_rows"), BEFORE, AFTER)
    role = F.when(F.col("page").endswith("3"), "treated").otherwise("control")
    return rows.groupBy(F.regexp_extract("page", r"^/(..)/", 1).alias("market"), "label", role.alias("role"), "date").agg(
        F.sum("clicks").cast("double").alias("value")
    )


@query(
    "did_effect",
    views=("detail_rows",),
    sql=f"""WITH d AS (SELECT substr(page, 2, 2) AS market, {_LABEL} AS label, date, CAST(sum(clicks) FILTER (WHERE page LIKE '%3') AS DOUBLE) AS t, CAST(sum(clicks) FILTER (WHERE page NOT LIKE '%3') AS DOUBLE) AS c
 FROM detail_rows GROUP BY 1, 2, 3),
b AS (SELECT market, avg(t) AS tb, avg(c) AS cb FROM d WHERE label = 'before' GROUP BY 1),
x AS (SELECT d.market, label, date, t / tb - c / cb AS v FROM d JOIN b USING (market) WHERE t IS NOT NULL AND c IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY market, label ORDER BY date) AS i, count(*) OVER (PARTITION BY market, label) AS k FROM x),
h AS (SELECT *, CASE WHEN label = 'before' THEN CASE WHEN i <= k // 2 THEN 1 ELSE 2 END END AS half FROM n),
s AS (SELECT market, count(*) FILTER (WHERE label = 'before') AS bn, avg(v) FILTER (WHERE label = 'before') AS bm, var_samp(v) FILTER (WHERE label = 'before') AS bv,
 count(*) FILTER (WHERE label = 'after') AS an, avg(v) FILTER (WHERE label = 'after') AS am, var_samp(v) FILTER (WHERE label = 'after') AS av,
 count(*) FILTER (WHERE half = 1) AS n1, avg(v) FILTER (WHERE half = 1) AS m1, var_samp(v) FILTER (WHERE half = 1) AS v1,
 count(*) FILTER (WHERE half = 2) AS n2, avg(v) FILTER (WHERE half = 2) AS m2, var_samp(v) FILTER (WHERE half = 2) AS v2 FROM h GROUP BY 1),
f AS (SELECT market, {rnd('(am - bm) * 100', 3)} AS effect, {_welch('bm', 'bv', 'bn', 'am', 'av', 'an')} AS statistic, {_welch('m1', 'v1', 'n1', 'm2', 'v2', 'n2')} AS pre_trend, bn AS matched_before, an AS matched_after FROM s WHERE bn >= 7 AND an >= 7)
SELECT *, abs(pre_trend) < 2 AS pre_trend_passed FROM f""",
)
def did_effect(t):
    did = control.difference_in_differences(_did_daily(t), ["market"])
    return did.select("market", "effect", "statistic", "pre_trend", "pre_trend_passed", "matched_before", "matched_after")


@query(
    "seasonal_check",
    sql=f"""WITH o AS (SELECT o_custkey % 50 AS region, CAST(o_orderdate AS DATE) AS date FROM orders),
q AS (SELECT CAST(unnest(range(0, 24)) AS INT) AS i),
w AS (SELECT i, 'before' AS label, DATE '1996-01-01' + i * 84 AS a, DATE '1996-01-01' + i * 84 + 41 AS b FROM q UNION ALL SELECT i, 'after', DATE '1996-01-01' + i * 84 + 42, DATE '1996-01-01' + i * 84 + 83 FROM q),
l AS (SELECT * FROM w UNION ALL SELECT i, 'ly_' || label, a - 364, b - 364 FROM w),
v AS (SELECT region, i, label, CAST(count(*) AS DOUBLE) AS value, count(DISTINCT date) / CAST(42 AS DOUBLE) AS cover FROM o JOIN l ON date BETWEEN a AND b GROUP BY 1, 2, 3),
p AS (SELECT region, i, max(value) FILTER (WHERE label = 'before') AS b, max(value) FILTER (WHERE label = 'after') AS a, max(value) FILTER (WHERE label = 'ly_before') AS lb, max(value) FILTER (WHERE label = 'ly_after') AS la,
 coalesce(max(cover) FILTER (WHERE label = 'ly_before') >= 0.5 AND max(cover) FILTER (WHERE label = 'ly_after') >= 0.5, false) AS checked FROM v GROUP BY 1, 2)
SELECT region, i AS quarter, checked, CASE WHEN checked THEN {rnd('(la - lb) / lb * 100', 2)} END AS last_year_change_pct, {rnd('(a - b) / b * 100', 2)} AS observed_change_pct FROM p""",
)
def seasonal_check(t):
    daily = t("orders").groupBy((F.col("o_custkey") % 50).alias("region"), F.to_date("o_orderdate").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    start = F.lit("1996-01-01").cast("date")
    windows = t.spark.range(24).select(F.col("id").cast("int").alias("quarter")).select(
        "quarter",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(n).alias("label"), F.date_add(start, F.col("quarter") * 84 + lo).alias("start"), F.date_add(start, F.col("quarter") * 84 + hi).alias("end"))
                    for n, lo, hi in (("before", 0, 41), ("after", 42, 83))
                ]
            )
        ),
    )
    spans = control.with_last_year(windows)
    days = spans.select("*", F.explode(F.sequence("start", "end")).alias("date"))
    values = daily.join(days, "date").groupBy("region", "quarter", "label", "start", "end").agg(
        F.sum("n").cast("double").alias("value"), F.count(F.lit(1)).alias("dates")
    )
    return control.seasonal_check(values, ["region", "quarter"])


# ---- monitors, funnels, sources -------------------------------------------

_MON = """d AS (SELECT user_id % 20 AS shard, event_type, CAST(ts AS DATE) AS date, count(*) AS v FROM events GROUP BY 1, 2, 3),
p AS (SELECT shard, event_type, CASE WHEN date >= DATE '2024-01-24' THEN 'after' ELSE 'before' END AS label, CAST(sum(v) AS DOUBLE) AS s, count(*) AS n, avg(CAST(v AS DOUBLE)) AS m, var_samp(CAST(v AS DOUBLE)) AS var
 FROM d WHERE date >= DATE '2024-01-17' GROUP BY 1, 2, 3),
j AS (SELECT b.shard, b.event_type, b.s AS bs, a.s AS sa, b.n AS bn, a.n AS an, b.m AS bm, a.m AS am, b.var AS bv, a.var AS av FROM (SELECT * FROM p WHERE label = 'before') b LEFT JOIN (SELECT * FROM p WHERE label = 'after') a USING (shard, event_type))"""


@query(
    "monitor_pass",
    sql=f"""WITH {_MON},
g AS (SELECT shard, event_type, bs, sa, {rnd('sa - bs', 4)} AS da, {rnd('(sa - bs) / bs * 100', 2)} AS dp,
 CASE WHEN bn >= 7 AND an >= 7 THEN {_welch('bm', 'bv', 'bn', 'am', 'av', 'an')} ELSE {rnd('greatest(-99.0, least(99.0, (sa / 7 - bs / 7) / sqrt(bs / 49 + sa / 49) / 1.4142135623730951))', 3)} END AS st FROM j)
SELECT event_type || '-' || shard AS monitor_id, CASE WHEN bs >= 10 AND (sa IS NULL OR sa = 0) THEN 'alert' WHEN sa IS NULL THEN 'insufficient_data' WHEN abs(dp) >= 25 AND abs(da) >= 3 AND bs >= 10 AND abs(st) >= 2 THEN 'alert' ELSE 'quiet' END AS outcome,
 bs AS before_value, sa AS after_value, dp AS delta_pct, st AS statistic FROM g""",
)
def monitor_pass(t):
    daily = t("events").groupBy((F.col("user_id") % 20).alias("shard"), "event_type", F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("value"))
    keyed = daily.withColumn("monitor_id", F.concat_ws("-", "event_type", F.col("shard").cast("string")))
    windows = trailing_windows(F.lit("2024-01-30").cast("date"), 7)
    labelled = keyed.where(F.col("date") >= windows["before_start"]).withColumns(
        {
            "label": F.when(F.col("date") >= windows["after_start"], "after").otherwise("before"), "before_days": F.lit(7), "after_days": F.lit(7),
            "overdispersion": F.lit(2.0), "series": F.lit("m"),
        }
    )
    mapped = metrics.with_mapping(labelled, "m", "sum", series="m", kind="timeseries")
    held = ["monitor_id", "label", "before_days", "after_days", "overdispersion", "aggregation", "scale", "kind", "date"]
    compared = compare.compare_periods(metrics.metric_parts(mapped, held), ["monitor_id"]).withColumns(
        {"data_quality": F.lit("high"), "min_sample": F.lit(10.0), "metric_id": F.lit("m"), "source_id": F.lit("events")}
    )
    rules = compared.where("before_value IS NOT NULL").select(
        "monitor_id", F.lit("m").alias("metric_id"), F.lit("events").alias("source_id"), F.lit(25.0).alias("relative_threshold_pct"),
        F.lit(3.0).alias("absolute_threshold"), F.lit(10.0).alias("min_sample"), F.lit(2.0).alias("min_significance"), F.lit("both").alias("direction"),
        F.lit("medium").alias("severity"), F.lit(True).alias("enabled"),
    )
    found = monitors.evaluate_monitors(rules, compared)
    return found.select("monitor_id", "outcome", "before_value", "after_value", "delta_pct", "statistic")


@query(
    "funnel_steps",
    sql=f"""WITH s AS (SELECT user_id % 20 AS funnel_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 END AS stage_no, event_type AS metric_id, count(*) AS value FROM events WHERE event_type <> 'error' GROUP BY 1, 2, 3),
l AS (SELECT *, lag(metric_id) OVER w AS f, lag(value) OVER w AS b FROM s WINDOW w AS (PARTITION BY funnel_id ORDER BY stage_no))
SELECT funnel_id, stage_no, f AS from_metric, metric_id AS to_metric, {rnd('CAST(value AS DOUBLE) / b * 100', 2)} AS conversion_pct FROM l WHERE f IS NOT NULL""",
)
def funnel_steps(t):
    stage = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).when(F.col("event_type") == "signup", 3).otherwise(4)
    stages = t("events").where("event_type <> 'error'").groupBy(
        (F.col("user_id") % 20).alias("funnel_id"), stage.alias("stage_no"), F.col("event_type").alias("metric_id")
    ).agg(F.count(F.lit(1)).alias("value"))
    return monitors.funnel_steps(stages.withColumn("source_id", F.lit("events"))).drop("note")


@query(
    "source_discrepancy",
    views=("series", "series_alt"),
    sql=f"""SELECT date, metric, CAST(b.value AS BIGINT) AS value, CAST(a.value AS BIGINT) AS canonical_value, {rnd('(CAST(b.value AS DOUBLE) - a.value) / a.value * 100', 2)} AS difference_pct
FROM series a JOIN series_alt b USING (date, metric) WHERE abs((CAST(b.value AS DOUBLE) - a.value) / a.value * 100) > 5""",
)
def source_discrepancy(t):
    values = t("series").withColumns({"source_id": F.lit("db"), "is_canonical": F.lit(True)}).unionByName(
        t("series_alt").withColumns({"source_id": F.lit("alt"), "is_canonical": F.lit(False)})
    )
    return quality.discrepancies(values, ["date", "metric"]).drop("source_id", "canonical_source")


# ---- changes and levels ----------------------------------------------------


def _changes(t):
    return t("changes").select(
        F.col("change_id").cast("string").alias("change_id"), "type", "deploy_status",
        F.when(F.col("change_id") % 7 != 0, F.col("live_date")).alias("live_date"),
        F.when(F.col("page").isNotNull(), F.array("page")).alias("pages"), F.lit(None).cast("string").alias("experiment_id"),
        (F.col("change_id") % 2 == 0).alias("confirmed"), F.lit(None).cast("string").alias("supersedes"),
    )


def _change_requests(t):
    """One request per page; each page is linked to its first placed change."""
    pages = t("search_rows").select("page").distinct()
    first = _changes(t).where("live_date IS NOT NULL AND deploy_status <> 'pending'").select(F.explode("pages").alias("page"), "change_id").groupBy("page").agg(
        F.min("change_id").alias("_c")
    )
    day = lambda d: F.lit(d).cast("date")
    return pages.join(first, "page", "left").select(
        F.col("page").alias("request_id"), F.array("page").alias("scope_pages"), F.array_compact(F.array("_c")).alias("change_ids"),
        F.lit(None).cast("string").alias("experiment_id"), day(BEFORE[0]).alias("before_start"), day(BEFORE[1]).alias("before_end"),
        day(AFTER[0]).alias("after_start"), day(AFTER[1]).alias("after_end"),
    )


_CH = f"""c AS (SELECT CAST(change_id AS VARCHAR) AS change_id, type, deploy_status, CASE WHEN change_id % 7 <> 0 THEN live_date END AS live_date, page, change_id % 2 = 0 AS confirmed FROM changes WHERE deploy_status <> 'pending'),
f AS (SELECT page, min(change_id) AS change_id FROM c WHERE live_date IS NOT NULL AND page IS NOT NULL GROUP BY 1),
k AS (SELECT p.page AS request_id, c.change_id, CASE WHEN f.change_id = c.change_id THEN 'linked' WHEN live_date IS NULL THEN 'unplaced' ELSE 'overlapping' END AS relation, c.type, c.live_date, c.confirmed
 FROM (SELECT DISTINCT page FROM search_rows) p JOIN c ON c.page = p.page LEFT JOIN f ON f.page = p.page WHERE live_date IS NULL OR live_date BETWEEN DATE '{BEFORE[0]}' AND DATE '{AFTER[1]}' OR f.change_id = c.change_id)"""


@query("change_overlap", views=("search_rows", "changes"), sql=f"WITH {_CH} SELECT request_id, change_id, relation, type, live_date FROM k")
def change_overlap(t):
    return confidence.classify_changes(_changes(t), _change_requests(t)).select("request_id", "change_id", "relation", "type", "live_date")


@query(
    "shared_changes",
    views=("changes",),
    sql=f"""SELECT CAST(change_id AS VARCHAR) AS change_id, CASE WHEN change_id % 7 <> 0 THEN 'overlapping' ELSE 'unplaced' END AS relation, page IS NOT NULL AS site_only, type FROM changes
WHERE deploy_status <> 'pending' AND (change_id % 7 = 0 OR live_date BETWEEN DATE '{BEFORE[0]}' AND DATE '{AFTER[1]}')""",
)
def shared_changes(t):
    return confidence.shared_changes(_changes(t), _change_requests(t)).select("change_id", "relation", "site_only", "type")


_CONF = f"""o AS (SELECT request_id, change_id AS ref, CASE WHEN relation = 'overlapping' THEN 'major' WHEN relation = 'unplaced' THEN 'minor' END AS severity,
 CASE WHEN relation = 'overlapping' THEN CASE WHEN type = 'tracking_change' THEN 'tracking_change' ELSE 'overlapping_change' END WHEN relation = 'unplaced' THEN 'unplaced_change' END AS code FROM k WHERE relation <> 'linked'
UNION ALL SELECT request_id, change_id, 'minor', 'unconfirmed_change' FROM k WHERE relation = 'linked' AND NOT confirmed
UNION ALL SELECT request_id, change_id, CASE WHEN s <= 0.05 THEN 'info' WHEN s <= 0.25 THEN 'minor' ELSE 'major' END, 'linked_change_in_baseline' FROM (SELECT *, (date_diff('day', live_date, DATE '{BEFORE[1]}') + 1) / CAST({BEFORE_DAYS} AS DOUBLE) AS s FROM k WHERE relation = 'linked' AND live_date BETWEEN DATE '{BEFORE[0]}' AND DATE '{BEFORE[1]}') x
UNION ALL SELECT request_id, change_id, CASE WHEN s <= 0.05 THEN 'info' ELSE 'minor' END, 'linked_change_mid_window' FROM (SELECT *, (date_diff('day', DATE '{AFTER[0]}', live_date) + 1) / CAST({AFTER_DAYS} AS DOUBLE) AS s FROM k WHERE relation = 'linked' AND live_date > DATE '{AFTER[0]}' AND live_date <= DATE '{AFTER[1]}') y)"""


@query("confounders", views=("search_rows", "changes"), sql=f"WITH {_CH}, {_CONF} SELECT request_id, ref, severity, code FROM o")
def confounders(t):
    asked = _change_requests(t)
    return confidence.change_confounders(confidence.classify_changes(_changes(t), asked), asked)


@query(
    "causal_levels",
    views=("search_rows", "changes"),
    sql="WITH "
    + _compare_sql("search_rows", "page", "clicks", "impressions").rsplit("\nSELECT", 1)[0]
    + f""", e AS (SELECT page AS request_id, before_value, after_value, delta_abs, statistic, persistent FROM (SELECT {_compare_sql("search_rows", "page", "clicks", "impressions").rsplit("SELECT", 1)[1]}) z),
st AS (SELECT request_id, least(CASE WHEN abs(statistic) >= 3 THEN 3 WHEN abs(statistic) >= 2 THEN 2 ELSE 1 END, CASE WHEN NOT persistent OR delta_abs = 0 THEN 1 ELSE 3 END) AS s FROM e),
{_CH.replace('f AS (', 'fc AS (').replace(' f ON f.page', ' fc ON fc.page').replace('f.change_id', 'fc.change_id')}, {_CONF},
n AS (SELECT request_id, count(*) FILTER (WHERE severity = 'major') AS ma, count(*) FILTER (WHERE severity = 'minor') AS mi FROM o GROUP BY 1),
li AS (SELECT request_id, count(*) AS l FROM k WHERE relation = 'linked' GROUP BY 1),
lv AS (SELECT st.request_id, s, coalesce(l, 0) AS l, greatest(1, least(2, s) - coalesce(ma, 0) - CASE WHEN coalesce(mi, 0) >= 3 THEN 1 ELSE 0 END) AS c FROM st LEFT JOIN n USING (request_id) LEFT JOIN li USING (request_id))
SELECT request_id, CASE s WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS evidence_strength, CASE WHEN l = 0 THEN 'none' WHEN c = 3 THEN 'high' WHEN c = 2 THEN 'medium' ELSE 'low' END AS causal_confidence FROM lv""",
)
def causal_levels(t):
    compared = _compare(t("search_rows"), ["page"], aggregation="ratio_of_sums", numerator="clicks", denominator="impressions", scale=100)
    graded = confidence.evidence_strength(compared.withColumns({"data_quality": F.lit("high"), "min_sample": F.lit(None).cast("double")}))
    asked = _change_requests(t)
    classified = confidence.classify_changes(_changes(t), asked)
    counts = confidence.confounder_counts(confidence.change_confounders(classified, asked))
    judged = confidence.causal_confidence(
        graded.withColumnRenamed("page", "request_id")
        .join(counts, "request_id", "left")
        .join(confidence.linked_timing(classified, asked), "request_id", "left")
        .withColumns({"design": F.lit("before_after"), "design_ceiling": F.lit(None).cast("string")})
    )
    return judged.select("request_id", "evidence_strength", "causal_confidence")


_EVIDENCE = _compare_sql("search_rows", "country", "clicks", "impressions").rsplit("\nSELECT", 1)


@query(
    "measured_evidence",
    views=("search_rows",),
    # deltas are withheld where more than half of a window's days are missing
    sql=f"""WITH {_EVIDENCE[0]}, x AS (SELECT{_EVIDENCE[1]}),
ok AS (SELECT country, count(DISTINCT date) FILTER (WHERE {_B}) >= {BEFORE_DAYS} * 0.5 AND count(DISTINCT date) FILTER (WHERE NOT {_B}) >= {AFTER_DAYS} * 0.5 AS enough FROM search_rows GROUP BY 1)
SELECT country AS request_id, before_value, after_value, CASE WHEN enough THEN delta_abs END AS delta_abs, CASE WHEN enough THEN delta_pct END AS delta_pct, statistic, persistent FROM x JOIN ok USING (country)""",
)
def measured_evidence(t):
    """The whole measurement job: one click-rate request per country over all search rows."""
    from .. import schemas
    from ..plans.comparison import Evidence, analyze

    spark = t.spark
    none = lambda kind: F.lit(None).cast(kind)
    facts = t("search_rows").withColumns(
        {
            "snapshot_id": F.lit("pull-1"), "source_id": F.lit("gsc"), "kind": F.lit("gsc_rows"), "device": none("string"), "segment": none("string"),
            "series": none("string"), "value": none("double"),
        }
    )
    headers = facts.groupBy("snapshot_id", "source_id", "kind").agg(F.min("date").alias("period_start"), F.max("date").alias("period_end")).withColumns(
        {
            "adapter_version": F.lit(1), "property": none("string"), "retrieved_at": F.lit("2001-11-05 06:00:00").cast("timestamp"),
            "dimensions": F.array(*[F.lit(d) for d in ("date", "query", "page", "country")]), "filters": none("map<string,string>"),
            "headline_safe": F.lit(False), "warnings": F.array().cast("array<string>"),
        }
    )
    requests = cut_lineage(t("search_rows").select("country").distinct()).select(
        F.col("country").alias("request_id"), F.lit("organic_ctr").alias("metric_id"), F.lit("gsc").alias("source_id"),
        *[F.lit(d).cast("date").alias(n) for n, d in zip(("before_start", "before_end", "after_start", "after_end"), (*BEFORE, *AFTER))],
        F.create_map(F.lit("country"), F.array("country")).alias("scope"), none("array<string>").alias("change_ids"), none("string").alias("experiment_id"),
        F.lit("before_after").alias("design"), F.lit("none").alias("control"), none("array<string>").alias("control_pages"), none("array<string>").alias("context_refs"),
    )

    def row(schema, **values):
        return spark.createDataFrame([tuple(values.get(n) for n in schemas.column_names(schema))], schema)

    dictionary = row(
        schemas.METRICS, metric_id="organic_ctr", status="active", aggregation="ratio_of_sums", numerator="clicks", denominator="impressions", scale=100.0,
        canonical_source="gsc", min_sample=500.0,
    )
    sources = row(schemas.SOURCES, source_id="gsc", kind="gsc_rows", status="configured", timezone="UTC").withColumns(
        {"stale_after_hours": F.lit(9999.0), "data_through": F.lit(AFTER[1]).cast("date"), "last_success_at": F.lit("2001-11-05 06:00:00").cast("timestamp")}
    )
    registry = _changes(t).select(
        "change_id", "type", "deploy_status", F.col("live_date").cast("timestamp").alias("live_at"), "pages", "experiment_id", "confirmed", "supersedes"
    )
    job = Evidence(snapshots=headers, facts=facts, metrics=dictionary, sources=sources, changes=registry)
    now = F.lit("2001-11-05 08:00:00").cast("timestamp")
    found = analyze(job, requests, now, scope_sets=(("country",),), with_control=False, seasonality=False)["evidence"]
    return found.select("request_id", "before_value", "after_value", "delta_abs", "delta_pct", "statistic", "persistent")
