"""Queries on search rows: totals, curve, opportunities, movement, rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search as s
from .registry import also, keep_sql, movement_sql, query, rnd, totals_sql, cdf_sql
from .tables import AFTER, AFTER_DAYS, BEFORE, BEFORE_DAYS

_AFTER_SQL = f"date BETWEEN DATE '{AFTER[0]}' AND DATE '{AFTER[1]}'"
_CURVE = "(VALUES (1,27),(2,15),(3,10),(4,7),(5,5.5),(6,4.2),(7,3.4),(8,2.8),(9,2.4),(10,2.1),(11,1.6),(12,1.4),(13,1.2),(14,1.1),(15,1.0),(20,0.6),(30,0.3))"
_KNOTS = f"knots AS (SELECT CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM {_CURVE} k(x, y))"


def _after(rows):
    return rows.where(F.col("date").between(*[F.lit(d).cast("date") for d in AFTER]))


def _fit(rows):
    return s.fit_ctr_curve(rows, normalize=False)


_PAIRS = f"pairs AS (SELECT query, page, {totals_sql()} FROM detail_rows GROUP BY query, page)"
# points of the fitted curve, then the closed min-max form of the pooled fit
_FIT = f"""{_KNOTS}, {_PAIRS},
buckets AS (SELECT greatest(1, CAST(floor(avg_position + 0.5) AS INT)) AS i, CAST(sum(clicks) AS DOUBLE) AS c, CAST(sum(impressions) AS DOUBLE) AS im, count(*) AS n FROM pairs WHERE impressions > 0 AND avg_position IS NOT NULL GROUP BY 1),
heur AS (SELECT i, CASE WHEN i <= 15 THEN (SELECT y FROM knots WHERE x = i) ELSE 1.0 + (i - 15) / CAST(5 AS DOUBLE) * (CAST(0.6 AS DOUBLE) - CAST(1.0 AS DOUBLE)) END AS y FROM (SELECT CAST(unnest(range(1, 21)) AS INT) AS i) r),
points AS (SELECT h.i, CASE WHEN b.im >= 500 AND b.n >= 5 THEN b.c / b.im * 100 ELSE h.y END AS ctr, CASE WHEN b.im >= 500 AND b.n >= 5 THEN b.im ELSE 50.0 END AS w,
 coalesce(b.im >= 500 AND b.n >= 5, false) AS fit FROM heur h LEFT JOIN buckets b ON h.i = b.i),
seg AS (SELECT a.i AS s, b.i AS t, sum(m.ctr * m.w) / sum(m.w) AS v FROM points a JOIN points b ON b.i >= a.i JOIN points m ON m.i BETWEEN a.i AND b.i GROUP BY 1, 2),
hi AS (SELECT p.i, seg.s, max(seg.v) AS v FROM points p JOIN seg ON seg.s <= p.i AND seg.t >= p.i GROUP BY 1, 2),
fitc AS (SELECT i, {rnd('min(v)', 3)} AS y FROM hi GROUP BY i),
curve AS (SELECT CAST(i AS DOUBLE) AS x, y FROM fitc UNION ALL SELECT 30.0, least((SELECT y FROM fitc WHERE i = 20), CAST(0.3 AS DOUBLE))),
legs AS (SELECT x AS x1, y AS y1, lead(x) OVER (ORDER BY x) AS x2, lead(y) OVER (ORDER BY x) AS y2 FROM curve)"""
_EXPECT = """(CASE WHEN avg_position <= 1 THEN (SELECT y FROM curve WHERE x = 1) WHEN avg_position > 30 THEN (SELECT y FROM curve WHERE x = 30)
 ELSE (SELECT y1 + (avg_position - x1) / (x2 - x1) * (y2 - y1) FROM legs WHERE avg_position > x1 AND avg_position <= x2) END)"""
_NOW = f"now_pairs AS (SELECT query, page, {totals_sql()} FROM detail_rows WHERE {_AFTER_SQL} GROUP BY query, page)"


@query("search_totals", views=("search_rows",), sql=f"SELECT {totals_sql()}, CAST(0 AS BIGINT) AS missing FROM search_rows")
def search_totals(t):
    return s.search_totals(t("search_rows"))


@query(
    "headline_totals",
    views=("pulls",),
    sql=f"SELECT bool_and(pull_id < 2) AS headline_safe, {totals_sql()}, CAST(0 AS BIGINT) AS missing FROM pulls",
)
def headline_totals(t):
    return s.headline_totals(t("pulls").withColumn("headline_safe", F.col("pull_id") < 2))


@query(
    "rollup_sets",
    views=("search_rows",),
    sql=f"""SELECT 'query' AS grain, query, NULL AS page, NULL AS country, {totals_sql()}, CAST(0 AS BIGINT) AS missing FROM search_rows GROUP BY query
UNION ALL SELECT 'page', NULL, page, NULL, {totals_sql()}, 0 FROM search_rows GROUP BY page
UNION ALL SELECT 'page,country', NULL, page, country, {totals_sql()}, 0 FROM search_rows GROUP BY page, country""",
)
def rollup_sets(t):
    return s.rollup_sets(t("search_rows"), [["query"], ["page"], ["page", "country"]]).select(
        "grain", "query", "page", "country", "clicks", "impressions", "ctr_pct", "avg_position", "missing"
    )


@query(
    "top_queries",
    views=("search_rows",),
    sql=f"SELECT query, {totals_sql()}, CAST(0 AS BIGINT) AS missing FROM search_rows GROUP BY query ORDER BY impressions DESC, query LIMIT 10",
)
def top_queries(t):
    return s.top_rows(t("search_rows"), "query", "impressions")


@query(
    "top_pages",
    views=("search_rows",),
    sql=f"SELECT page, {totals_sql()}, CAST(0 AS BIGINT) AS missing FROM search_rows GROUP BY page ORDER BY clicks DESC, page LIMIT 10",
)
def top_pages(t):
    return s.top_rows(t("search_rows"), "page", "clicks")


@query(
    "position_buckets",
    views=("detail_rows",),
    sql=f"""WITH {_PAIRS} SELECT greatest(1, CAST(floor(avg_position + 0.5) AS INT)) AS position_bucket, CAST(sum(clicks) AS BIGINT) AS clicks,
 CAST(sum(impressions) AS BIGINT) AS impressions, count(*) AS rows FROM pairs WHERE impressions > 0 AND floor(avg_position + 0.5) <= 20 GROUP BY 1""",
)
def position_buckets(t):
    return s.position_buckets(s.rollup(t("detail_rows"), ["query", "page"], normalize=False))


@query(
    "ctr_curve",
    views=("detail_rows",),
    sql=f"""WITH {_FIT} SELECT x AS position, y AS ctr_pct, (SELECT count(*) FROM points WHERE fit) AS fitted_buckets,
 CASE WHEN (SELECT count(*) FROM points WHERE fit) = 0 THEN 'heuristic' WHEN (SELECT count(*) FROM points WHERE fit) >= 8 THEN 'fitted' ELSE 'mixed' END AS source FROM curve""",
)
def ctr_curve(t):
    points = s.curve_points(_fit(t("detail_rows")))
    return points.withColumn("fitted_buckets", F.col("fitted_buckets").cast("bigint"))


@query(
    "ctr_opportunities",
    views=("detail_rows",),
    sql=f"""WITH {_FIT}, {_NOW},
e AS (SELECT *, {rnd(_EXPECT, 2)} AS expected_ctr_pct FROM now_pairs WHERE impressions >= 500 AND avg_position BETWEEN 1 AND 15),
c AS (SELECT *, expected_ctr_pct / 100 AS r FROM e WHERE ctr_pct < expected_ctr_pct * CAST(0.5 AS DOUBLE)),
z AS (SELECT *, CASE WHEN r > 0 AND r < 1 THEN (clicks - impressions * r) / sqrt(impressions * r * (1.0 - r) * 2.0) END AS z FROM c),
p AS (SELECT *, coalesce({cdf_sql('z')}, 1.0) AS p FROM z),
k AS ({keep_sql('p', 'p', 0.1)})
SELECT query, page, clicks, impressions, ctr_pct, avg_position, expected_ctr_pct, {rnd('p', 6)} AS p_value, {rnd('expected_ctr_pct - ctr_pct', 2)} AS ctr_gap_pct_points,
 {rnd(f'impressions * (expected_ctr_pct - ctr_pct) / 100 * 28 / {AFTER_DAYS}', 1)} AS estimated_click_gain_28d FROM k""",
)
def ctr_opportunities(t):
    rows = t("detail_rows")
    return s.ctr_opportunities(_after(rows), curves=_fit(rows), days=AFTER_DAYS, normalize=False)


@query(
    "striking_distance",
    views=("detail_rows",),
    sql=f"""WITH {_FIT}, {_NOW},
u AS (SELECT *, {rnd(f"greatest(CAST(0 AS DOUBLE), impressions * ((SELECT y FROM curve WHERE x = 3) - coalesce(ctr_pct, 0)) / 100 * 28 / {AFTER_DAYS})", 1)} AS upside_if_top3_28d
 FROM now_pairs WHERE impressions >= 100 AND avg_position IS NOT NULL)
SELECT CASE WHEN avg_position <= 15 THEN 'positions_4_15' ELSE 'positions_15_30' END AS band, query, page, clicks, impressions, ctr_pct, avg_position, upside_if_top3_28d
FROM u WHERE avg_position >= 4 AND avg_position <= 30""",
)
def striking_distance(t):
    rows = t("detail_rows")
    return s.striking_distance(_after(rows), curves=_fit(rows), days=AFTER_DAYS, normalize=False)


@query(
    "cannibalization",
    views=("search_rows",),
    sql=f"""WITH pg AS (SELECT country, query, page, {totals_sql()} FROM search_rows GROUP BY country, query, page),
q AS (SELECT *, CAST(sum(impressions) OVER (PARTITION BY country, query) AS BIGINT) AS query_impressions FROM pg),
c AS (SELECT * FROM q WHERE query_impressions >= 50 AND CAST(impressions AS DOUBLE) / query_impressions >= 0.1 AND avg_position <= 20),
r AS (SELECT *, row_number() OVER (PARTITION BY country, query ORDER BY avg_position, page) AS rank, count(*) OVER (PARTITION BY country, query) AS n FROM c),
t AS (SELECT country, query, CAST(sum(CASE WHEN rank > 1 THEN impressions ELSE 0 END) AS BIGINT) AS contested_impressions FROM r WHERE n >= 2 GROUP BY 1, 2)
SELECT country, query, query_impressions, contested_impressions, CAST(rank AS INT) AS rank, page, impressions, {rnd('CAST(impressions AS DOUBLE) / query_impressions * 100', 1)} AS share_pct, avg_position, clicks
FROM r JOIN t USING (country, query)""",
)
def cannibalization(t):
    found = s.cannibalization(t("search_rows"), segment_key="country", normalize=False)
    return s.cannibalization_urls(found, "country")


_PAGE_MOVES = movement_sql("detail_rows", "page", BEFORE, AFTER, BEFORE_DAYS, AFTER_DAYS)


def _page_moves(t):
    return s.period_movement(t("detail_rows"), BEFORE, AFTER, ["page"], normalize=False)


@query("page_movement", views=("detail_rows",), sql=f"WITH {_PAGE_MOVES} SELECT * FROM moves")
def page_movement(t):
    return _page_moves(t)


@query(
    "query_movement",
    views=("search_rows",),
    sql=f"WITH {movement_sql('search_rows', 'query, country', BEFORE, AFTER, BEFORE_DAYS, AFTER_DAYS)} SELECT * FROM moves",
)
def query_movement(t):
    return s.period_movement(t("search_rows"), BEFORE, AFTER, ["query", "country"])


@query("movement_summary", views=("detail_rows",), sql=f"WITH {_PAGE_MOVES} SELECT movement, count(*) AS n FROM moves GROUP BY movement")
def movement_summary(t):
    return s.movement_summary(_page_moves(t))


@query(
    "new_and_lost",
    views=("detail_rows",),
    sql=f"""WITH {movement_sql('detail_rows', 'page, country', BEFORE, AFTER, BEFORE_DAYS, AFTER_DAYS)},
r AS (SELECT *, coalesce(after_impressions, before_impressions) AS impressions FROM moves WHERE movement IN ('new', 'lost')),
n AS (SELECT *, row_number() OVER (PARTITION BY movement ORDER BY impressions DESC, page, country) AS rank FROM r)
SELECT movement, CAST(rank AS INT) AS rank, page, country, impressions FROM n WHERE rank <= 10""",
)
def new_and_lost(t):
    moves = s.period_movement(t("detail_rows"), BEFORE, AFTER, ["page", "country"], normalize=False)
    return s.new_and_lost(moves, ["page", "country"]).select("movement", "rank", "page", "country", "impressions")


also("new_and_lost_all_days", "new_and_lost")


_TESTED = "tested AS (SELECT * FROM moves WHERE movement NOT IN ('new', 'lost') AND greatest(before_clicks, after_clicks) >= 5)"


@query(
    "winners_decliners",
    views=("detail_rows",),
    sql=f"""WITH {_PAGE_MOVES}, {_TESTED}, kept AS ({keep_sql('tested', 'p_value', 0.1)}),
s AS (SELECT *, CASE WHEN clicks_delta > 0 THEN 'winning' ELSE 'declining' END AS side FROM kept WHERE clicks_delta <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY abs(clicks_delta) DESC, page) AS rank FROM s)
SELECT side, CAST(rank AS INT) AS rank, page, movement, before_clicks, after_clicks, clicks_delta, p_value FROM r WHERE rank <= 10""",
)
def winners_decliners(t):
    return s.winners_and_decliners(_page_moves(t), ["page"])


@query(
    "movement_tests",
    views=("detail_rows",),
    sql=f"WITH {_PAGE_MOVES}, {_TESTED}, kept AS ({keep_sql('tested', 'p_value', 0.1)}) SELECT (SELECT count(*) FROM tested) AS tested, (SELECT count(*) FROM kept) AS significant",
)
def movement_tests(t):
    return s.movement_test_counts(_page_moves(t))


_DECAY = f"""cand AS (SELECT * FROM (SELECT *, {rnd('clicks_delta / before_clicks * 100', 1)} AS clicks_change_pct FROM moves
 WHERE movement IN ('slipping', 'dropped', 'stable', 'improved') AND before_clicks >= 20) x WHERE clicks_change_pct <= -20),
decay AS (SELECT page, movement, before_clicks, after_clicks, clicks_delta, clicks_change_pct, p_value, {rnd(f'-clicks_delta * 28 / {BEFORE_DAYS}', 1)} AS estimated_click_loss_28d
 FROM ({keep_sql('cand', 'p_value', 0.1)}) k)"""


@query("content_decay", views=("detail_rows",), sql=f"WITH {_PAGE_MOVES}, {_DECAY} SELECT * FROM decay")
def content_decay(t):
    return s.content_decay(_page_moves(t), before_days=BEFORE_DAYS)


@query(
    "ranked_opportunities",
    views=("detail_rows",),
    sql=f"""WITH {_FIT}, {_NOW},
e AS (SELECT *, {rnd(_EXPECT, 2)} AS expected_ctr_pct FROM now_pairs WHERE impressions >= 500 AND avg_position BETWEEN 1 AND 15),
c AS (SELECT *, expected_ctr_pct / 100 AS r FROM e WHERE ctr_pct < expected_ctr_pct * CAST(0.5 AS DOUBLE)),
z AS (SELECT *, CASE WHEN r > 0 AND r < 1 THEN (clicks - impressions * r) / sqrt(impressions * r * (1.0 - r) * 2.0) END AS z FROM c),
p AS (SELECT *, coalesce({cdf_sql('z')}, 1.0) AS p FROM z), k AS ({keep_sql('p', 'p', 0.1)}), {_PAGE_MOVES}, {_DECAY}
SELECT 'ctr_opportunity' AS type, query || ' → ' || page AS subject, {rnd(f'impressions * (expected_ctr_pct - ctr_pct) / 100 * 28 / {AFTER_DAYS}', 1)} AS estimated_clicks_28d FROM k
UNION ALL SELECT 'content_decay', page, estimated_click_loss_28d FROM decay""",
)
def ranked_opportunities(t):
    return s.rank_opportunities(ctr_opportunities(t), content_decay(t))


@query(
    "overview_trend",
    views=("search_rows",),
    sql=f"""WITH w AS (SELECT m AS measure, CAST(sum(CASE WHEN date <= DATE '{BEFORE[1]}' THEN v END) AS BIGINT) AS before_total, CAST(sum(CASE WHEN date >= DATE '{AFTER[0]}' THEN v END) AS BIGINT) AS after_total
 FROM (SELECT date, 'clicks' AS m, clicks AS v FROM search_rows UNION ALL SELECT date, 'impressions', impressions FROM search_rows) x GROUP BY m),
d AS (SELECT *, CAST(before_total AS DOUBLE) / {BEFORE_DAYS} AS b, CAST(after_total AS DOUBLE) / {AFTER_DAYS} AS a FROM w)
SELECT measure, before_total, after_total, {rnd('b', 1)} AS before_per_day, {rnd('a', 1)} AS after_per_day, CASE WHEN b > 0 THEN {rnd('(a - b) / b * 100', 1)} END AS change_pct,
 CASE WHEN b > 0 THEN 'compared' WHEN a > 0 THEN 'new' ELSE 'no volume' END AS note FROM d""",
)
def overview_trend(t):
    return s.overview_trend(t("search_rows"), BEFORE, AFTER)


def _proxy_sql(window: tuple[str, str]) -> str:
    return f"""SELECT query AS keyword, country AS location, 'all' AS device, 'google' AS engine, {rnd('CAST(sum(s) AS DOUBLE) / CAST(sum(i) AS DOUBLE)', 1)} AS position,
 arg_max(page, (i, page)) AS url, CAST(sum(i) AS BIGINT) AS impressions
 FROM (SELECT query, country, page, sum(impressions) AS i, sum(position * impressions) AS s FROM search_rows WHERE date BETWEEN DATE '{window[0]}' AND DATE '{window[1]}' GROUP BY 1, 2, 3) x
 GROUP BY query, country HAVING sum(i) >= 30"""


@query("rank_proxy", views=("search_rows",), sql=f"WITH o AS ({_proxy_sql(AFTER)}) SELECT * FROM o ORDER BY impressions DESC, keyword, location LIMIT 100")
def rank_proxy(t):
    return s.rank_proxy(t("search_rows"), AFTER, normalize=False).drop("serp_features", "observed_at", "provider")


def _rank_pairs(t):
    rows = t("search_rows")
    features = F.array_compact(
        F.array(F.when(F.col("impressions") % 2 == 0, F.lit("people_also_ask")), F.when(F.col("impressions") % 3 == 0, F.lit("video")))
    )
    before, after = (
        s.rank_proxy(rows, window, top_queries=None, normalize=False)
        .withColumn("position", F.when(F.col("impressions") % 5 != low, F.floor(F.col("position") * F.col("impressions") % 37)))
        .withColumn("serp_features", features)
        for window, low in ((BEFORE, 0), (AFTER, 1))
    )
    return s.rank_changes(before, after)


def _rank_side(window: tuple[str, str], low: int) -> str:
    return f"""SELECT keyword, location, url, CASE WHEN impressions % 5 <> {low} THEN CAST(floor(position * impressions % 37) AS BIGINT) END AS position,
 impressions % 2 = 0 AS paa, impressions % 3 = 0 AS video FROM ({_proxy_sql(window)}) o"""


_RANKS = f"""WITH b AS ({_rank_side(BEFORE, 0)}), a AS ({_rank_side(AFTER, 1)}),
j AS (SELECT coalesce(a.keyword, b.keyword) AS keyword, coalesce(a.location, b.location) AS location, b.position AS previous_position, a.position AS current_position,
 b.keyword IS NOT NULL AS had, a.keyword IS NOT NULL AS has, b.url AS previous_url, a.url AS current_url, a.position - b.position AS d,
 coalesce(a.paa, false) AND NOT coalesce(b.paa, false) AS p_add, coalesce(a.video, false) AND NOT coalesce(b.video, false) AS v_add,
 coalesce(b.paa, false) AND NOT coalesce(a.paa, false) AS p_del, coalesce(b.video, false) AND NOT coalesce(a.video, false) AS v_del
 FROM b FULL JOIN a ON b.keyword = a.keyword AND b.location = a.location),
m AS (SELECT *, CASE WHEN NOT has THEN 'not_observed' WHEN previous_position IS NULL AND current_position IS NULL THEN 'not_ranking' WHEN previous_position IS NULL THEN 'new'
 WHEN current_position IS NULL THEN 'lost' WHEN d <= -5 THEN 'big_win' WHEN d >= 5 THEN 'dropped' WHEN d <= -1 THEN 'improved' WHEN d >= 1 THEN 'slipping' ELSE 'stable' END AS movement FROM j)
"""


@query(
    "rank_changes",
    views=("search_rows",),
    sql=_RANKS
    + """SELECT keyword, location, previous_position, current_position, movement, CASE WHEN has THEN CAST(d AS DOUBLE) END AS delta,
 coalesce(had AND has AND previous_url <> current_url, false) AS url_changed, coalesce(has AND (movement = 'lost' OR d >= 10), false) AS alert,
 CASE WHEN has THEN concat_ws('|', CASE WHEN p_add THEN 'people_also_ask' END, CASE WHEN v_add THEN 'video' END) END AS features_added,
 CASE WHEN has THEN concat_ws('|', CASE WHEN p_del THEN 'people_also_ask' END, CASE WHEN v_del THEN 'video' END) END AS features_removed FROM m""",
)
def rank_changes(t):
    joined = lambda name: F.array_join(name, "|").alias(name)
    return _rank_pairs(t).select(
        "keyword", "location", "previous_position", "current_position", "movement", "delta", "url_changed", "alert",
        joined("features_added"), joined("features_removed"),
    )


@query("rank_summary", views=("search_rows",), sql=_RANKS + "SELECT movement, count(*) AS n FROM m GROUP BY movement")
def rank_summary(t):
    return s.movement_summary(_rank_pairs(t))


also("rank_changes_all_days", "rank_changes")
also("rank_summary_all_days", "rank_summary")


@query(
    "recorded_findings",
    views=("detail_rows",),
    sql=f"""WITH {_PAGE_MOVES}, {_DECAY}, r AS (SELECT 'content_decay' AS type, 'decay:' || page AS dedupe_key, estimated_click_loss_28d AS gain FROM decay
UNION ALL SELECT 'page_' || movement, 'move:' || page, abs(coalesce(clicks_delta, 0)) FROM moves),
k AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY gain DESC NULLS LAST, dedupe_key) AS rank FROM r) SELECT type, dedupe_key, gain, CAST(rank AS INT) AS rank FROM k WHERE rank <= 10""",
)
def recorded_findings(t):
    from ..operators.ledger import cap_findings

    moves = _page_moves(t)
    decay = s.content_decay(moves, before_days=BEFORE_DAYS)
    moved = moves.select(
        F.concat(F.lit("page_"), "movement").alias("type"), F.concat(F.lit("move:"), "page").alias("dedupe_key"), F.abs(F.coalesce("clicks_delta", F.lit(0.0))).alias("gain")
    )
    fallen = decay.select(F.lit("content_decay").alias("type"), F.concat(F.lit("decay:"), "page").alias("dedupe_key"), F.col("estimated_click_loss_28d").alias("gain"))
    return cap_findings(fallen.unionByName(moved))


@query(
    "audit_summary",
    views=("detail_rows",),
    sql=f"""WITH {_FIT}, {_NOW}, e AS (SELECT *, {rnd(_EXPECT, 2)} AS expected_ctr_pct FROM now_pairs WHERE impressions >= 100 AND avg_position IS NOT NULL)
SELECT 'striking_distance' AS type, count(*) AS n FROM e WHERE avg_position BETWEEN 4 AND 15 UNION ALL SELECT 'pages_far', count(*) FROM e WHERE avg_position > 15 AND avg_position <= 30""",
)
def audit_summary(t):
    from ..plans.search_audit import search_audit

    found = search_audit(t("detail_rows"), BEFORE, AFTER)["striking_distance"]
    name = F.when(F.col("band") == "positions_4_15", "striking_distance").otherwise("pages_far")
    return found.groupBy(name.alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "top_pages_since",
    views=("search_rows",),
    sql="SELECT page, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions FROM search_rows WHERE date >= DATE '1998-01-01' GROUP BY page",
)
def top_pages_since(t):
    return s.top_pages_since(t("search_rows"), "1998-01-01")
