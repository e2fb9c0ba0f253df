"""Registry of named queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .tables import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, *, views: tuple[str, ...] = (), sql: str | None = None):
    """Register a query; ``sql`` is its counterpart over the same tables and views."""

    def register(function: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: function(Tables(spark, folder))
        if sql is not None:
            CHECKS[name] = with_views(sql, *views)
        return function

    return register


def also(name: str, query_name: str) -> None:
    """Keep an earlier name of a query."""
    QUERIES[name] = QUERIES[query_name]
    CHECKS[name] = CHECKS[query_name]


def rnd(expression: str, digits: int) -> str:
    """SQL for rounding half towards plus infinity."""
    factor = f"{float(10 ** digits)}"
    return f"(floor(CAST({expression} AS DOUBLE) * {factor} + 0.5) / {factor})"


def totals_sql(where: str | None = None, prefix: str = "") -> str:
    """SQL for the search totals of the rows that meet a condition."""
    flt = f" FILTER (WHERE {where})" if where else ""
    return (
        f"CAST(coalesce(sum(clicks){flt}, 0) AS BIGINT) AS {prefix}clicks, "
        f"CAST(coalesce(sum(impressions){flt}, 0) AS BIGINT) AS {prefix}impressions, "
        f"CASE WHEN sum(impressions){flt} > 0 THEN {rnd(f'CAST(sum(clicks){flt} AS DOUBLE) / CAST(sum(impressions){flt} AS DOUBLE) * 100', 3)} END AS {prefix}ctr_pct, "
        f"CASE WHEN sum(impressions){flt} > 0 THEN {rnd(f'CAST(sum(position * impressions){flt} AS DOUBLE) / CAST(sum(impressions){flt} AS DOUBLE)', 2)} END AS {prefix}avg_position"
    )


def cdf_sql(z: str) -> str:
    """SQL for the normal distribution function (approximation 7.1.26)."""
    x = f"(abs({z}) / 1.4142135623730951)"
    t = f"(1.0 / (1.0 + 0.3275911 * {x}))"
    poly = f"(((((1.061405429 * {t} + -1.453152027) * {t} + 1.421413741) * {t} + -0.284496736) * {t} + 0.254829592) * {t})"
    erf = f"(1.0 - {poly} * exp(-{x} * {x}))"
    return f"(CAST(0.5 AS DOUBLE) * (1.0 + CASE WHEN {z} < 0 THEN -{erf} ELSE {erf} END))"


def movement_sql(rows: str, dims: str, before: tuple[str, str], after: tuple[str, str], before_days: int, after_days: int) -> str:
    """SQL common table expressions ending in ``moves``: both windows joined, classed and tested."""
    keys = [d.strip() for d in dims.split(",")]
    on = " AND ".join(f"b.{k} IS NOT DISTINCT FROM a.{k}" for k in keys)
    chosen = ", ".join(f"coalesce(a.{k}, b.{k}) AS {k}" for k in keys)
    scale = f"(CAST({before_days} AS DOUBLE) / {after_days})" if before_days != after_days else "CAST(1 AS DOUBLE)"
    z = (
        f"((CAST(a.clicks AS DOUBLE) / {after_days} - CAST(b.clicks AS DOUBLE) / {before_days}) / nullif(sqrt(CAST(b.clicks AS DOUBLE) / ({before_days} * {before_days}) "
        f"+ CAST(a.clicks AS DOUBLE) / ({after_days} * {after_days})) * 1.4142135623730951, 0))"
    )
    return f"""
b AS (SELECT {dims}, {totals_sql()} FROM {rows} WHERE date BETWEEN DATE '{before[0]}' AND DATE '{before[1]}' GROUP BY {dims}),
a AS (SELECT {dims}, {totals_sql()} FROM {rows} WHERE date BETWEEN DATE '{after[0]}' AND DATE '{after[1]}' GROUP BY {dims}),
j AS (SELECT {chosen}, b.clicks AS before_clicks, b.impressions AS before_impressions, b.ctr_pct AS before_ctr_pct, b.avg_position AS before_avg_position,
 a.clicks AS after_clicks, a.impressions AS after_impressions, a.ctr_pct AS after_ctr_pct, a.avg_position AS after_avg_position,
 b.clicks IS NOT NULL AND a.clicks IS NOT NULL AS matched, coalesce({z}, 0) AS z, a.clicks * {scale} AS scaled, a.impressions * {scale} AS iscaled
 FROM b FULL JOIN a ON {on}),
d AS (SELECT *, CASE WHEN matched THEN {rnd('after_avg_position - before_avg_position', 2)} END AS position_delta,
 CASE WHEN matched THEN {rnd('after_ctr_pct - before_ctr_pct', 2)} END AS ctr_delta_pp FROM j),
moves AS (SELECT {dims}, CASE WHEN before_clicks IS NULL THEN 'new' WHEN after_clicks IS NULL THEN 'lost'
 WHEN position_delta <= -5 OR (before_clicks >= 2 AND scaled >= before_clicks * 2) THEN 'big_win'
 WHEN position_delta >= 5 OR (before_clicks >= 2 AND scaled <= CAST(before_clicks AS DOUBLE) / 2) THEN 'dropped'
 WHEN position_delta <= -1 OR ctr_delta_pp > 1 THEN 'improved' WHEN position_delta >= 1 THEN 'slipping' ELSE 'stable' END AS movement,
 before_clicks, before_impressions, before_ctr_pct, before_avg_position, after_clicks, after_impressions, after_ctr_pct, after_avg_position,
 CASE WHEN matched THEN {rnd(f"CAST(2.0 AS DOUBLE) * (1.0 - {cdf_sql('abs(z)')})", 6)} END AS p_value, position_delta,
 CASE WHEN matched THEN {rnd('scaled - before_clicks', 1)} END AS clicks_delta,
 CASE WHEN matched THEN {rnd('iscaled - before_impressions', 1)} END AS impressions_delta, ctr_delta_pp FROM d)"""


def keep_sql(source: str, p: str, q: float) -> str:
    """SQL that selects the rows of ``source`` that survive Benjamini-Hochberg (ranked form)."""
    return (
        f"SELECT * FROM {source} WHERE {p} <= (SELECT max(p) FROM (SELECT {p} AS p, rank() OVER (ORDER BY {p}) "
        f"+ count(*) OVER (PARTITION BY {p}) - 1 AS k, count(*) OVER () AS n FROM {source}) r WHERE p <= CAST(k AS DOUBLE) / n * {q})"
    )
