"""Search audit: all findings of one property, from selected rows to ledger rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import search
from ..operators.ledger import cap_findings
from ..session import cut_lineage
from ..settings import DEFAULT_SETTINGS, SearchSettings

_FINDING = ("type", "dedupe_key", "query", "page", "gain", "severity", "owner")


def search_audit(
    rows: DataFrame, before: tuple[str, str], after: tuple[str, str], settings: SearchSettings = DEFAULT_SETTINGS, segment_key: str | None = None
) -> dict[str, DataFrame]:
    """Curve, opportunities, striking distance, cannibalization, movement, decay and ranking of dated query and page rows.

    The rows of both windows are reduced once to day-free sums per window,
    query, page and country; every branch reads that small table.
    """
    day = F.col("date")
    in_before, in_after = (day.between(*[F.lit(d).cast("date") for d in w]) for w in (before, after))
    named = search.with_dimensions(rows.where(in_before | in_after), ["query", "page"])
    segment = [segment_key] if segment_key else []
    amount = F.col("impressions")
    placed = F.when(F.col("position").isNotNull(), F.coalesce(amount, F.lit(0)))
    summed = named.groupBy(in_after.alias("_after"), *segment, "query", "page").agg(
        F.sum("clicks").alias("clicks"), F.sum(amount).alias("impressions"), F.sum(placed).alias("_w"), F.sum(F.col("position") * placed).alias("_s")
    )
    mean = F.when(F.col("_w") > 0, F.col("_s").cast("double") / F.col("_w").cast("double"))
    base = cut_lineage(summed.withColumn("position", mean).drop("_w", "_s"))
    old, new = base.where("NOT _after"), base.where("_after")
    curve = cut_lineage(search.fit_ctr_curve(base, settings, normalize=False))
    page_moves = cut_lineage(search.snapshot_movement(old, new, ["page"], search.window_days(before), search.window_days(after), normalize=False))
    query_moves = cut_lineage(search.snapshot_movement(old, new, ["query"], search.window_days(before), search.window_days(after), normalize=False))
    opportunities = search.ctr_opportunities(new, settings, curves=curve, days=search.window_days(after), normalize=False)
    decay = search.content_decay(page_moves, ["page"], settings, search.window_days(before))
    return {
        "curve": curve,
        "ctr_opportunities": opportunities,
        "striking_distance": search.striking_distance(new, settings, curves=curve, days=search.window_days(after), normalize=False),
        "cannibalization": search.cannibalization(new, settings, segment_key, normalize=False),
        "query_movement": query_moves,
        "page_movement": page_moves,
        "query_winners": search.winners_and_decliners(query_moves, ["query"]),
        "page_winners": search.winners_and_decliners(page_moves, ["page"]),
        "content_decay": decay,
        "ranked": search.rank_opportunities(opportunities, decay),
    }


def _finding(rows: DataFrame, type_: str, key: Column, gain: Column, owner: str, severity: Column | None = None) -> DataFrame:
    held = set(rows.columns)
    text = lambda n: (F.col(n) if n in held else F.lit(None)).cast("string").alias(n)
    level = severity if severity is not None else F.lit(None).cast("string")
    return rows.select(
        F.lit(type_).alias("type"), key.alias("dedupe_key"), text("query"), text("page"), gain.cast("double").alias("gain"), level.alias("severity"), F.lit(owner).alias("owner")
    )


def finding_rows(
    audit: dict[str, DataFrame],
    technical: DataFrame | None = None,
    indexation: DataFrame | None = None,
    ranks: DataFrame | None = None,
    speed: DataFrame | None = None,
) -> DataFrame:
    """All findings as ledger rows: type, key, subject, estimated gain, severity and owner."""
    c = F.col
    key = lambda *parts: F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    near = audit["striking_distance"].where("band = 'positions_4_15'")
    rows = [
        _finding(audit["ctr_opportunities"], "ctr_opportunity", key("ctr", c("query"), c("page")), c("estimated_click_gain_28d"), "marketing"),
        _finding(audit["cannibalization"], "cannibalization", key("cannibalization", c("query")), c("contested_impressions"), "marketing"),
        _finding(near, "striking_distance", key("striking", c("query"), c("page")), c("upside_if_top3_28d"), "marketing"),
        _finding(audit["content_decay"], "content_decay", key("decay", c("page")), c("estimated_click_loss_28d"), "marketing"),
    ]
    none = F.lit(None).cast("double")
    if technical is not None:
        kept = technical.where(~c("code").isin("duplicate_meta_description", "missing_meta_description")).withColumn("page", c("url"))
        rows.append(_finding(kept, "technical", key("technical", c("code"), c("url")), none, "engineering"))
    if indexation is not None:
        kept = indexation.where("finding = 'not_indexed'").withColumn("page", c("url"))
        rows.append(_finding(kept, "indexation", key("indexation", c("url"), c("verdict")), none, "engineering"))
    if ranks is not None:
        kept = ranks.where("alert").withColumn("query", c("keyword"))
        rows.append(_finding(kept, "ranking_loss", key("ranking", c("keyword"), c("location"), c("device"), c("engine")), c("delta"), "marketing", F.lit("medium")))
    if speed is not None:
        kept = speed.where("regressed").withColumn("page", c("url"))
        level = F.when(c("status") == "poor", "high").otherwise("medium")
        rows.append(_finding(kept, "cwv_regression", key("cwv", c("url"), c("form_factor"), c("metric")), c("change_pct"), "engineering", level))
    every = rows[0]
    for frame in rows[1:]:
        every = every.unionByName(frame)
    return every.select(*_FINDING)


def flagged_pages(audit: dict[str, DataFrame], top_pages: DataFrame) -> DataFrame:
    """Pages the audit points at, for the behaviour context."""
    pages = [top_pages.select("page"), audit["ctr_opportunities"].select("page"), audit["content_decay"].select("page")]
    return pages[0].unionByName(pages[1]).unionByName(pages[2]).where("page IS NOT NULL").distinct()


def recordable(findings: DataFrame, settings: SearchSettings = DEFAULT_SETTINGS) -> DataFrame:
    """Findings for the ledger: the anomaly kinds in full, the others capped per type."""
    anomalies = findings.where(F.col("type").isin("ranking_loss", "cwv_regression")).withColumn("rank", F.lit(None).cast("int"))
    rest = cap_findings(findings.where(~F.col("type").isin("ranking_loss", "cwv_regression")), settings)
    return rest.unionByName(anomalies)


