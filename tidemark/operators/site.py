"""Crawl, page-speed, indexation and behaviour findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import cwv_class
from ..functions.numbers import round_half_up
from ..functions.urls import page_key
from ..plans.skew import lookup_join
from ..settings import CWV_CUTS


def duplicate_groups(rows: DataFrame, text: str, code: str) -> DataFrame:
    """Members of every group of urls that share a text, case and outer blanks ignored.

    ``group_key`` and ``group_size`` identify the group; the member list is
    the rows of the key, so a text shared by very many urls stays distributed.
    """
    keyed = rows.where((F.col("status") == 200) & (F.col(text) != "")).select("url", F.lower(F.trim(text)).alias("group_key"))
    counts = keyed.groupBy("group_key").agg(F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    found = lookup_join(keyed, counts, ["group_key"], weight="group_size", how="inner")
    return found.select(F.lit(code).alias("code"), "url", F.col("group_size").cast("string").alias("detail"), "group_key")


def technical_findings(crawl: DataFrame) -> DataFrame:
    """All crawl findings: one row per url and code, with a detail."""
    c = F.col
    ok, key = c("status") == 200, page_key(c("url"))
    canonical = page_key(c("canonical"))
    mismatch = ok & (c("canonical") != "") & (canonical != key)
    noindex = F.lower("robots").contains("noindex") & c("in_sitemap")
    rules: Sequence[tuple[str, Column, Column]] = (
        ("server_error", c("status") >= 500, c("status")),
        ("client_error", c("status").between(400, 499), c("status")),
        ("redirect_chain", c("status").between(300, 399) & (F.coalesce("redirect_hops", F.lit(0)) > 1), c("redirect_hops")),
        ("missing_title", ok & (F.coalesce("title", F.lit("")) == ""), F.lit("")),
        ("missing_meta_description", ok & (F.coalesce("meta_description", F.lit("")) == ""), F.lit("")),
        ("noindex_in_sitemap", noindex, F.lit("")),
        ("non_200_in_sitemap", ~ok & c("in_sitemap"), c("status")),
        ("orphan_page", ok & (c("inlinks") == 0), F.lit("")),
        ("structured_data_errors", c("structured_data_errors") > 0, c("structured_data_errors")),
    )
    entries = [F.when(where, F.struct(F.lit(code).alias("code"), detail.cast("string").alias("detail"))) for code, where, detail in rules]
    plain = crawl.select("url", F.inline(F.array_compact(F.array(*entries)))).select("code", "url", "detail")
    # the canonical's own status, looked up by page key; of repeated urls the greatest status counts
    pointing = crawl.where(mismatch).select("url", canonical.alias("target"), "canonical")
    statuses = crawl.groupBy(key.alias("target")).agg(F.max("status").alias("target_status"))
    aimed = lookup_join(pointing, statuses, ["target"])
    detail = F.when(F.col("target_status") != 200, F.concat_ws(" ", "canonical", F.col("target_status").cast("string"))).otherwise(F.col("canonical"))
    wrong = aimed.select(F.lit("canonical_mismatch").alias("code"), "url", detail.alias("detail"))
    titles = duplicate_groups(crawl, "title", "duplicate_title").drop("group_key")
    texts = duplicate_groups(crawl, "meta_description", "duplicate_meta_description").drop("group_key")
    return plain.unionByName(wrong).unionByName(titles).unionByName(texts)


def count_by(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def cwv_findings(current: DataFrame, previous: DataFrame) -> DataFrame:
    """One row per page, form factor and metric: class, earlier class and whether it regressed.

    A regression is a worse class, or 20 percent or more slower.
    """
    metrics = list(CWV_CUTS)
    keys = [page_key(F.col("url")).alias("page"), "form_factor"]
    entries = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), cwv_class(m, F.col(m)).alias("status")) for m in metrics]
    )
    now = current.select("url", *keys, F.inline(entries))
    old = previous.select(*keys, F.inline(entries)).groupBy("page", "form_factor", "metric").agg(
        F.max("value").alias("previous"), F.max_by("status", "value").alias("previous_status")
    )
    joined = now.join(old, ["page", "form_factor", "metric"], "left")
    rank = lambda c: F.when(c == "poor", 2).when(c == "needs_improvement", 1).when(c == "good", 0).otherwise(-1)
    slower = F.when(F.col("previous") == 0, F.lit(0.0)).otherwise((F.col("value") - F.col("previous")) / F.when(F.col("previous") != 0, F.col("previous")) * 100)
    comparable = F.col("previous").isNotNull() & F.col("value").isNotNull()
    worse = comparable & ((rank(F.col("status")) > rank(F.col("previous_status"))) | (slower >= 20))
    return joined.select(
        "url", "form_factor", "metric", "value", "status", "previous", "previous_status",
        F.when(comparable, round_half_up(slower, 1)).alias("change_pct"), worse.alias("regressed"),
    )


def indexation_findings(rows: DataFrame) -> DataFrame:
    """Urls that are not indexed, whose canonical differs, or whose state cannot be proven."""
    verdict = F.col("verdict")
    differs = (F.col("google_canonical") != "") & (F.col("user_canonical") != "") & (
        page_key(F.col("google_canonical")) != page_key(F.col("user_canonical"))
    )
    kinds = F.array_compact(
        F.array(
            F.when(~verdict.isin("indexed", "unknown", "other", "redirect"), F.lit("not_indexed")),
            F.when(differs, F.lit("canonical_mismatch")),
            F.when(verdict.isin("unknown", "other"), F.lit("cannot_prove")),
        )
    )
    return rows.select("url", "verdict", F.explode(kinds).alias("finding"))


def behavior_context(behavior: DataFrame, pages: DataFrame) -> DataFrame:
    """Session-weighted behaviour of flagged pages; pages without any are listed as missing."""
    fields = ("dead_click_pct", "rage_click_pct", "quickback_pct", "scroll_depth_pct")
    sessions = F.coalesce("sessions", F.lit(0))

    def weighted(name: str) -> Column:
        held = F.when(F.col(name).isNotNull(), sessions)
        mean = F.when(F.sum(held) > 0, F.sum(F.col(name) * held) / F.sum(held)).otherwise(F.avg(name))
        return round_half_up(mean, 1).alias(name)

    summed = behavior.groupBy(page_key(F.col("url")).alias("page")).agg(F.sum(sessions).alias("sessions"), *[weighted(n) for n in fields])
    return pages.select("page").distinct().join(summed, "page", "left").withColumn("missing", F.col("sessions").isNull())
