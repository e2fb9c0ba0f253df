"""Ordered rules that turn numbers and text into classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import CWV_CUTS, QUALITY_SCALE

# fixed values: index states, first match wins ("Soft 404" meets the 404 rule first)
INDEX_RULES = (
    (r"submitted and indexed|^indexed|indexed, not submitted|url is on google|^pass$", "indexed"),
    (r"crawled.*not indexed", "crawled_not_indexed"),
    (r"discovered.*not indexed", "discovered_not_indexed"),
    (r"noindex", "excluded_noindex"),
    (r"canonical", "canonical_mismatch"),
    (r"not found|404", "not_found"),
    (r"redirect", "redirect"),
    (r"robots", "blocked_robots"),
    (r"server error|5xx", "server_error"),
    (r"soft 404", "soft_404"),
    (r"^(unknown|neutral|)$", "unknown"),
)

# fixed values: change log wording, first match wins
CHANGE_RULES = (
    (r"track|analytics|ga4|gtm|pixel|consent", "tracking_change"),
    (r"redirect|canonical|hreflang|schema|robots|sitemap|noindex|index", "technical_seo_fix"),
    (r"pric|billing|checkout|plan", "pricing_change"),
    (r"new content|new post|new page|launch", "content_publish"),
    (r"meta|title|content|copy|link", "seo_content_update"),
    (r"deploy|release", "deployment"),
)

# fixed values: publication channel wording, first match wins
PUBLICATION_RULES = (
    (r"seo|meta|title", "seo_content_update"),
    (r"landing", "landing_page_change"),
    (r"blog|web|site|page|cms|article", "content_publish"),
)

# fixed values: engineering task wording, first match wins
TASK_RULES = (
    (r"track|analytics|ga4|gtm|pixel|event|attribution", "tracking_change"),
    (r"seo|canonical|sitemap|robots|schema|hreflang|meta|redirect|index", "technical_seo_fix"),
    (r"perf|speed|lcp|inp|cls|web vitals|cwv|cache", "performance_fix"),
    (r"pric|plan|checkout|billing", "pricing_change"),
    (r"landing", "landing_page_change"),
)


def first_match(text: Column, rules: tuple, fallback: Column | str) -> Column:
    """Class of the first pattern found in the text, case ignored."""
    lowered = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    result = None
    for pattern, name in rules:
        step = lowered.rlike(pattern)
        result = F.when(step, name) if result is None else result.when(step, name)
    return result.otherwise(fallback)


def index_verdict(text: Column) -> Column:
    return first_match(text, INDEX_RULES, F.lit("other"))


def change_type(text: Column, fallback: str = "other") -> Column:
    return first_match(text, CHANGE_RULES, F.lit(fallback))


def publication_type(text: Column) -> Column:
    return first_match(text, PUBLICATION_RULES, F.lit("campaign"))


def task_type(text: Column) -> Column:
    return first_match(text, TASK_RULES, F.lit("deployment"))


def movement(position_delta: Column, clicks_before: Column, clicks_after: Column, ctr_delta_pp: Column) -> Column:
    """big_win, dropped, improved, slipping or stable, tested in that order."""
    gain = -position_delta
    enough = clicks_before >= 2
    return (
        F.when((gain >= 5) | (enough & (clicks_after >= clicks_before * 2)), "big_win")
        .when((gain <= -5) | (enough & (clicks_after <= clicks_before / 2)), "dropped")
        .when((gain >= 1) | (ctr_delta_pp > 1), "improved")
        .when(gain <= -1, "slipping")
        .otherwise("stable")
    )


def cwv_class(metric: str, value: Column) -> Column:
    good, poor = CWV_CUTS[metric]
    return F.when(value.isNull(), "unknown").when(value <= good, "good").when(value <= poor, "needs_improvement").otherwise("poor")


def severity_rank(severity: Column) -> Column:
    """0 none or info, 1 minor, 2 major, 3 blocking."""
    return F.when(severity == "blocking", 3).when(severity == "major", 2).when(severity == "minor", 1).otherwise(0)


def quality_level(rank: Column) -> Column:
    """Data-quality level of the worst severity rank."""
    return F.element_at(F.array(*[F.lit(level) for level in QUALITY_SCALE]), rank + 1)
