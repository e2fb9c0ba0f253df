"""Thresholds, curves and word lists that decide results.

These are fixed values: results depend on them, so they are stated as they are.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# fixed values: heuristic click-through rate in percent by position
EXPECTED_CTR_CURVE = {
    1: 27, 2: 15, 3: 10, 4: 7, 5: 5.5, 6: 4.2, 7: 3.4, 8: 2.8, 9: 2.4, 10: 2.1,
    11: 1.6, 12: 1.4, 13: 1.2, 14: 1.1, 15: 1.0, 20: 0.6, 30: 0.3,
}

# fixed values: search thresholds
SEARCH_THRESHOLDS = {
    "quick_win_position_min": 4,
    "quick_win_position_max": 15,
    "striking_distance_min": 15,
    "striking_distance_max": 30,
    "min_impressions": 100,
    "high_impressions": 500,
    "ctr_gap_ratio": 0.5,
    "cannibalization_min_share": 0.1,
    "cannibalization_min_impressions": 50,
    "cannibalization_max_position": 20,
    "max_recorded_per_type": 10,
    "ranking_loss_alert": 10,
    "decline_pct": 20,
    "min_clicks_for_decline": 20,
}

# fixed values: page-speed cut points (good up to, poor above)
CWV_CUTS = {"lcp_p75_ms": (2500, 4000), "inp_p75_ms": (200, 500), "cls_p75": (0.1, 0.25)}

# fixed values: observation kinds; the first two may supply metric values
METRIC_KINDS = ("gsc_rows", "timeseries")
DIAGNOSTIC_KINDS = ("rankings", "crawl", "cwv", "indexation", "behavior")

# fixed values: change types that matter for search
SEARCH_CHANGE_TYPES = (
    "seo_content_update", "technical_seo_fix", "content_publish", "landing_page_change",
    "performance_fix", "schema_change", "tracking_change",
)

# fixed values: ordered scales
QUALITY_SCALE = ("high", "medium", "low", "insufficient")
STRENGTH_SCALE = ("insufficient", "low", "medium", "high")
CAUSAL_SCALE = ("none", "low", "medium", "high")

SCOPE_DIMENSIONS = ("page", "query", "country", "device", "segment")
AGGREGATIONS = ("sum", "ratio_of_sums", "weighted_mean", "mean", "last")


@dataclass(frozen=True)
class SearchSettings:
    """Thresholds with a project's overrides; the curve is replaced as a whole."""

    thresholds: dict = field(default_factory=dict)
    curve: dict = field(default_factory=lambda: dict(EXPECTED_CTR_CURVE))
    segments: tuple = ()

    def __getitem__(self, name: str):
        return self.thresholds.get(name, SEARCH_THRESHOLDS[name])


DEFAULT_SETTINGS = SearchSettings()
