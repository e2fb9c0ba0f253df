"""The measurement job: requests in, one evidence row per request out.

Requests, metrics, sources and changes are tables, so one job answers any
number of comparisons. The facts are reduced once to daily parts per metric
and scope value; every later step reads those small parts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import quality_level, severity_rank
from ..functions.dates import days_inclusive, year_earlier
from ..functions.numbers import round_half_up
from ..functions.urls import page_key
from ..operators import confidence, control, quality
from ..operators.compare import compare_periods
from ..operators.metrics import (
    PARTS, daily_parts, daily_series, join_mappings, metric_parts, period_values, resolve_mappings, volume,
)
from ..operators.selection import select_slices, slice_index
from ..session import cut_lineage
from ..settings import SCOPE_DIMENSIONS

_MAPPING = ["aggregation", "scale", "kind"]


@dataclass
class Evidence:
    """Inputs of the measurement job."""

    snapshots: DataFrame
    facts: DataFrame
    metrics: DataFrame
    sources: DataFrame
    changes: DataFrame
    overrides: DataFrame | None = None
    slices: DataFrame | None = None
    time_zone: str = "UTC"
    prefixes: Sequence[str] = ()

    def slice_table(self) -> DataFrame:
        return self.slices if self.slices is not None else slice_index(self.facts)


def resolve_requests(requests: DataFrame, metrics: DataFrame, sources: DataFrame) -> DataFrame:
    """Requests with their metric (by id or alias), source and kind."""
    names = metrics.select(F.col("metric_id").alias("asked"), F.lit(0).alias("_p"), F.col("metric_id").alias("found")).unionByName(
        metrics.select(F.explode("aliases").alias("asked"), F.lit(1).alias("_p"), F.col("metric_id").alias("found"))
    )
    best = names.groupBy("asked").agg(F.min(F.struct("_p", "found")).alias("_b")).select("asked", F.col("_b.found").alias("found"))
    facts = metrics.select(
        "metric_id", "canonical_source", "fallback_sources", "min_sample", F.coalesce("overdispersion", F.lit(2.0)).alias("overdispersion"),
        F.coalesce("tolerance_pct", F.lit(5.0)).alias("tolerance_pct"), F.col("status").alias("metric_status"),
    )
    known = requests.withColumnRenamed("metric_id", "asked").join(best, "asked", "left")
    named = known.withColumn("metric_id", F.coalesce("found", "asked")).drop("asked", "found").join(facts, "metric_id", "left")
    cleaned = F.transform_values(
        F.coalesce("scope", F.create_map().cast("map<string,array<string>>")),
        lambda k, v: F.when(k == "page", F.transform(v, page_key)).otherwise(v),
    )
    placed = named.withColumns({"source_id": F.coalesce("source_id", "canonical_source"), "scope": cleaned})
    return placed.join(sources.select("source_id", "kind"), "source_id", "left")


def label_requests(requests: DataFrame, labels: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One row per request and window."""
    windows = F.array(*[F.struct(F.lit(n).alias("label"), s.alias("start"), e.alias("end")) for n, (s, e) in labels.items()])
    return requests.select("*", F.inline(windows))


def own_windows() -> dict[str, tuple[Column, Column]]:
    return {"before": (F.col("before_start"), F.col("before_end")), "after": (F.col("after_start"), F.col("after_end"))}


def year_windows() -> dict[str, tuple[Column, Column]]:
    return {f"ly_{n}": (year_earlier(s), year_earlier(e)) for n, (s, e) in own_windows().items()}


def _scope_keys(scope: Column) -> Column:
    return F.filter(F.map_keys(F.coalesce(scope, F.create_map().cast("map<string,array<string>>"))), lambda k: F.size(scope[k]) > 0)


def plan_selection(windows: DataFrame) -> DataFrame:
    """Dimension needs per request; property-level search reads try a headline-safe grain first."""
    required = _scope_keys(F.col("scope"))
    none = F.array().cast("array<string>")
    unsafe = F.array(F.lit("query"), F.lit("page"))
    unscoped = (F.col("kind") == "gsc_rows") & (F.size(required) == 0)
    attempts = F.when(
        unscoped,
        F.array(F.struct(F.lit(0).alias("attempt"), unsafe.alias("exclude")), F.struct(F.lit(1).alias("attempt"), none.alias("exclude"))),
    ).otherwise(F.array(F.struct(F.lit(0).alias("attempt"), none.alias("exclude"))))
    return windows.select(
        "request_id", "label", "source_id", "kind", F.col("start").alias("period_start"), F.col("end").alias("period_end"),
        required.alias("require"), F.inline(attempts),
    )


def measure(
    evidence: Evidence, windows: DataFrame, selected: DataFrame, scope_sets: Sequence[Sequence[str]] = ((), ("page",))
) -> DataFrame:
    """Daily parts per request and window.

    ``scope_sets`` lists the combinations of scope dimensions in use. For each
    one the facts are reduced to pull x day x series x segment x those
    dimensions first, and meet the requests through an equi-join.
    """
    mappings = resolve_mappings(evidence.metrics, evidence.overrides)
    mapped = join_mappings(evidence.facts, mappings)
    keyed = mapped.withColumns(
        {
            "_series": F.when(F.col("kind") == "timeseries", F.coalesce("series", F.lit(""))).otherwise(""),
            "_segment": F.coalesce("segment", F.lit("")),
        }
    )
    slices = selected.select("request_id", "label", "snapshot_id", F.col("date").alias("_day"), F.col("series").alias("_series"), F.col("segment").alias("_segment"))
    carried = ["request_id", "label", "metric_id", "scope", "before_days", "after_days", "overdispersion"]
    asked = windows.select(*carried)
    base = ["snapshot_id", "metric_id", *_MAPPING, "date", "_series", "_segment"]
    results = None
    for dims in scope_sets:
        names = [f"_d_{d}" for d in dims]
        reduced = keyed.withColumns({f"_d_{d}": F.col(d) for d in dims}) if dims else keyed
        parts = metric_parts(reduced, [*base, *names])
        wanted = F.array_sort(F.array(*[F.lit(d) for d in dims]) if dims else F.array().cast("array<string>"))
        chosen = asked.where(F.array_sort(_scope_keys(F.col("scope"))) == wanted)
        for d in dims:
            values = F.col("scope")[d]
            chosen = chosen.withColumn(f"_d_{d}", F.explode(F.array_distinct(values)))
        scoped = chosen.drop("scope").join(slices, ["request_id", "label"])
        dated = scoped.where("_day IS NOT NULL").withColumnRenamed("_day", "date")
        hit = dated.join(parts, ["snapshot_id", "metric_id", "date", "_series", "_segment", *names])
        undated = scoped.where("_day IS NULL").join(parts.where("date IS NULL"), ["snapshot_id", "metric_id", "_series", "_segment", *names])
        columns = ["request_id", "label", *_MAPPING, "before_days", "after_days", "overdispersion", "date", "_segment", *PARTS, "last"]
        both = hit.select(*columns).unionByName(undated.select(*columns))
        results = both if results is None else results.unionByName(both)
    keys = ["request_id", "label", *_MAPPING, "before_days", "after_days", "overdispersion"]
    return daily_parts(results, keys, "_segment")


def measure_issues(evidence: Evidence, requests: DataFrame, windows: DataFrame, selected: DataFrame, parts: DataFrame, now: Column) -> DataFrame:
    """Issue rows of every request: health, kind, coverage, rows, metric, sample, zone, breaks, tracking."""
    keys = ["request_id", "label"]
    issue = [*keys, *quality.ISSUE]
    health = windows.select(*keys, "source_id").join(quality.source_health(evidence.sources, now).select("source_id", "health"), "source_id", "left")
    from_health = quality.health_issues(health, keys)

    values = period_values(parts, [*keys, *_MAPPING])
    grain = selected.groupBy(*keys).agg(F.max("grain").alias("grain"), F.bool_or("expect_daily").alias("expect_daily"))
    facts = (
        windows.select(*keys, "kind", "scope", "start", "end", "min_sample", "metric_status", "source_id", "canonical_source")
        .withColumnRenamed("kind", "source_kind")
        .join(values.drop("kind"), keys, "left")
        .join(grain, keys, "left")
        .join(evidence.sources.select("source_id", "timezone", "data_through"), "source_id", "left")
    )
    c = F.col
    scope_keys = _scope_keys(c("scope"))
    dims = F.split(F.coalesce("grain", F.lit("")), ",")
    has_rows = c("grain").isNotNull()
    metric_kind = c("source_kind").isin("gsc_rows", "timeseries")
    narrow = F.arrays_overlap(scope_keys, F.array(F.lit("page"), F.lit("query")))
    length = days_inclusive(c("start"), c("end"))
    row_rules = [
        ("metric_unconfirmed", F.when(c("metric_status") == "proposed", "blocking"), F.lit("")),
        ("non_canonical_source", F.when(c("source_id") != c("canonical_source"), "minor"), c("source_id")),
        ("not_a_metric_source", quality.metric_source_issue(c("source_kind")), c("source_kind")),
        ("no_covering_snapshot", F.when(metric_kind & ~has_rows, "blocking"), F.lit("")),
        ("metric_absent", F.when(has_rows & c("value").isNull(), "blocking"), F.lit("")),
        ("missing_values", quality.missing_share_issue(c("missing_values"), c("row_count")), c("missing_values")),
        ("sample_too_small", F.when(has_rows, quality.sample_issue(c("sample"), c("min_sample"))), c("sample")),
        ("headline_unsafe", F.when(has_rows, quality.headline_issue(c("source_kind"), dims, narrow)), c("grain")),
        (
            "anonymized_queries_excluded",
            F.when(has_rows, quality.anonymized_issue(c("source_kind"), dims, narrow, F.array_contains(scope_keys, "query"))),
            c("grain"),
        ),
        ("timezone_mismatch", quality.timezone_issue(c("timezone"), F.lit(evidence.time_zone), length), c("timezone")),
        (
            "incomplete_period",
            F.when(has_rows, quality.incomplete_severity(c("data_through"), c("start"), c("end"))),
            F.datediff("end", "data_through"),
        ),
    ]
    from_rows = quality.issues_from(facts, keys, row_rules)

    days = parts.where("date IS NOT NULL").select(*keys, "date")
    spans = facts.where(has_rows & c("expect_daily")).select(*keys, "start", "end")
    gaps = quality.missing_date_issues(days, spans, keys).select(*issue)

    volumes = parts.where("date IS NOT NULL").select(*keys, "date", volume().alias("value")).where("value IS NOT NULL")
    boundary = quality.boundary_zero(volumes, ["request_id"])
    at_border = boundary.select(
        "request_id", F.lit("after").alias("label"), F.lit("sudden_zero").alias("code"), "severity", F.col("zero_days").cast("string").alias("detail")
    )
    sudden = quality.sudden_zero(volumes, keys).select(
        *keys, F.lit("sudden_zero").alias("code"), F.lit("major").alias("severity"), F.col("first_zero").cast("string").alias("detail")
    )
    # a break at the border replaces the after window's own finding
    inner = sudden.join(boundary.select("request_id", F.lit("after").alias("label")), keys, "left_anti")
    tracking = quality.tracking_changes(evidence.changes, windows.select(*keys, "start", "end"), keys)
    compare = quality.comparability(selected, evidence.snapshots).withColumn("label", F.lit("both"))
    frames = [from_health, from_rows, gaps, inner, at_border, tracking, compare]
    every = frames[0].select(*issue)
    for frame in frames[1:]:
        every = every.unionByName(frame.select(*issue))
    return quality.distinct_issues(every)


def row_fault_issues(
    evidence: Evidence, windows: DataFrame, selected: DataFrame, scope_sets: Sequence[Sequence[str]] = ((), ("page",))
) -> DataFrame:
    """Duplicate row keys and negative or non-finite values in the selected rows.

    Only the faulty groups leave the first aggregation, so the joins behind it are small.
    """
    keyed = evidence.facts.withColumns(
        {
            "_series": F.when(F.col("kind") == "timeseries", F.coalesce("series", F.lit(""))).otherwise(""),
            "_segment": F.coalesce("segment", F.lit("")),
        }
    )
    bad = F.lit(False)
    for name in ("clicks", "impressions", "position", "value"):
        number = F.col(name).cast("double")
        bad = bad | F.coalesce((number < 0) | F.isnan(number) | (F.abs(number) == float("inf")), F.lit(False))
    base = ["snapshot_id", "date", "_series", "_segment"]
    identity = [*base, *[d for d in SCOPE_DIMENSIONS if d != "segment"]]
    counted = keyed.groupBy(*identity).agg(F.count(F.lit(1)).alias("_n"), F.count_if(bad).alias("_bad"))
    faulty = counted.where((F.col("_n") > 1) | (F.col("_bad") > 0)).withColumn("segment", F.col("_segment"))
    slices = selected.select("request_id", "label", "snapshot_id", "date", F.col("series").alias("_series"), F.col("segment").alias("_segment"))
    results = None
    for dims in scope_sets:
        names = [f"_d_{d}" for d in dims]
        wanted = F.array_sort(F.array(*[F.lit(d) for d in dims]) if dims else F.array().cast("array<string>"))
        chosen = windows.select("request_id", "label", "scope").where(F.array_sort(_scope_keys(F.col("scope"))) == wanted)
        for d in dims:
            chosen = chosen.withColumn(f"_d_{d}", F.explode(F.array_distinct(F.col("scope")[d])))
        reduced = faulty.withColumns({f"_d_{d}": F.col(d) for d in dims}) if dims else faulty
        per = reduced.groupBy(*base, *names).agg(F.count_if(F.col("_n") > 1).alias("duplicates"), F.sum("_bad").alias("invalid"))
        hit = chosen.drop("scope").join(slices, ["request_id", "label"]).join(per, [*base, *names])
        hit = hit.select("request_id", "label", "duplicates", "invalid")
        results = hit if results is None else results.unionByName(hit)
    keys = ["request_id", "label"]
    summed = results.groupBy(*keys).agg(F.sum("duplicates").alias("duplicates"), F.sum("invalid").alias("invalid"))
    return quality.issues_from(
        summed,
        keys,
        [
            ("duplicate_rows", F.when(F.col("duplicates") > 0, F.lit("major")), F.col("duplicates")),
            ("invalid_values", F.when(F.col("invalid") > 0, F.lit("major")), F.col("invalid")),
        ],
    )


def source_agreement(evidence: Evidence, requests: DataFrame, parts: DataFrame, scope_sets) -> DataFrame | None:
    """Fallback sources of the same metric, measured over the same windows and scope; None without any."""
    fallbacks = requests.where(F.size(F.coalesce("fallback_sources", F.array().cast("array<string>"))) > 0)
    others = (
        fallbacks.withColumns({"_own": F.col("request_id"), "_source": F.explode("fallback_sources")})
        .withColumn("request_id", F.concat_ws("\u0001", "request_id", "_source"))
        .drop("source_id", "kind")
        .withColumnRenamed("_source", "source_id")
        .join(evidence.sources.select("source_id", "kind"), "source_id")
    )
    others = cut_lineage(others)
    if others.isEmpty():
        return None
    windows = _labelled(others, own_windows())
    selected = cut_lineage(select_slices(plan_selection(windows), evidence.snapshots, evidence.slice_table()))
    other = period_values(measure(evidence, windows, selected, scope_sets), ["request_id", "label", *_MAPPING])
    other = other.join(others.select("request_id", "_own", "source_id"), "request_id").select(
        F.col("_own").alias("request_id"), "label", "source_id", F.lit(False).alias("is_canonical"), "value"
    )
    own = period_values(parts, ["request_id", "label", *_MAPPING]).join(requests.select("request_id", "source_id"), "request_id")
    both = own.select("request_id", "label", "source_id", F.lit(True).alias("is_canonical"), "value").unionByName(other)
    limits = requests.select("request_id", "tolerance_pct")
    return quality.discrepancies(both.join(limits, "request_id"), ["request_id", "label", "tolerance_pct"], "tolerance_pct")


def _labelled(requests: DataFrame, labels: dict) -> DataFrame:
    lengths = {
        "before_days": days_inclusive(F.col("before_start"), F.col("before_end")),
        "after_days": days_inclusive(F.col("after_start"), F.col("after_end")),
    }
    return label_requests(requests.withColumns(lengths), labels)


def _control_requests(evidence: Evidence, requests: DataFrame) -> DataFrame:
    """Requests for the control pages of every page-scoped search request."""
    pages = F.col("scope")["page"]
    scoped = requests.where((F.col("kind") == "gsc_rows") & (F.size(pages) > 0) & (F.coalesce("control", F.lit("auto")) != "none"))
    given = F.size(F.coalesce("control_pages", F.array().cast("array<string>"))) > 0
    auto = scoped.where(~given).withColumn("pages", pages)
    # pages of the date x page grain only, latest pull per day
    paged = evidence.snapshots.where(
        F.array_contains("dimensions", "page") & F.array_contains("dimensions", "date") & ~F.array_contains("dimensions", "query")
    ).select("snapshot_id", "retrieved_at")
    # a page's day is the sum of its rows in the latest pull that has it
    pulled = evidence.facts.join(paged, "snapshot_id").groupBy("source_id", "page", "date", "retrieved_at", "snapshot_id").agg(F.sum("impressions").alias("impressions"))
    daily = pulled.groupBy("source_id", "page", "date").agg(F.max_by("impressions", F.struct("retrieved_at", "snapshot_id")).alias("impressions"))
    touched = evidence.changes.select(F.to_date("live_at").alias("date"), "pages")
    chosen = control.control_pages(daily, auto, touched, evidence.prefixes)
    listed = chosen.groupBy("request_id").agg(F.array_sort(F.collect_list("page")).alias("_control"))
    explicit = scoped.where(given).select("request_id", F.transform("control_pages", page_key).alias("_control"))
    found = listed.unionByName(explicit)
    swapped = F.map_concat(F.map_filter("scope", lambda k, v: k != "page"), F.create_map(F.lit("page"), F.col("_control")))
    return requests.join(found, "request_id").withColumn("scope", swapped).withColumn("control_count", F.size("_control")).drop("_control")


def analyze(
    evidence: Evidence,
    requests: DataFrame,
    now: Column,
    scope_sets: Sequence[Sequence[str]] = ((), ("page",)),
    with_control: bool = True,
    seasonality: bool = True,
    extra_issues: DataFrame | None = None,
    baselines: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Run the whole measurement.

    Returns ``evidence``, ``issues``, ``confounders``, ``discrepancies`` (None
    without fallback sources), ``changes``, ``shared_changes`` and ``selected``.
    """
    resolved = cut_lineage(resolve_requests(requests, evidence.metrics, evidence.sources))
    windows = _labelled(resolved, own_windows())
    # pages as keys, once
    keyed = evidence.facts.withColumn("page", page_key(F.col("page")))
    # the registry and the headers are read by many steps, and may be derived from much more than they hold
    touched = cut_lineage(evidence.changes.withColumn("pages", F.transform("pages", page_key)))
    headers = cut_lineage(evidence.snapshots)
    evidence = replace(evidence, snapshots=headers, facts=keyed, changes=touched, slices=cut_lineage(evidence.slice_table()))
    slices = evidence.slices
    # the slice index, the selection and the daily parts are small and read by every later step,
    # so they are written once and the plans behind them end there
    selected = cut_lineage(select_slices(plan_selection(windows), evidence.snapshots, slices))
    parts = cut_lineage(measure(evidence, windows, selected, scope_sets))
    compared = cut_lineage(compare_periods(parts, ["request_id"]))

    issues = measure_issues(evidence, resolved, windows, selected, parts, now)
    issues = issues.unionByName(row_fault_issues(evidence, windows, selected, scope_sets))
    issues = issues.unionByName(confidence.unknown_changes(evidence.changes, requests).select("request_id", F.lit("both").alias("label"), *quality.ISSUE))
    apart = source_agreement(evidence, resolved, parts, scope_sets)
    if apart is not None:
        apart = cut_lineage(apart)
        issues = issues.unionByName(
            apart.select("request_id", "label", F.lit("source_discrepancy").alias("code"), F.lit("major").alias("severity"), F.col("source_id").alias("detail"))
        )
    if baselines is not None:
        before = compared.select("request_id", "before_value").join(baselines.select("request_id", "baseline_id", F.col("value").alias("_v")), "request_id")
        drift = before.withColumn("_d", quality.baseline_drift(F.col("before_value"), F.col("_v")))
        restated = drift.select(
            "request_id", F.lit("before").alias("label"), F.lit("baseline_restated").alias("code"),
            quality.baseline_severity(F.col("_d")).alias("severity"), F.col("baseline_id").alias("detail"),
        ).where("severity IS NOT NULL")
        issues = issues.unionByName(restated)
    if extra_issues is not None:
        issues = issues.unionByName(extra_issues.select("request_id", "label", *quality.ISSUE))
    issues = cut_lineage(issues)
    worst = issues.groupBy("request_id").agg(F.max(severity_rank(F.col("severity"))).alias("_w"))

    graded = (
        resolved.join(compared, "request_id", "left")
        .join(worst, "request_id", "left")
        .withColumn("data_quality", quality_level(F.coalesce("_w", F.lit(0))))
    )
    withheld = F.col("data_quality") == "insufficient"
    graded = graded.withColumns({n: F.when(~withheld, F.col(n)) for n in ("delta_abs", "delta_pct")})

    asked = resolved.withColumn("scope_pages", F.col("scope")["page"])
    did = control_parts = None
    controls = cut_lineage(_control_requests(evidence, resolved)) if with_control else None
    if controls is not None and not controls.isEmpty():
        control_windows = _labelled(controls, own_windows())
        control_selected = cut_lineage(select_slices(plan_selection(control_windows), evidence.snapshots, slices))
        control_parts = cut_lineage(measure(evidence, control_windows, control_selected, scope_sets))
        did = cut_lineage(_difference(parts, control_parts, controls))
    if did is not None:
        graded = graded.join(did, "request_id", "left")
    else:
        nothing = {n: F.lit(None).cast(t) for n, t in _DID_COLUMNS.items()}
        graded = graded.withColumns(nothing)
    controlled = F.coalesce("did_usable", F.lit(False))
    strengthened = confidence.evidence_strength(
        graded.withColumn("_plain", F.col("statistic")).withColumn(
            "statistic", F.when(controlled, F.col("did_statistic")).otherwise(F.col("statistic"))
        )
    ).withColumn("controlled", controlled)

    shifts = _search_context(resolved, parts, control_parts)
    context = strengthened.join(shifts, "request_id", "left")
    earlier = _last_year(evidence, resolved, slices, parts, scope_sets) if seasonality else None
    if earlier is not None:
        context = context.join(earlier, "request_id", "left")
        context = context.withColumn("seasonal_checked", F.coalesce("checked", F.lit(False))).drop("checked")
    else:
        context = context.withColumns({"seasonal_checked": F.lit(False), "last_year_change_pct": F.lit(None).cast("double")})
    context = cut_lineage(context).withColumn("observed_change_pct", F.col("delta_pct"))
    plain = F.coalesce("context_refs", F.array().cast("array<string>"))
    skip_position, skip_demand = F.col("metric_id") == "avg_position", F.col("metric_id") == "organic_impressions"
    context = context.withColumns(
        {
            "context_refs": plain,
            "position_shift": F.when(~skip_position, F.col("position_shift")),
            "demand_shift_pct": F.when(~skip_demand, F.col("demand_shift_pct")),
        }
    )
    changes = evidence.changes.withColumn("live_date", F.to_date("live_at"))
    classified = cut_lineage(confidence.classify_changes(changes, asked))
    shared = confidence.shared_changes(changes, asked)
    confounders = confidence.change_confounders(classified, asked).unionByName(
        confidence.context_confounders(context.select(
            "request_id", "before_start", "before_end", "after_start", "after_end", "controlled", "position_shift", "demand_shift_pct",
            "seasonal_checked", "last_year_change_pct", "observed_change_pct", F.col("pre_trend_passed"), "context_refs",
        ))
    )
    counts = confidence.confounder_counts(confounders, confidence.shared_counts(shared, classified, asked))
    ceiling = confidence.design_ceiling(F.col("controlled"), F.col("pre_trend_passed"), F.col("did_statistic"))
    judged = confidence.causal_confidence(
        context.join(counts, "request_id", "left")
        .join(confidence.linked_timing(classified, asked), "request_id", "left")
        .withColumns(
            {
                "design_ceiling": ceiling,
                "design": F.when(F.col("controlled"), "difference_in_differences").otherwise(F.coalesce("design", F.lit("before_after"))),
            }
        )
    )
    final = judged.select(
        "request_id", "metric_id", "source_id", "before_start", "before_end", "after_start", "after_end", "basis", "aggregation",
        "before_days", "after_days", "before_value", "after_value", "before_sample", "after_sample", "delta_abs", "delta_pct", "method",
        F.col("_plain").alias("statistic"), "persistent", "data_quality", "evidence_strength", "strength_reasons", "causal_confidence",
        "causal_reason", "design", F.coalesce("control_count", F.lit(0)).alias("control_pages"), "did_effect", "did_statistic",
        "pre_trend_passed", "seasonal_checked", "last_year_change_pct", "position_shift", "demand_shift_pct",
        F.coalesce("confounder_count", F.lit(0)).alias("confounder_count"), F.coalesce("linked", F.lit(0)).alias("linked_changes"),
    )
    return {
        "evidence": final,
        "issues": issues,
        "confounders": confounders,
        "discrepancies": apart,
        "changes": classified,
        "shared_changes": shared,
        "selected": selected,
    }


_DID_COLUMNS = {
    "did_usable": "boolean", "did_effect": "double", "did_statistic": "double", "pre_trend_passed": "boolean", "control_count": "int",
}


def _difference(parts: DataFrame, control_parts: DataFrame, controls: DataFrame) -> DataFrame:
    """Difference-in-differences of requests with at least three control pages."""
    keys = ["request_id", "label", "aggregation"]
    treated = daily_series(parts, keys).withColumn("role", F.lit("treated"))
    other = daily_series(control_parts, keys).withColumn("role", F.lit("control"))
    enough = controls.where(F.col("control_count") >= 3).select("request_id", "control_count")
    both = treated.unionByName(other).join(enough.select("request_id"), "request_id", "left_semi")
    did = control.difference_in_differences(both, ["request_id"], F.col("aggregation") == "sum")
    return did.join(enough, "request_id").select(
        "request_id", F.col("usable").alias("did_usable"), F.col("effect").alias("did_effect"), F.col("statistic").alias("did_statistic"),
        "pre_trend_passed", "control_count",
    )


def _search_context(requests, parts, control_parts) -> DataFrame:
    """Position and demand shift of each search request, net of its control pages."""
    lengths = requests.where("kind = 'gsc_rows'").select(
        "request_id", days_inclusive(F.col("before_start"), F.col("before_end")).alias("before_days"),
        days_inclusive(F.col("after_start"), F.col("after_end")).alias("after_days"),
    )
    totals = lengths.join(_context_totals(parts, ""), "request_id")
    if control_parts is not None:
        totals = totals.join(_context_totals(control_parts, "control_"), "request_id", "left")
    return control.context_shift(totals, ["request_id"])


def _context_totals(parts: DataFrame, prefix: str) -> DataFrame:
    sides = [("before", F.col("label") == "before"), ("after", F.col("label") == "after")]
    summed = parts.groupBy("request_id").agg(
        *[
            F.sum(F.when(where, F.col(name))).alias(f"{side}_{name}")
            for side, where in sides
            for name in ("ctx_impressions", "ctx_weight", "ctx_sum")
        ]
    )
    return summed.select(
        "request_id",
        *[F.col(f"{side}_ctx_impressions").alias(f"{prefix}{side}_impressions") for side, _ in sides],
        *[
            F.when(F.col(f"{side}_ctx_weight") > 0, round_half_up(F.col(f"{side}_ctx_sum") / F.col(f"{side}_ctx_weight"), 2)).alias(
                f"{prefix}{side}_avg_position"
            )
            for side, _ in sides
        ],
    )


def _last_year(evidence, requests, slices, parts, scope_sets) -> DataFrame | None:
    """Change of the same windows a year earlier; None where no pull reaches back that far."""
    windows = _labelled(requests, year_windows())
    selected = cut_lineage(select_slices(plan_selection(windows), evidence.snapshots, slices))
    if selected.isEmpty():
        return None
    earlier = measure(evidence, windows, selected, scope_sets)
    keys = ["request_id", "label", *_MAPPING]
    values = period_values(parts, keys).unionByName(period_values(earlier, keys))
    bounds = windows.select("request_id", "label", "start", "end").unionByName(
        _labelled(requests, own_windows()).select("request_id", "label", "start", "end")
    )
    rows = values.select("request_id", "label", "aggregation", "value", F.col("distinct_dates").alias("dates")).join(bounds, ["request_id", "label"])
    checked = control.seasonal_check(rows.withColumn("_is_sum", F.col("aggregation") == "sum"), ["request_id"], F.col("_is_sum"))
    return checked.select("request_id", "checked", "last_year_change_pct")
