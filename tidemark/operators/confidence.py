"""Evidence strength, confounders and causal confidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import days_inclusive
from ..settings import CAUSAL_SCALE, STRENGTH_SCALE
from .selection import resolve_chains


def _name(rank: Column, scale: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(level) for level in scale]), (rank + 1).cast("int"))


def _rank(level: Column, scale: Sequence[str]) -> Column:
    return F.array_position(F.array(*[F.lit(name) for name in scale]), level) - 1


def evidence_strength(compared: DataFrame, quality: str = "data_quality", minimum: str = "min_sample") -> DataFrame:
    """Add ``evidence_strength`` and ``strength_reasons``; every cap that applied is listed.

    Reads the columns of a comparison plus data quality and minimum sample.
    """
    c = F.col
    short = F.least("before_days", "after_days")
    magnitude = F.abs("statistic")
    start = F.when(magnitude.isNull(), F.when(F.abs(F.coalesce("delta_pct", F.lit(0.0))) >= 20, 2).otherwise(1)).otherwise(
        F.when(magnitude >= 3, 3).when(magnitude >= 2, 2).otherwise(1)
    )
    small = (c(minimum) > 0) & ((F.coalesce("before_sample", F.lit(0.0)) < c(minimum)) | (F.coalesce("after_sample", F.lit(0.0)) < c(minimum)))
    none = F.when(c(quality) == "insufficient", "data quality is insufficient").when(
        c("before_value").isNull() | c("after_value").isNull(), "a period has no value"
    ).when(small, "sample below the metric minimum")
    persistent = F.coalesce("persistent", F.lit(False))
    caps = (
        (c(quality) == "medium", 2, "data quality medium caps strength at medium"),
        (c(quality) == "low", 1, "data quality low caps strength at low"),
        (short < 7, 1, "a window under 7 days caps strength at low"),
        ((short >= 7) & (short < 14), 2, "a window under 14 days caps strength at medium"),
        (~c("persistence_checked"), 2, "persistence not checkable; capped at medium"),
        (c("persistence_checked") & ~persistent, 1, "the change does not persist across both halves"),
        (c("delta_abs") == 0, 1, "no change observed"),
    )
    rank = F.least(start, *[F.when(where, limit).otherwise(3) for where, limit, _ in caps])
    basis = F.when(magnitude.isNull(), "no variance estimate; judged by effect size alone").otherwise("shift in standard errors")
    reasons = F.array_compact(F.array(basis, *[F.when(where, F.lit(text)) for where, _, text in caps]))
    return compared.withColumns(
        {
            "evidence_strength": _name(F.when(none.isNotNull(), 0).otherwise(rank), STRENGTH_SCALE),
            "strength_reasons": F.when(none.isNotNull(), F.array(none)).otherwise(reasons),
        }
    )


# ---- changes ---------------------------------------------------------------


_CARRIED = ("change_id", "type", "live_date", "known_scope", "confirmed")


def _live(changes: DataFrame) -> DataFrame:
    """Changes that are neither superseded nor pending, with whether their scope is known."""
    replaced = changes.select(F.col("supersedes").alias("change_id")).where(F.col("change_id").isNotNull()).distinct()
    known = F.size(F.coalesce("pages", F.array().cast("array<string>"))) > 0
    live = changes.join(replaced, "change_id", "left_anti").where(F.col("deploy_status") != "pending")
    return live.withColumn("known_scope", known)


def _site_wide() -> Column:
    return F.size(F.coalesce("scope_pages", F.array().cast("array<string>"))) == 0


def classify_changes(changes: DataFrame, requests: DataFrame) -> DataFrame:
    """The changes that belong to one request: linked, or overlapping or unplaced on its pages.

    ``changes``: change_id, type, deploy_status, live_date, pages, experiment_id,
    confirmed, supersedes. ``requests``: request_id, window dates, scope_pages
    (NULL or empty for the whole property), change_ids, experiment_id.

    A linked change that was superseded counts as its newest successor. Scopes
    meet changes through an equi-join on the page. Changes that touch every
    request of a span are listed once, by :func:`shared_changes`.
    """
    live = _live(changes)
    named = requests.select("request_id", F.explode("change_ids").alias("change_id"))
    current = resolve_chains(changes, "change_id")
    followed = named.join(current, "change_id").select("request_id", F.col("current_id").alias("change_id"))
    by_id = followed.join(live.select(*_CARRIED), "change_id")
    by_experiment = requests.select("request_id", "experiment_id").where("experiment_id IS NOT NULL").join(
        live.where("experiment_id IS NOT NULL").select(*_CARRIED, "experiment_id"), "experiment_id"
    )
    linked = by_id.unionByName(by_experiment.drop("experiment_id")).dropDuplicates(["request_id", "change_id"])
    pages = requests.select("request_id", "before_start", "after_end", F.explode("scope_pages").alias("page")).distinct()
    touched = live.where("known_scope").select(*_CARRIED, F.explode("pages").alias("page"))
    inside = F.col("live_date").isNull() | F.col("live_date").between(F.col("before_start"), F.col("after_end"))
    scoped = pages.join(touched, "page").where(inside).select("request_id", *_CARRIED).dropDuplicates(["request_id", "change_id"])
    rest = scoped.join(linked.select("request_id", "change_id"), ["request_id", "change_id"], "left_anti")
    relation = F.when(F.col("live_date").isNull(), "unplaced").otherwise("overlapping")
    return (
        linked.withColumn("relation", F.lit("linked"))
        .unionByName(rest.withColumn("relation", relation))
        .select("request_id", "change_id", "relation", *_CARRIED[1:])
    )


def unknown_changes(changes: DataFrame, requests: DataFrame) -> DataFrame:
    """Blocking issues for linked change ids that the registry does not hold."""
    named = requests.select("request_id", F.explode("change_ids").alias("change_id"))
    lost = named.join(changes.select("change_id").distinct(), "change_id", "left_anti").distinct()
    return lost.select("request_id", F.lit("unknown_change").alias("code"), F.lit("blocking").alias("severity"), F.col("change_id").cast("string").alias("detail"))


def shared_changes(changes: DataFrame, requests: DataFrame) -> DataFrame:
    """Changes that touch every request of a span, once per distinct span.

    Unknown scope touches all requests; a known scope (``site_only``) touches
    those without page scope. Unplaced changes belong to no span and are
    listed once, with NULL bounds. A span meets the changes by day.
    """
    live = _live(changes).select(*_CARRIED).withColumn("site_only", F.col("known_scope"))
    spans = requests.select("before_start", "after_end").distinct()
    days = spans.select("before_start", "after_end", F.explode(F.sequence("before_start", "after_end")).alias("live_date"))
    placed = days.join(live, "live_date").withColumn("relation", F.lit("overlapping"))
    loose = live.where("live_date IS NULL").withColumns(
        {"before_start": F.lit(None).cast("date"), "after_end": F.lit(None).cast("date"), "relation": F.lit("unplaced")}
    )
    return placed.unionByName(loose)


def shared_counts(shared: DataFrame, classified: DataFrame, requests: DataFrame) -> DataFrame:
    """Major and minor confounders per request that come from shared changes.

    A request's own linked changes are taken off again. On a scoped request
    the known-scope changes do not count here: its pages list them.
    """
    tracking = F.col("type") == "tracking_change"
    major = (F.col("relation") == "overlapping") & (tracking | F.col("known_scope"))
    counted = [
        F.count_if(major & ~F.col("site_only")).alias("major_all"),
        F.count_if(~major & ~F.col("site_only")).alias("minor_all"),
        F.count_if(major & F.col("site_only")).alias("major_site"),
        F.count_if(~major & F.col("site_only")).alias("minor_site"),
    ]
    names = ["major_all", "minor_all", "major_site", "minor_site"]
    spans = shared.where("relation = 'overlapping'").groupBy("before_start", "after_end").agg(*counted)
    loose = shared.where("relation = 'unplaced'").agg(*[c.alias("loose_" + n) for c, n in zip(counted, names)])
    asked = requests.select("request_id", "before_start", "after_end", _site_wide().alias("site_wide"))
    own = classified.where("relation = 'linked'").join(asked, "request_id")
    day = F.col("live_date")
    hits = day.isNull() | day.between(F.col("before_start"), F.col("after_end"))
    applies = hits & (F.col("site_wide") | ~F.col("known_scope"))
    own_major = applies & day.isNotNull() & (tracking | F.col("known_scope"))
    taken = own.groupBy("request_id").agg(F.count_if(own_major).alias("_tm"), F.count_if(applies & ~own_major).alias("_tn"))
    # the loose counts are one row by construction
    joined = (
        asked.join(spans, ["before_start", "after_end"], "left")
        .join(taken, "request_id", "left")
        .join(F.broadcast(loose), F.col("request_id").isNotNull(), "left")
        .fillna(0, [*names, *["loose_" + n for n in names], "_tm", "_tn"])
    )

    def total(kind: str) -> Column:
        every = F.col(f"{kind}_all") + F.col(f"loose_{kind}_all")
        site = F.when(F.col("site_wide"), F.col(f"{kind}_site") + F.col(f"loose_{kind}_site")).otherwise(0)
        return every + site

    return joined.select(
        "request_id", (total("major") - F.col("_tm")).alias("shared_majors"), (total("minor") - F.col("_tn")).alias("shared_minors")
    )


def change_confounders(classified: DataFrame, requests: DataFrame) -> DataFrame:
    """Confounder rows that come from changes."""
    windows = requests.select("request_id", "before_start", "before_end", "after_start", "after_end")
    joined = classified.join(windows, "request_id")
    c = F.col
    day, tracking = c("live_date"), c("type") == "tracking_change"
    overlap = F.struct(
        F.when(tracking | c("known_scope"), "major").otherwise("minor").alias("severity"),
        F.when(tracking, "tracking_change").when(c("known_scope"), "overlapping_change").otherwise("possible_overlapping_change").alias("code"),
    )
    unplaced = F.struct(F.lit("minor").alias("severity"), F.lit("unplaced_change").alias("code"))
    unconfirmed = F.struct(F.lit("minor").alias("severity"), F.lit("unconfirmed_change").alias("code"))
    in_before = day.between(c("before_start"), c("before_end"))
    in_after = (day > c("after_start")) & (day <= c("after_end"))
    tail = days_inclusive(day, c("before_end")) / days_inclusive(c("before_start"), c("before_end"))
    head = days_inclusive(c("after_start"), day) / days_inclusive(c("after_start"), c("after_end"))
    baseline = F.struct(
        F.when(tail <= 0.05, "info").when(tail <= 0.25, "minor").otherwise("major").alias("severity"),
        F.lit("linked_change_in_baseline").alias("code"),
    )
    middle = F.struct(F.when(head <= 0.05, "info").otherwise("minor").alias("severity"), F.lit("linked_change_mid_window").alias("code"))
    linked = c("relation") == "linked"
    entries = F.array_compact(
        F.array(
            F.when(c("relation") == "overlapping", overlap),
            F.when(c("relation") == "unplaced", unplaced),
            F.when(linked & (c("confirmed") == F.lit(False)), unconfirmed),
            F.when(linked & in_before, baseline),
            F.when(linked & in_after & ~F.coalesce(in_before, F.lit(False)), middle),
        )
    )
    return joined.select("request_id", F.col("change_id").cast("string").alias("ref"), F.inline(entries))


def context_confounders(context: DataFrame) -> DataFrame:
    """Confounder rows from shifts, weekday mix, seasonality, trends and recorded context.

    ``context`` has one row per request: window dates, ``controlled``,
    position_shift, demand_shift_pct, seasonal_checked, last_year_change_pct,
    observed_change_pct, pre_trend_passed, context_refs.
    """
    c = F.col
    before_days = days_inclusive(c("before_start"), c("before_end"))
    after_days = days_inclusive(c("after_start"), c("after_end"))
    shift, demand = F.abs("position_shift"), F.abs("demand_shift_pct")
    uneven = (before_days != after_days) | (before_days % 7 != 0)
    ly, seen = c("last_year_change_pct"), c("observed_change_pct")
    seasonal = c("seasonal_checked") & ly.isNotNull() & seen.isNotNull()
    explains = (F.signum(ly) == F.signum(seen)) & (F.abs(ly) >= 0.5 * F.abs(seen))
    season_severity = F.when(c("controlled"), "info").when(explains, "major").when(F.abs(ly) >= 10, "minor").otherwise("info")
    season_code = F.when(c("controlled") | explains | (F.abs(ly) >= 10), "seasonal_pattern").otherwise("seasonality_checked")

    def entry(where: Column, severity: Column, code: Column) -> Column:
        return F.when(where, F.struct(severity.alias("severity"), code.alias("code")))

    entries = F.array_compact(
        F.array(
            entry(shift >= 0.5, F.when(shift >= 2, "major").otherwise("minor"), F.lit("position_shift")),
            entry(demand >= 10, F.when(demand >= 50, "major").otherwise("minor"), F.lit("demand_shift")),
            entry(uneven, F.when(c("controlled"), "info").otherwise("minor"), F.lit("weekday_mix")),
            entry(seasonal, season_severity, season_code),
            entry(c("controlled") & ~F.coalesce("pre_trend_passed", F.lit(True)), F.lit("major"), F.lit("parallel_trends_violated")),
        )
    )
    own = context.select("request_id", F.lit(None).cast("string").alias("ref"), F.inline(entries))
    external = context.select(
        "request_id", F.explode("context_refs").alias("ref"), F.lit("minor").alias("severity"), F.lit("external_context").alias("code")
    )
    return own.unionByName(external)


def confounder_counts(confounders: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """Major and minor confounders per request, with those of shared changes added."""
    own = confounders.groupBy("request_id").agg(
        F.count_if(F.col("severity") == "major").alias("majors"),
        F.count_if(F.col("severity") == "minor").alias("minors"),
        F.count(F.lit(1)).alias("confounder_count"),
    )
    if shared is None:
        return own
    both = own.join(shared, "request_id", "full").fillna(0)
    extra = F.col("shared_majors") + F.col("shared_minors")
    return both.select(
        "request_id",
        (F.col("majors") + F.col("shared_majors")).alias("majors"),
        (F.col("minors") + F.col("shared_minors")).alias("minors"),
        (F.col("confounder_count") + extra).alias("confounder_count"),
    )


def linked_timing(classified: DataFrame, requests: DataFrame) -> DataFrame:
    """Per request: linked changes, how many are placed, and whether all lie outside the windows."""
    linked = classified.where(F.col("relation") == "linked").join(requests.select("request_id", "before_start", "after_end"), "request_id")
    day = F.col("live_date")
    return linked.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("linked"),
        F.count(day).alias("placed"),
        F.bool_and(F.when(day.isNotNull(), day > F.col("after_end"))).alias("all_late"),
        F.bool_and(F.when(day.isNotNull(), day < F.col("before_start"))).alias("all_early"),
    )


def causal_confidence(rows: DataFrame) -> DataFrame:
    """Add ``causal_confidence`` and ``causal_reason``.

    Reads design, design_ceiling, evidence_strength, linked, placed, all_late,
    all_early, majors and minors. The design sets a ceiling, evidence caps it,
    each major confounder and every three or more minor ones lower it a step,
    but not below low.
    """
    c = F.col
    count = lambda name: F.coalesce(c(name), F.lit(0))
    none = (
        F.when(count("linked") == 0, "no registered change or experiment is linked")
        .when(c("evidence_strength") == "insufficient", "evidence is insufficient")
        .when(count("placed") == 0, "linked change timing is unknown")
        .when(c("all_late"), "linked change happened after the measurement window")
        .when(c("all_early"), "linked change predates both compared periods")
    )
    design = (
        F.when(c("design") == "randomized_controlled", 3)
        .when(c("design").isin("difference_in_differences", "controlled", "before_after"), 2)
        .otherwise(1)
    )
    ceiling = F.coalesce(_rank(c("design_ceiling"), CAUSAL_SCALE), design)
    capped = F.least(ceiling, F.when(c("evidence_strength") == "low", 1).when(c("evidence_strength") == "medium", 2).otherwise(3))
    steps = count("majors") + F.when(count("minors") >= 3, 1).otherwise(0)
    rank = F.greatest(F.lit(1), capped - steps)
    reason = F.when(none.isNotNull(), none).when(steps >= capped, "floored at low").otherwise("design ceiling less confounders")
    return rows.withColumns(
        {
            "causal_confidence": _name(F.when(none.isNotNull(), 0).otherwise(rank), CAUSAL_SCALE),
            "causal_reason": reason,
        }
    )


def design_ceiling(controlled: Column, pre_trend_passed: Column, statistic: Column) -> Column:
    """A clean difference-in-differences may reach high; without a control there is no own ceiling."""
    clear = F.coalesce(pre_trend_passed, F.lit(False)) & (F.abs(F.coalesce(statistic, F.lit(0.0))) >= 3)
    return F.when(controlled, F.when(clear, "high").otherwise("medium"))
