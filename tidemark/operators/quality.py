"""Data-quality checks; every check yields rows of one issue table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import quality_level, severity_rank
from ..functions.dates import days_inclusive
from ..functions.numbers import round_half_up
from ..session import broadcast_if_small
from ..settings import METRIC_KINDS
from .change_windows import span_changes

ISSUE = ("code", "severity", "detail")


def issues_from(rows: DataFrame, keys: Sequence[str], rules: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """Long issue rows from (code, severity or NULL, detail) rules on one row per key."""
    entries = [
        F.when(
            severity.isNotNull(),
            F.struct(F.lit(code).alias("code"), severity.alias("severity"), detail.cast("string").alias("detail")),
        )
        for code, severity, detail in rules
    ]
    return rows.select(*keys, F.inline(F.array_compact(F.array(*entries))))


def quality_levels(issues: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Worst severity per key as a level; keys without issues are not listed."""
    worst = F.max(severity_rank(F.col("severity")))
    return issues.groupBy(*keys).agg(quality_level(worst).alias("data_quality"))


def distinct_issues(issues: DataFrame, keys: Sequence[str] = ("request_id",)) -> DataFrame:
    """Issues of both windows without repeats: source issues once per request, the rest per text."""
    code = F.col("code")
    mark = F.when(code.startswith("source_"), F.lit("")).when(code == "timezone_mismatch", F.col("severity"))
    return issues.withColumn("_mark", F.coalesce(mark, F.concat_ws(":", "label", "detail"))).dropDuplicates([*keys, "code", "_mark"]).drop("_mark")


# ---- source health ---------------------------------------------------------


def source_health(sources: DataFrame, now: Column) -> DataFrame:
    """Health of each source at ``now``: disabled, unavailable, unknown, stale or ok.

    ``data_through`` is a date and means the end of that day.
    """
    failed = (F.col("status") == "unavailable") | (
        F.col("last_error_at").isNotNull() & (F.col("last_success_at").isNull() | (F.col("last_error_at") > F.col("last_success_at")))
    )
    through = F.coalesce(F.date_add("data_through", 1).cast("timestamp"), F.col("last_success_at"))
    age = (F.unix_micros(now) - F.unix_micros(through)) / F.lit(3.6e9)
    limit = F.coalesce("stale_after_hours", F.lit(48.0))
    days = F.when(F.col("data_through").isNull(), F.floor(age / 24)).otherwise(F.datediff(F.to_date(now), "data_through"))
    health = (
        F.when(F.col("status") == "disabled", "disabled")
        .when(failed, "unavailable")
        .when(F.col("last_success_at").isNull(), "unknown")
        .when(age > limit, "stale")
        .otherwise("ok")
    )
    aged = sources.withColumn("health", health)
    timed = F.col("health").isin("stale", "ok")
    return aged.withColumns(
        {"age_hours": F.when(timed, round_half_up(age, 0)), "age_days": F.when(F.col("health") == "stale", days.cast("bigint"))}
    )


def health_severity(health: Column) -> Column:
    return (
        F.when(health.isin("unconfigured", "disabled", "unavailable"), "blocking").when(health == "stale", "major").when(health == "unknown", "minor")
    )


def health_issues(health: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Issue rows for sources that are not ok; a missing source is ``unconfigured``."""
    state = F.coalesce("health", F.lit("unconfigured"))
    code = F.when(state == "unknown", "source_health_unknown").otherwise(F.concat(F.lit("source_"), state))
    return (
        health.withColumns({"code": code, "severity": health_severity(state), "detail": F.col("source_id")})
        .where(F.col("severity").isNotNull())
        .select(*keys, *ISSUE)
    )


def availability(areas: DataFrame, health: DataFrame) -> DataFrame:
    """Health per reporting area; an optional area without a source is no gap."""
    joined = areas.join(health.select("source_id", "health", "data_through"), "source_id", "left")
    absent = F.when(F.col("optional"), "not_configured (optional)").otherwise("not_configured")
    state = F.when(F.col("source_id").isNull(), absent).otherwise(F.coalesce("health", F.lit("unconfigured")))
    gap = F.when(F.col("source_id").isNull(), ~F.col("optional")).otherwise(state != "ok")
    return joined.select("area", "source_id", state.alias("health"), "data_through", gap.alias("is_gap"))


# ---- rows of a period ------------------------------------------------------


def missing_dates(present: DataFrame, windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Calendar days of each window that have no rows."""
    calendar = windows.select(*keys, F.explode(F.sequence("start", "end")).alias("date"))
    return calendar.join(present.select(*keys, "date").distinct(), [*keys, "date"], "left_anti")


def missing_date_issues(present: DataFrame, windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One issue per window with missing days, naming the first ten."""
    gaps = missing_dates(present, windows, keys)
    counted = gaps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("missing"), F.array_sort(F.collect_set("date")).alias("_days")
    ).join(windows, list(keys))
    share = F.col("missing") / days_inclusive(F.col("start"), F.col("end"))
    severity = F.when(share > 0.5, "blocking").when(share > 0.1, "major").otherwise("minor")
    first = F.array_join(F.transform(F.slice("_days", 1, 10), lambda d: d.cast("string")), ",")
    return counted.select(*keys, F.lit("missing_dates").alias("code"), severity.alias("severity"), first.alias("detail"), "missing")


def duplicate_keys(rows: DataFrame, keys: Sequence[str], identity: Sequence[str]) -> DataFrame:
    """Row keys seen more than once; missing values compare as equal."""
    return rows.groupBy(*keys, *identity).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def duplicate_count(rows: DataFrame, keys: Sequence[str], identity: Sequence[str]) -> DataFrame:
    """Number of repeated row keys per group."""
    counts = duplicate_keys(rows, keys, identity)
    return counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("duplicates"))


def invalid_values(rows: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Rows per group with a negative or non-finite number in one of the fields."""
    bad = F.lit(False)
    for name in fields:
        number = F.col(name).cast("double")
        bad = bad | F.coalesce((number < 0) | F.isnan(number) | (F.abs(number) == float("inf")), F.lit(False))
    return rows.groupBy(*keys).agg(F.count_if(bad).alias("invalid")).where(F.col("invalid") > 0)


def incomplete_severity(data_through: Column, start: Column, end: Column) -> Column:
    """Severity of data that ends before the period does, else NULL."""
    share = F.datediff(end, data_through) / days_inclusive(start, end)
    return F.when(data_through < end, F.when(share > 0.5, "blocking").otherwise("major"))


def period_checks(
    rows: DataFrame,
    windows: DataFrame,
    keys: Sequence[str],
    identity: Sequence[str],
    fields: Sequence[str],
) -> DataFrame:
    """Row checks of every window: no rows, incomplete, missing days, duplicates, invalid values.

    ``windows`` has keys, start, end, data_through and expect_daily. Rows are
    reduced once to their identity; everything else reads that.
    """
    keys = list(keys)
    bad = F.lit(False)
    for name in fields:
        number = F.col(name).cast("double")
        bad = bad | F.coalesce((number < 0) | F.isnan(number) | (F.abs(number) == float("inf")), F.lit(False))
    names = list(dict.fromkeys(["date", *identity]))
    distinct = rows.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("_n"), F.count_if(bad).alias("_bad"))
    by_day = distinct.groupBy(*keys, "date").agg(
        F.sum("_n").alias("rows"), F.count_if(F.col("_n") > 1).alias("duplicates"), F.sum("_bad").alias("invalid")
    )
    summed = by_day.groupBy(*keys).agg(F.sum("rows").alias("rows"), F.sum("duplicates").alias("duplicates"), F.sum("invalid").alias("invalid"))
    counted = windows.join(summed, keys, "left").fillna(0, ["rows", "duplicates", "invalid"])
    some = F.col("rows") > 0
    plain = issues_from(
        counted,
        keys,
        [
            ("no_rows", F.when(~some, F.lit("blocking")), F.lit("")),
            (
                "incomplete_period",
                F.when(some, incomplete_severity(F.col("data_through"), F.col("start"), F.col("end"))),
                F.datediff("end", "data_through"),
            ),
            ("duplicate_rows", F.when(F.col("duplicates") > 0, F.lit("major")), F.col("duplicates")),
            ("invalid_values", F.when(F.col("invalid") > 0, F.lit("major")), F.col("invalid")),
        ],
    )
    daily = counted.where(some & F.col("expect_daily")).select(*keys, "start", "end")
    gaps = missing_date_issues(by_day.where("date IS NOT NULL"), daily, keys)
    return plain.unionByName(gaps.select(*keys, *ISSUE))


def sample_issue(value: Column, minimum: Column) -> Column:
    """Severity for a sample below the metric's minimum."""
    return F.when((minimum > 0) & (F.coalesce(value, F.lit(0.0)) < minimum), "major")


def timezone_issue(source_zone: Column, own_zone: Column, days: Column) -> Column:
    """Severity of days cut in another time zone: negligible over a week or more."""
    return F.when(source_zone != own_zone, F.when(days >= 7, "info").otherwise("minor"))


def missing_share_issue(missing: Column, rows: Column) -> Column:
    return F.when(missing > 0, F.when(missing / F.greatest(F.lit(1), rows) > 0.1, "major").otherwise("minor"))


def metric_source_issue(kind: Column) -> Column:
    """Diagnostic kinds never supply a metric value."""
    return F.when(~kind.isin(*METRIC_KINDS), "blocking")


def headline_issue(kind: Column, dimensions: Column, scoped: Column) -> Column:
    """Property-level totals from query or page rows double count."""
    split = F.arrays_overlap(dimensions, F.array(F.lit("query"), F.lit("page")))
    return F.when((kind == "gsc_rows") & ~scoped & split, "major")


def anonymized_issue(kind: Column, dimensions: Column, scoped: Column, by_query: Column) -> Column:
    """Query rows leave out anonymized queries."""
    return F.when((kind == "gsc_rows") & scoped & F.array_contains(dimensions, "query") & ~by_query, "minor")


# ---- tracking breaks -------------------------------------------------------


#: Days of a series that one task handles at once.
CHUNK_DAYS = 4096


def zero_runs(daily: DataFrame, keys: Sequence[str], value: str = "value", chunk_days: int | None = None) -> DataFrame:
    """Runs of zero days per key: first day, length, and the mean of all days before the run.

    Runs are judged over the days present, not over the calendar. A series is cut
    into chunks of ``chunk_days``; runs are found in each, and those that touch
    the border of neighbouring chunks are joined. So a window holds a chunk, or a
    few rows per chunk of a key, however long the series is.
    """
    keys = list(keys)
    chunk = F.floor(F.unix_date("date") / (chunk_days or CHUNK_DAYS))
    amount = F.coalesce(F.col(value), F.lit(0)).cast("double")
    rows = daily.select(*keys, "date", amount.alias("_v"), chunk.alias("_chunk"))
    # level one: runs inside a chunk
    order = Window.partitionBy(*keys, "_chunk").orderBy("date")
    numbered = rows.withColumns(
        {
            "_i": F.row_number().over(order),
            "_sum": F.coalesce(F.sum("_v").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "_n": F.count(F.lit(1)).over(Window.partitionBy(*keys, "_chunk")),
        }
    ).where("_v = 0")
    runs = numbered.withColumn("_island", F.col("_i") - F.row_number().over(order)).groupBy(*keys, "_chunk", "_island").agg(
        F.min("date").alias("first_zero"), F.count(F.lit(1)).alias("zero_days"), F.min("_i").alias("_i"), F.min("_sum").alias("_sum"), F.max("_i").alias("_last"), F.max("_n").alias("_n")
    )
    # level two: what comes before each chunk, and runs that go on in the next
    along = Window.partitionBy(*keys).orderBy("_chunk")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_rows"), F.sum("_v").alias("_total")).select(
        *keys, "_chunk", F.row_number().over(along).alias("_c"), F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
        F.coalesce(F.sum("_total").over(earlier), F.lit(0.0)).alias("_sum_before"), F.sum("_rows").over(Window.partitionBy(*keys)).alias("days"),
    )
    same = F.col("r._chunk") == F.col("t._chunk")
    for k in keys:
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}"))
    before = F.col("_rows_before") + F.col("_i") - 1
    placed = runs.alias("r").join(totals.alias("t"), same).select(
        *[F.col(f"r.{k}").alias(k) for k in keys], "first_zero", "zero_days", "days", F.when(before > 0, (F.col("_sum_before") + F.col("_sum")) / before).otherwise(0.0).alias("prior_average"),
        "_c", (F.col("_i") == 1).alias("_opens"), (F.col("_last") == F.col("_n")).alias("_closes"),
    )
    border = F.col("_opens") | F.col("_closes")
    beside = Window.partitionBy(*keys).orderBy("first_zero")
    goes_on = F.col("_opens") & F.coalesce(F.lag("_closes").over(beside) & (F.lag("_c").over(beside) == F.col("_c") - 1), F.lit(False))
    linked = placed.where(border).withColumn("_new", (~goes_on).cast("int"))
    joined = linked.withColumn("_run", F.sum("_new").over(beside.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "_run").agg(
        F.min("first_zero").alias("first_zero"), F.sum("zero_days").alias("zero_days"), F.max("days").alias("days"), F.min_by("prior_average", "first_zero").alias("prior_average")
    )
    columns = [*keys, "first_zero", "zero_days", "days", "prior_average"]
    return joined.select(*columns).unionByName(placed.where(~border).select(*columns))


def sudden_zero(daily: DataFrame, keys: Sequence[str], value: str = "value", min_average: float = 5) -> DataFrame:
    """First run of two or more zero days after a daily average of at least ``min_average``."""
    runs = zero_runs(daily, keys, value).where(
        (F.col("days") >= 4) & (F.col("zero_days") >= 2) & (F.col("prior_average") >= min_average)
    )
    return runs.groupBy(*keys).agg(F.min(F.struct("first_zero", "zero_days", "prior_average")).alias("_r")).select(*keys, "_r.*")


def boundary_zero(daily: DataFrame, keys: Sequence[str], value: str = "value", min_average: float = 5) -> DataFrame:
    """Zero runs of the after window judged against the before window's average.

    ``daily`` has a ``label``; half of the days or more at zero is blocking.
    """
    keys = list(keys)
    amount = F.coalesce(F.col(value), F.lit(0)).cast("double")
    stats = daily.groupBy(*keys).agg(
        F.count_if(F.col("label") == "before").alias("before_days"),
        F.count_if(F.col("label") == "after").alias("after_days"),
        F.avg(F.when(F.col("label") == "before", amount)).alias("before_average"),
        F.count_if((F.col("label") == "after") & (amount == 0)).alias("zero_days"),
    )
    longest = zero_runs(daily.where(F.col("label") == "after"), keys, value).groupBy(*keys).agg(
        F.max("zero_days").alias("longest_run"), F.min("first_zero").alias("first_zero")
    )
    hit = stats.join(longest, keys).where(
        (F.col("before_days") >= 3) & (F.col("after_days") >= 2) & (F.col("before_average") >= min_average) & (F.col("longest_run") >= 2)
    )
    severity = F.when(F.col("zero_days") / F.col("after_days") >= 0.5, "blocking").otherwise("major")
    return hit.select(*keys, "first_zero", "zero_days", "longest_run", "after_days", "before_average", severity.alias("severity"))


# ---- between windows, sources and changes ---------------------------------


def comparability(selected: DataFrame, snapshots: DataFrame, keys: Sequence[str] = ("request_id",)) -> DataFrame:
    """Issues where before and after pulls differ in property, version or dimensions, and pull warnings."""
    keys = list(keys)
    used = selected.select(*keys, "label", "snapshot_id").distinct().join(snapshots, "snapshot_id")
    signature = F.to_json(
        F.struct(
            F.coalesce("property", F.lit("")).alias("p"), F.coalesce("adapter_version", F.lit(1)).alias("v"), F.array_sort("dimensions").alias("d")
        )
    )
    sides = used.withColumn("_s", signature).groupBy(*keys, "label").agg(F.array_sort(F.collect_set("_s")).alias("_set"))
    both = sides.groupBy(*keys).agg(
        F.max(F.when(F.col("label") == "before", F.col("_set"))).alias("b"), F.max(F.when(F.col("label") == "after", F.col("_set"))).alias("a")
    )
    differs = both.where(F.col("b") != F.col("a")).select(
        *keys, F.lit("schema_change").alias("code"), F.lit("major").alias("severity"), F.lit("").alias("detail")
    )
    warned = used.select(*keys, "snapshot_id", F.explode("warnings").alias("detail")).distinct()
    notes = warned.select(*keys, F.lit("source_warning").alias("code"), F.lit("minor").alias("severity"), "detail")
    return differs.unionByName(notes)


def deployed_tracking(changes: DataFrame) -> DataFrame:
    """Tracking changes that went live, with their day."""
    return changes.where((F.col("type") == "tracking_change") & (F.col("deploy_status") != "pending")).select("change_id", F.to_date("live_at").alias("date"))


def tracking_changes(changes: DataFrame, windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Deployed tracking changes inside each window; they are looked up once per distinct span."""
    found = span_changes(deployed_tracking(changes), windows)
    return broadcast_if_small(windows.select(*keys, "start", "end")).join(found, ["start", "end"]).select(
        *keys, F.lit("tracking_change_in_window").alias("code"), F.lit("major").alias("severity"), F.col("change_id").cast("string").alias("detail")
    )


def discrepancies(values: DataFrame, keys: Sequence[str], tolerance: float | str = 5.0) -> DataFrame:
    """Every other source against the canonical one per metric and period, beyond the tolerance.

    ``values`` has keys, source_id, is_canonical and value.
    """
    keys = list(keys)
    base = values.where("is_canonical").select(*keys, F.col("source_id").alias("canonical_source"), F.col("value").alias("canonical_value"))
    others = values.where(~F.col("is_canonical") & F.col("value").isNotNull())
    joined = others.join(base.where(F.col("canonical_value").isNotNull()), keys)
    raw = F.when(
        F.col("canonical_value") == 0, F.when(F.col("value") == 0, F.lit(0.0)).otherwise(F.lit(100.0))
    ).otherwise((F.col("value") - F.col("canonical_value")) / F.abs("canonical_value") * 100)
    limit = F.col(tolerance) if isinstance(tolerance, str) else F.lit(tolerance)
    return joined.withColumn("_d", raw).where(F.abs("_d") > limit).select(
        *keys, "source_id", "value", "canonical_source", "canonical_value", round_half_up(F.col("_d"), 2).alias("difference_pct")
    )


def baseline_drift(measured: Column, recorded: Column) -> Column:
    """Drift of a re-measured baseline in percent."""
    return F.when(recorded == 0, F.when(measured == 0, F.lit(0.0)).otherwise(F.lit(100.0))).otherwise(
        F.abs((measured - recorded) / F.when(recorded != 0, recorded)) * 100
    )


def baseline_severity(drift: Column) -> Column:
    return F.when(drift > 10, "major").when(drift > 1, "minor")
