"""Metric dictionary and the five aggregations.

A metric's value over any period is a sum of per-day parts, so the facts are
reduced to one row per key, day and segment in a single map-side combined
aggregation. Values, daily series, halves and quality counts come from those
parts and never from the facts again. All parts are plain numbers, so the
aggregation stays hash-based. Of several values on the last day the greatest counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small

WIDE_FIELDS = ("clicks", "impressions", "ctr", "position", "value")
_MAPPING = ("aggregation", "field", "series", "numerator", "denominator", "weight", "scale")

#: parts that add up over days, segments and scope values
PARTS = (
    "rows", "val_rows", "val_n", "val_sum", "top_sum", "bottom_sum", "bottom_n", "wt_sum", "wt_n",
    "ratio_missing", "null_cells", "pair_n", "pair_top", "pair_bottom", "vw_n", "vw_sum", "vw_weight",
    "ctx_impressions", "ctx_weight", "ctx_sum",
)


def resolve_mappings(metrics: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """One row per metric and source: the metric's mapping with the source's overrides on top."""
    sources = F.array_distinct(
        F.array_compact(F.concat(F.array("canonical_source"), F.coalesce("fallback_sources", F.array().cast("array<string>"))))
    )
    named = metrics.withColumn("source_id", F.explode_outer(sources))
    if overrides is not None:
        renamed = overrides.select("metric_id", "source_id", *[F.col(c).alias(f"_{c}") for c in _MAPPING])
        extra = renamed.join(metrics, "metric_id").select(*named.columns)
        named = named.unionByName(extra).dropDuplicates(["metric_id", "source_id"]).join(renamed, ["metric_id", "source_id"], "left")
    else:
        named = named.select("*", *[F.lit(None).cast("string").alias(f"_{c}") for c in _MAPPING])
    merged = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in _MAPPING}
    merged["scale"] = F.coalesce(F.col("_scale").cast("double"), F.col("scale"), F.lit(1.0))
    merged["field"] = F.coalesce(merged["field"], F.lit("value"))
    resolved = named.withColumns(merged).drop(*[f"_{c}" for c in _MAPPING])
    return resolved.withColumn("series_field", series_field())


def series_field() -> Column:
    """Series a time-series metric reads: ``series``, else a named field, else its own id."""
    return F.coalesce("series", F.when(F.col("field") != "value", F.col("field")), "metric_id")


def with_mapping(
    rows: DataFrame,
    metric_id: str,
    aggregation: str,
    field: str = "value",
    series: str | None = None,
    numerator: str | None = None,
    denominator: str | None = None,
    weight: str | None = None,
    scale: float = 1.0,
    kind: str = "gsc_rows",
) -> DataFrame:
    """Attach one metric's mapping to every row."""
    values = dict(
        metric_id=metric_id, aggregation=aggregation, field=field, series_field=series or (field if field != "value" else metric_id),
        numerator=numerator, denominator=denominator, weight=weight, scale=float(scale), kind=kind,
    )
    mapped = rows.withColumns({k: F.lit(v).cast("double" if k == "scale" else "string") for k, v in values.items()})
    if kind == "timeseries":
        wanted = F.array_compact(F.array("series_field", "numerator", "denominator", "weight"))
        mapped = mapped.where(F.array_contains(wanted, F.col("series")))
    return mapped


def join_mappings(facts: DataFrame, mappings: DataFrame) -> DataFrame:
    """Facts with the mapping of every metric that reads them.

    Time-series rows meet a metric through the series it names; search rows
    through their source. Both are equi-joins. A dictionary of usual size is
    broadcast, so that the facts are read once even where all have one source:
    Spark then sees no join key.
    """
    mappings = broadcast_if_small(mappings)
    columns = ["metric_id", "aggregation", "field", "series_field", "numerator", "denominator", "weight", "scale"]
    wide = facts.where(F.col("kind") == "gsc_rows").join(mappings.select("source_id", *columns), "source_id")
    if "series" not in facts.columns:
        return wide
    names = F.array_distinct(F.array_compact(F.array("series_field", "numerator", "denominator", "weight")))
    by_series = mappings.select("source_id", *columns, F.explode(names).alias("series"))
    tall = facts.where(F.col("kind") == "timeseries").join(by_series, ["source_id", "series"])
    return wide.unionByName(tall, allowMissingColumns=True)


def _cells(columns: Sequence[str]) -> dict[str, Column]:
    """Value, numerator, denominator and weight of a row under its mapping."""
    tall = F.col("kind") == "timeseries"

    def named(role: str) -> Column:
        wide = F.lit(None).cast("double")
        for name in WIDE_FIELDS:
            if name in columns:
                wide = F.when(F.col(role) == name, F.col(name).cast("double")).otherwise(wide)
        if "series" not in columns:
            return wide
        key = F.when(F.col("aggregation") == "weighted_mean", F.col("field")).otherwise(F.col("series_field")) if role == "field" else F.col(role)
        return F.when(tall, F.when(F.col("series") == key, F.col("value").cast("double"))).otherwise(wide)

    return {"_val": named("field"), "_top": named("numerator"), "_bottom": named("denominator"), "_wt": named("weight")}


def _context(columns: Sequence[str]) -> list[Column]:
    """Impressions and position-weighted sums of search rows, whatever the metric."""
    if not {"impressions", "position"} <= set(columns):
        return [F.sum(F.lit(None).cast("double")).alias(n) for n in ("ctx_impressions", "ctx_weight", "ctx_sum")]
    shown = F.coalesce("impressions", F.lit(0)).cast("double")
    placed = F.when(F.col("position").isNotNull(), shown)
    return [
        F.sum(F.col("impressions").cast("double")).alias("ctx_impressions"),
        F.sum(placed).alias("ctx_weight"),
        F.sum(F.col("position").cast("double") * placed).alias("ctx_sum"),
    ]


def metric_parts(rows: DataFrame, keys: Sequence[str], segment: str | None = None) -> DataFrame:
    """Additive parts per key from rows that carry a mapping."""
    keys = [*keys, *([segment] if segment else [])]
    cells = rows.withColumns(_cells(rows.columns))
    val, top, bottom, wt = (F.col(c) for c in ("_val", "_top", "_bottom", "_wt"))
    tall = F.col("kind") == "timeseries"
    series = F.col("series") if "series" in rows.columns else F.lit(None).cast("string")
    raw = F.col("value") if "value" in rows.columns else F.lit(None).cast("double")
    both, weighed = top.isNotNull() & bottom.isNotNull(), val.isNotNull() & wt.isNotNull()
    in_ratio = (series == F.col("numerator")) | (series == F.col("denominator"))
    return cells.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~tall | (series == F.col("series_field"))).alias("val_rows"),
        F.count(val).alias("val_n"),
        F.sum(val).alias("val_sum"),
        F.sum(top).alias("top_sum"),
        F.sum(bottom).alias("bottom_sum"),
        F.count(bottom).alias("bottom_n"),
        F.sum(wt).alias("wt_sum"),
        F.count(wt).alias("wt_n"),
        F.count_if(tall & in_ratio & raw.isNull()).alias("ratio_missing"),
        F.count_if(tall & raw.isNull()).alias("null_cells"),
        F.count_if(both).alias("pair_n"),
        F.sum(F.when(both, top)).alias("pair_top"),
        F.sum(F.when(both, bottom)).alias("pair_bottom"),
        F.count_if(weighed).alias("vw_n"),
        F.sum(F.when(weighed, val * wt)).alias("vw_sum"),
        F.sum(F.when(weighed, wt)).alias("vw_weight"),
        *_context(rows.columns),
        F.max(val).alias("last"),
    )


def add_parts(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum parts to fewer keys."""
    return parts.groupBy(*keys).agg(*[F.sum(name).alias(name) for name in PARTS], F.max("last").alias("last"))


def daily_parts(parts: DataFrame, keys: Sequence[str], segment: str = "segment") -> DataFrame:
    """Parts per key and day, with time-series weighted means paired by day and segment."""
    paired = add_parts(parts, [*keys, "date", segment]) if segment in parts.columns else parts
    tall = (F.col("kind") == "timeseries") & (F.col("aggregation") == "weighted_mean")
    both = (F.col("val_n") > 0) & (F.col("wt_n") > 0)
    changed = {
        "vw_sum": F.when(tall, F.when(both, F.col("val_sum") * F.col("wt_sum"))).otherwise(F.col("vw_sum")),
        "vw_weight": F.when(tall, F.when(both, F.col("wt_sum"))).otherwise(F.col("vw_weight")),
        "vw_n": F.when(tall, F.col("rows") - F.col("null_cells") - (~both).cast("bigint")).otherwise(F.col("vw_n")),
    }
    return add_parts(paired.withColumns(changed), [*keys, "date"])


def _named(prefix: str):
    return lambda name: F.col(prefix + name)


def _is_tall() -> Column:
    return F.col("kind") == "timeseries"


def metric_value(prefix: str = "") -> Column:
    """Value of the parts under the row's aggregation; unknown stays NULL, never 0."""
    kind, c = F.col("aggregation"), _named(prefix)
    top = F.when(_is_tall(), F.coalesce(c("top_sum"), F.lit(0.0))).otherwise(c("pair_top"))
    bottom = F.when(_is_tall(), c("bottom_sum")).otherwise(c("pair_bottom"))
    return (
        F.when(kind == "sum", F.when(c("val_n") > 0, c("val_sum")))
        .when(kind == "ratio_of_sums", F.when(bottom > 0, top / bottom * F.col("scale")))
        .when(kind == "weighted_mean", F.when(c("vw_weight") > 0, c("vw_sum") / c("vw_weight")))
        .when(kind == "mean", F.when(c("val_n") > 0, c("val_sum") / c("val_n")))
        .when(kind == "last", c("last"))
    )


def numerator(prefix: str = "") -> Column:
    c = _named(prefix)
    return F.coalesce(F.when(_is_tall(), c("top_sum")).otherwise(c("pair_top")), F.lit(0.0))


def denominator(prefix: str = "") -> Column:
    c = _named(prefix)
    return F.coalesce(F.when(_is_tall(), c("bottom_sum")).otherwise(c("pair_bottom")), F.lit(0.0))


def sample(prefix: str = "") -> Column:
    """Volume behind the value: the sum itself, the denominator, the weight, or the number of cells."""
    kind, c = F.col("aggregation"), _named(prefix)
    return (
        F.when(kind == "sum", F.coalesce(c("val_sum"), F.lit(0.0)))
        .when(kind == "ratio_of_sums", denominator(prefix))
        .when(kind == "weighted_mean", F.coalesce(c("vw_weight"), F.lit(0.0)))
        .otherwise(c("val_n").cast("double"))
    )


def missing_values(prefix: str = "") -> Column:
    """Cells skipped because they are unknown."""
    kind, c = F.col("aggregation"), _named(prefix)
    return (
        F.when(kind == "ratio_of_sums", F.when(_is_tall(), c("ratio_missing")).otherwise(c("rows") - c("pair_n")))
        .when(kind == "weighted_mean", c("rows") - c("vw_n"))
        .otherwise(c("val_rows") - c("val_n"))
    )


def volume() -> Column:
    """Daily volume for zero checks: the sum, or a ratio's denominator; NULL for other aggregations."""
    kind = F.col("aggregation")
    return F.when(kind == "sum", F.when(F.col("val_n") > 0, F.col("val_sum"))).when(
        kind == "ratio_of_sums", F.when(F.col("bottom_n") > 0, F.col("bottom_sum"))
    )


def daily_series(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Value per key and day; days without a value are dropped."""
    return parts.where(F.col("date").isNotNull()).select(*keys, "date", metric_value().alias("value")).where("value IS NOT NULL")


def last_value(where: Column | None = None) -> Column:
    """Value of the latest day that has one."""
    held = F.col("last").isNotNull() if where is None else where & F.col("last").isNotNull()
    return F.max_by("last", F.when(held, F.col("date")))


def period_values(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Value, sample and counts per key over all its days. ``last`` is the value of the latest day."""
    summed = parts.groupBy(*keys).agg(
        *[F.sum(name).alias(name) for name in PARTS], F.count("date").alias("distinct_dates"), last_value().alias("last")
    )
    return summed.select(
        *keys,
        metric_value().alias("value"),
        sample().alias("sample"),
        numerator().alias("numerator"),
        denominator().alias("denominator"),
        F.col("rows").alias("row_count"),
        "distinct_dates",
        missing_values().alias("missing_values"),
    )
