"""Raw export rows to typed observation rows, one adapter per kind."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import index_verdict
from ..functions.dates import iso_date, parse_timestamp
from ..functions.numbers import ctr_fraction, or_null, parse_flag, parse_number, position_or_null, split_list
from .readers import column_key

# fixed values: header names of the search dimensions, first present wins
SEARCH_ALIASES = {
    "date": ("date", "day"),
    "query": ("query", "queries", "top_queries", "keyword"),
    "page": ("page", "pages", "top_pages", "url", "landing_page"),
    "country": ("country", "countries"),
    "device": ("device", "devices"),
    "segment": ("segment", "market"),
}

# fixed values: behaviour block names and the column each fills
BEHAVIOR_BLOCKS = {
    "deadclickcount": "dead_click_pct",
    "rageclickcount": "rage_click_pct",
    "quickbackclick": "quickback_pct",
    "excessivescroll": "excessive_scroll_pct",
    "errorclickcount": "error_click_pct",
    "scripterrorcount": "script_error_pct",
}


def lower_names(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"`{n}`").alias(column_key(n)) for n in rows.columns])


def pick(rows: DataFrame, names: Sequence[str], default: str | None = None) -> Column:
    """First non-empty value of the columns that are present."""
    present = [or_null(F.col(f"`{n}`").cast("string")) for n in names if n in rows.columns]
    value = F.coalesce(*present) if present else F.lit(None).cast("string")
    return F.coalesce(value, F.lit(default)) if default is not None else value


def search_rows(rows: DataFrame, dimensions: Sequence[str] = ()) -> DataFrame:
    """Search rows from named columns, or from a positional ``keys`` array with its dimension list."""
    rows = lower_names(rows)
    if "keys" in rows.columns:
        if not dimensions:
            raise ValueError("rows with keys need the list of dimensions")
        named = {d: F.try_element_at("keys", F.lit(i + 1)) for i, d in enumerate(dimensions)}
        values = {d: named.get(d, F.lit(None).cast("string")) for d in SEARCH_ALIASES}
    else:
        values = {d: pick(rows, aliases) for d, aliases in SEARCH_ALIASES.items()}
    number = lambda n: parse_number(F.col(n)) if n in rows.columns else F.lit(None).cast("double")
    ctr = ctr_fraction(F.col("ctr")) if "ctr" in rows.columns else F.lit(None).cast("double")
    return rows.select(
        iso_date(values.pop("date")).alias("date"), *[v.alias(d) for d, v in values.items()],
        number("clicks").cast("bigint").alias("clicks"), number("impressions").cast("bigint").alias("impressions"),
        ctr.alias("ctr"), number("position").cast("decimal(9,2)").alias("position"),
    )


def present_dimensions(rows: DataFrame, names: Sequence[str] = tuple(SEARCH_ALIASES)) -> DataFrame:
    """One row: the dimensions that hold any value."""
    held = F.array_compact(F.array(*[F.when(F.max(F.col(n)).isNotNull(), F.lit(n)) for n in names]))
    return rows.agg(held.alias("dimensions"))


def rankings(rows: DataFrame, provider: str = "unknown", observed_at: str | None = None) -> DataFrame:
    """Rank-tracker rows with defaults; a position of blank, "-" or ">100" is not ranking."""
    rows = lower_names(rows)
    features = F.col("serp_features") if "serp_features" in rows.columns else F.col("features") if "features" in rows.columns else F.lit("")
    kept = features if dict(rows.dtypes).get("serp_features", "").startswith("array") else split_list(features)
    return rows.select(
        pick(rows, ("keyword", "query", "term")).alias("keyword"),
        pick(rows, ("location", "country", "market", "geo"), "unspecified").alias("location"),
        F.lower(pick(rows, ("device",), "desktop")).alias("device"),
        F.lower(pick(rows, ("engine", "search_engine"), "google")).alias("engine"),
        position_or_null(pick(rows, ("position", "rank", "current_position"))).cast("decimal(6,1)").alias("position"),
        pick(rows, ("url", "landing_page", "ranking_url", "page")).alias("url"),
        kept.alias("serp_features"),
        parse_timestamp(pick(rows, ("observed_at", "date", "checked_at", "timestamp"), observed_at)).alias("observed_at"),
        pick(rows, ("provider",), provider).alias("provider"),
    )


_RESERVED = ("date", "day", "metric", "value", "segment")


def dimension_columns(rows: DataFrame) -> list[str]:
    """Columns that hold any non-numeric text; the others are series. One aggregate over the rows."""
    others = [n for n in rows.columns if n not in _RESERVED]
    if not others:
        return []
    texts = rows.agg(*[F.bool_or((F.col(n) != "") & parse_number(F.col(n)).isNull()).alias(n) for n in others]).first()
    return [n for n in others if texts[n]]


def timeseries(rows: DataFrame, metric: str | None = None, segment: str | None = None, dimensions: Sequence[str] | None = None) -> DataFrame:
    """Long series from long, single-value or wide rows; text columns become dimensions in a map."""
    rows = lower_names(rows)
    dims = list(dimensions) if dimensions is not None else dimension_columns(rows)
    extra = F.create_map(*[x for d in dims for x in (F.lit(d), or_null(F.col(d)))]) if dims else F.create_map().cast("map<string,string>")
    own = pick(rows, ("segment",), segment) if segment is not None else pick(rows, ("segment",))
    base = rows.withColumns({"_date": iso_date(pick(rows, ("date", "day"))), "_segment": own, "_dims": extra})
    if "metric" in rows.columns and "value" in rows.columns:
        series, value, source = F.col("metric"), parse_number(F.col("value")), base
    elif "value" in rows.columns:
        if metric is None:
            raise ValueError("a single-value series needs a metric name")
        series, value, source = F.lit(metric), parse_number(F.col("value")), base
    else:
        names = [n for n in rows.columns if n not in _RESERVED and n not in dims]
        source = base.select("_date", "_segment", "_dims", *[parse_number(F.col(n)).alias(n) for n in names]).unpivot(
            ["_date", "_segment", "_dims"], names, "_series", "_value"
        )
        series, value = F.col("_series"), F.col("_value")
    return source.select(F.col("_date").alias("date"), series.alias("series"), value.alias("value"), F.col("_segment").alias("segment"), F.col("_dims").alias("dims"))


def crawl(rows: DataFrame) -> DataFrame:
    rows = lower_names(rows)
    whole = lambda *names: parse_number(pick(rows, names)).cast("int")
    return rows.select(
        pick(rows, ("url", "address")).alias("url"),
        whole("status", "status_code", "http_status").alias("status"),
        pick(rows, ("redirect_to", "redirect_url", "location")).alias("redirect_to"),
        F.coalesce(whole("redirect_hops", "redirect_chain_length", "hops"), F.lit(0)).alias("redirect_hops"),
        pick(rows, ("canonical", "canonical_url", "canonical_link_element_1")).alias("canonical"),
        pick(rows, ("title", "title_1")).alias("title"),
        pick(rows, ("meta_description", "description", "meta_description_1")).alias("meta_description"),
        pick(rows, ("robots", "meta_robots", "meta_robots_1")).alias("robots"),
        parse_flag(pick(rows, ("in_sitemap", "sitemap"))).alias("in_sitemap"),
        whole("inlinks", "internal_inlinks", "unique_inlinks").alias("inlinks"),
        whole("structured_data_errors", "schema_errors").alias("structured_data_errors"),
    )


def cwv(rows: DataFrame) -> DataFrame:
    rows = lower_names(rows)
    number = lambda *names: parse_number(pick(rows, names))
    return rows.select(
        pick(rows, ("url", "origin", "page")).alias("url"),
        F.lower(pick(rows, ("form_factor", "device"), "phone")).alias("form_factor"),
        number("lcp_p75_ms", "lcp_ms", "lcp").alias("lcp_p75_ms"),
        number("inp_p75_ms", "inp_ms", "inp").alias("inp_p75_ms"),
        number("cls_p75", "cls").alias("cls_p75"),
        iso_date(pick(rows, ("date", "observed_at", "collection_period_end"))).alias("date"),
    )


def indexation(rows: DataFrame) -> DataFrame:
    rows = lower_names(rows)
    raw = F.coalesce(pick(rows, ("verdict", "coverage_state", "status", "coverage", "reason")), F.lit(""))
    return rows.select(
        pick(rows, ("url", "page")).alias("url"),
        index_verdict(raw).alias("verdict"),
        raw.alias("coverage_state"),
        pick(rows, ("google_canonical", "google-selected_canonical")).alias("google_canonical"),
        pick(rows, ("user_canonical", "user-declared_canonical")).alias("user_canonical"),
        parse_timestamp(pick(rows, ("last_crawl", "last_crawl_time", "last_crawled"))).alias("last_crawl"),
        parse_flag(pick(rows, ("in_sitemap", "sitemap"))).alias("in_sitemap"),
    )


def behavior(blocks: DataFrame) -> DataFrame:
    """Behaviour rows per url and device from metric blocks.

    ``blocks`` has metric_name, url, device, sessions, scroll_depth, active_time and pct as text,
    one row per block entry; of repeated entries the greatest value counts.
    """
    name = F.regexp_replace(F.lower("metric_name"), "[^a-z]", "")
    number = lambda where, column: F.max(F.when(name == where, parse_number(F.col(column))))
    return blocks.groupBy(
        F.coalesce("url", F.lit("all")).alias("url"), F.lower(F.coalesce("device", F.lit("all"))).alias("device")
    ).agg(
        number("traffic", "sessions").cast("bigint").alias("sessions"),
        *[number(block, "pct").alias(column) for block, column in BEHAVIOR_BLOCKS.items()],
        number("scrolldepth", "scroll_depth").alias("scroll_depth_pct"),
        number("engagementtime", "active_time").alias("active_time_s"),
    )


BEHAVIOR_JSON = (
    "struct<metricName:string,information:array<struct<URL:string,Url:string,Device:string,totalSessionCount:string,"
    "averageScrollDepth:string,activeTime:string,sessionsWithMetricPercentage:string>>>"
)


def behavior_blocks(parsed: DataFrame) -> DataFrame:
    """Block entries from parsed responses (``metricName``, ``information``)."""
    entry = F.col("i")
    return parsed.select("metricName", F.explode("information").alias("i")).select(
        F.col("metricName").alias("metric_name"), F.coalesce(entry["URL"], entry["Url"]).alias("url"), entry["Device"].alias("device"),
        entry["totalSessionCount"].alias("sessions"), entry["averageScrollDepth"].alias("scroll_depth"),
        entry["activeTime"].alias("active_time"), entry["sessionsWithMetricPercentage"].alias("pct"),
    )


# ---- saved API responses ---------------------------------------------------


def report_rows(rows: DataFrame, dimensions: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Analytics report rows: dimension and metric values by position; an eight-digit date gets its dashes."""
    value = lambda array, i: F.try_element_at(F.col(array), F.lit(i + 1))["value"]
    columns = []
    for i, name in enumerate(dimensions):
        cell = value("dimensionValues", i)
        columns.append((F.regexp_replace(cell, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3") if name == "date" else cell).alias(name))
    return rows.select(*columns, *[value("metricValues", i).alias(name) for i, name in enumerate(metrics)])


def inspection_rows(responses: DataFrame, text: str = "response") -> DataFrame:
    """Index states from saved URL inspection responses (columns url and the response text)."""
    field = lambda name: F.coalesce(F.get_json_object(text, f"$.inspectionResult.indexStatusResult.{name}"), F.lit(""))
    return responses.select(
        "url", field("coverageState").alias("coverage_state"), field("googleCanonical").alias("google_canonical"),
        field("userCanonical").alias("user_canonical"), field("lastCrawlTime").alias("last_crawl"),
    )


def pagespeed_rows(responses: DataFrame, text: str = "response") -> DataFrame:
    """Page-speed percentiles from saved responses (url, fetched_on and the response text); layout shift comes times 100."""
    field = lambda name: F.get_json_object(text, f"$.loadingExperience.metrics.{name}.percentile").try_cast("double")
    return responses.select(
        "url", F.lit("phone").alias("form_factor"), field("LARGEST_CONTENTFUL_PAINT_MS").alias("lcp_p75_ms"),
        field("INTERACTION_TO_NEXT_PAINT").alias("inp_p75_ms"), (field("CUMULATIVE_LAYOUT_SHIFT_SCORE") / 100).alias("cls_p75"), F.col("fetched_on").alias("date"),
    )
