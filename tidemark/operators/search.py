"""Search analytics: totals, curves, opportunities, movement and rankings."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import movement
from ..functions.numbers import or_null, round_half_up
from ..functions.stats import below_expected_z, curve_struct, interpolate, p_below, p_two_sided, rate_z
from ..functions.urls import page_key
from ..settings import DEFAULT_SETTINGS, SearchSettings
from .fdr import fdr_keep

_SUMS = ("clicks", "impressions", "missing", "pc", "pi", "pw", "ps")


def _sums(where: Column | None = None, prefix: str = "") -> list[Column]:
    """Additive parts of the search totals, for the rows that meet a condition."""

    def pick(value: Column) -> Column:
        return value if where is None else F.when(where, value)

    clicks, impressions, position = F.col("clicks"), F.col("impressions"), F.col("position")
    paired = clicks.isNotNull() & impressions.isNotNull()
    seen = F.when(position.isNotNull(), F.coalesce(impressions, F.lit(0)))
    absent = clicks.isNull().cast("bigint") + impressions.isNull().cast("bigint")
    parts = (
        F.coalesce(F.sum(pick(clicks)), F.lit(0)),
        F.coalesce(F.sum(pick(impressions)), F.lit(0)),
        F.coalesce(F.sum(pick(absent)), F.lit(0)),
        F.sum(pick(F.when(paired, clicks))),
        F.sum(pick(F.when(paired, impressions))),
        F.sum(pick(seen)),
        F.sum(pick(position * seen)),
    )
    return [part.alias(prefix + name) for name, part in zip(_SUMS, parts)]


def _totals(prefix: str = "") -> list[Column]:
    """Search totals from the additive parts; CTR has 3 digits, position 2."""
    col = lambda name: F.col(prefix + name)
    ctr = F.when(col("pi") > 0, round_half_up(col("pc").cast("double") / col("pi").cast("double") * 100, 3))
    position = F.when(col("pw") > 0, round_half_up(col("ps").cast("double") / col("pw").cast("double"), 2))
    return [
        col("clicks"),
        col("impressions"),
        col("missing"),
        ctr.alias(prefix + "ctr_pct"),
        position.alias(prefix + "avg_position"),
    ]


def with_dimensions(rows: DataFrame, dimensions: Sequence[str], normalize: bool = True) -> DataFrame:
    """Page as its key, an empty dimension as missing."""
    for name in dimensions:
        column = page_key(F.col(name)) if name == "page" and normalize else or_null(F.col(name))
        rows = rows.withColumn(name, column)
    return rows


def search_totals(rows: DataFrame) -> DataFrame:
    """One row of totals: clicks, impressions, missing cells, CTR and average position."""
    return rows.agg(*_sums()).select(*_totals())


def headline_totals(rows: DataFrame, safe: str = "headline_safe") -> DataFrame:
    """Totals plus whether every contributing pull was an aggregate one."""
    summed = rows.agg(F.coalesce(F.bool_and(safe), F.lit(True)).alias("headline_safe"), *_sums())
    return summed.select("headline_safe", *_totals())


def rollup(rows: DataFrame, dimensions: Sequence[str], normalize: bool = True) -> DataFrame:
    """Totals grouped by a list of dimensions."""
    return with_dimensions(rows, dimensions, normalize).groupBy(*dimensions).agg(*_sums()).select(*dimensions, *_totals())


def rollup_sets(rows: DataFrame, sets: Sequence[Sequence[str]], normalize: bool = True) -> DataFrame:
    """Totals for several dimension lists in one pass; ``grain`` names the list."""
    names = list(dict.fromkeys(name for group in sets for name in group))
    prepared = with_dimensions(rows, names, normalize)
    cube = prepared.groupingSets([[F.col(n) for n in group] for group in sets], *names)
    grain = F.concat_ws(",", *[F.when(F.col(f"_g_{n}") == 0, F.lit(n)) for n in names])
    summed = cube.agg(*_sums(), *[F.grouping(n).alias(f"_g_{n}") for n in names])
    return summed.select(grain.alias("grain"), *names, *_totals())


# ---- expected click-through rate -------------------------------------------


def position_buckets(pairs: DataFrame, by: Sequence[str] = (), max_position: int = 20) -> DataFrame:
    """Clicks, impressions and rows per rounded position, from query and page totals."""
    position = F.greatest(F.lit(1), F.floor(F.col("avg_position") + 0.5)).cast("int")
    usable = pairs.where(F.col("avg_position").isNotNull() & (F.col("impressions") > 0))
    placed = usable.withColumn("position_bucket", position).where(F.col("position_bucket") <= max_position)
    return placed.groupBy(*by, "position_bucket").agg(
        F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.count(F.lit(1)).alias("rows")
    )


def fit_ctr_curve(
    rows: DataFrame,
    settings: SearchSettings = DEFAULT_SETTINGS,
    by: Sequence[str] = (),
    min_impressions: int = 500,
    min_rows: int = 5,
    max_position: int = 20,
    normalize: bool = True,
) -> DataFrame:
    """Non-increasing CTR by position, fitted per ``by`` group from query and page rows.

    Thin positions take the heuristic value with a small weight. The pooled
    fit is written in its closed form: the least, over starts up to i, of the
    greatest weighted mean of a stretch from there to an end at or after i.
    A group has ``max_position`` values, so it is evaluated inside one row.
    """
    by = list(by)
    pairs = rollup(rows.where(F.col("query") != ""), [*by, "query", "page"], normalize)
    buckets = position_buckets(pairs, by, max_position)
    enough = (F.col("impressions") >= min_impressions) & (F.col("rows") >= min_rows)
    fitted = F.map_from_entries(
        F.collect_list(
            F.when(
                enough,
                F.struct(
                    "position_bucket",
                    F.struct(
                        (F.col("clicks").cast("double") / F.col("impressions").cast("double") * 100).alias("ctr"),
                        F.col("impressions").cast("double").alias("w"),
                    ),
                ),
            )
        )
    )
    group = buckets.groupBy(*by).agg(fitted.alias("fit"))
    heuristic = curve_struct(settings.curve)
    points = F.transform(
        F.sequence(F.lit(1), F.lit(max_position)),
        lambda i: F.coalesce(
            F.try_element_at(F.col("fit"), i),
            F.struct(interpolate(i, heuristic).alias("ctr"), F.lit(min_impressions / 10.0).alias("w")),
        ),
    )

    def mean(s: Column, t: Column) -> Column:
        part = F.slice("points", s, t - s + 1)
        top = F.aggregate(part, F.lit(0.0), lambda acc, x: acc + x["ctr"] * x["w"])
        return top / F.aggregate(part, F.lit(0.0), lambda acc, x: acc + x["w"])

    pooled = F.transform(
        F.sequence(F.lit(1), F.lit(max_position)),
        lambda i: F.array_min(
            F.transform(
                F.sequence(F.lit(1), i),
                lambda s: F.array_max(F.transform(F.sequence(i, F.lit(max_position)), lambda t: mean(s, t))),
            )
        ),
    )
    count = F.size("fit")
    tail = F.least(F.element_at("ys", -1), interpolate(F.lit(30.0), heuristic))
    xs = [float(x) for x in range(1, max_position + 1)] + [30.0]
    return (
        group.withColumn("points", points)
        .withColumn("ys", F.transform(pooled, lambda y: round_half_up(y, 3)))
        .select(
            *by,
            F.struct(
                F.array(*[F.lit(x) for x in xs]).alias("xs"), F.concat(F.col("ys"), F.array(tail)).alias("ys")
            ).alias("curve"),
            F.when(count == 0, "heuristic").when(count >= 8, "fitted").otherwise("mixed").alias("source"),
            count.alias("fitted_buckets"),
        )
    )


def curve_points(curves: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The knots of fitted curves as rows: position, ctr_pct, source and fitted_buckets."""
    knots = F.inline(F.arrays_zip(F.col("curve.xs").alias("position"), F.col("curve.ys").alias("ctr_pct")))
    return curves.select(*by, "source", "fitted_buckets", knots)


def with_curve(rows: DataFrame, curves: DataFrame | None, settings: SearchSettings, by: Sequence[str] = ()) -> DataFrame:
    """Add each row's expected-CTR curve: configured, the one fitted curve, or its group's."""
    if curves is None:
        return rows.withColumn("_curve", curve_struct(settings.curve))
    if by:
        return rows.join(curves.select(*by, F.col("curve").alias("_curve")), list(by), "left")
    # one fitted curve, one row by construction
    one = F.broadcast(curves.select(F.col("curve").alias("_curve")))
    return rows.join(one, F.col("avg_position") >= F.element_at("_curve.xs", 1) - 1, "left")


def _per_28_days(value: Column, days: int | None) -> Column:
    return value * 28 / F.lit(days) if days else value


def ctr_opportunities(
    rows: DataFrame,
    settings: SearchSettings = DEFAULT_SETTINGS,
    dimensions: Sequence[str] = ("query", "page"),
    curves: DataFrame | None = None,
    days: int | None = None,
    q: float = 0.1,
    by: Sequence[str] = (),
    normalize: bool = True,
) -> DataFrame:
    """Many impressions, position within reach, CTR significantly below the expected one."""
    totals = rollup(rows, dimensions, normalize).where(
        (F.col("impressions") >= settings["high_impressions"])
        & F.col("avg_position").between(1, settings["quick_win_position_max"])
    )
    expected = round_half_up(interpolate(F.col("avg_position"), F.col("_curve")), 2)
    candidates = (
        with_curve(totals, curves, settings, by)
        .withColumn("expected_ctr_pct", expected)
        .drop("_curve")
        .where(F.col("ctr_pct") < F.col("expected_ctr_pct") * settings["ctr_gap_ratio"])
        .withColumn("_p", p_below(below_expected_z(F.col("clicks"), F.col("impressions"), F.col("expected_ctr_pct") / 100)))
    )
    gap = F.col("expected_ctr_pct") - F.col("ctr_pct")
    return (
        fdr_keep(candidates, "_p", q, by)
        .where("keep")
        .select(
            *dimensions,
            *(name for name in by if name not in dimensions),
            "clicks",
            "impressions",
            "ctr_pct",
            "avg_position",
            "expected_ctr_pct",
            round_half_up(F.col("_p"), 6).alias("p_value"),
            round_half_up(gap, 2).alias("ctr_gap_pct_points"),
            round_half_up(_per_28_days(F.col("impressions") * gap / 100, days), 1).alias("estimated_click_gain_28d"),
        )
    )


def striking_distance(
    rows: DataFrame,
    settings: SearchSettings = DEFAULT_SETTINGS,
    dimensions: Sequence[str] = ("query", "page"),
    curves: DataFrame | None = None,
    days: int | None = None,
    by: Sequence[str] = (),
    normalize: bool = True,
) -> DataFrame:
    """Positions 4 to 15 and 15 to 30 with the hypothetical clicks at position 3.

    A row at exactly the shared border belongs to the first band only, unless
    the bands are configured to overlap.
    """
    position = F.col("avg_position")
    totals = rollup(rows, dimensions, normalize).where((F.col("impressions") >= settings["min_impressions"]) & position.isNotNull())
    reach = interpolate(F.lit(3.0), F.col("_curve")) - F.coalesce(F.col("ctr_pct"), F.lit(0.0))
    upside = F.greatest(F.lit(0.0), _per_28_days(F.col("impressions") * reach / 100, days))
    near = position.between(settings["quick_win_position_min"], settings["quick_win_position_max"])
    far = (position > settings["striking_distance_min"]) & (position <= settings["striking_distance_max"])
    bands = F.array_compact(F.array(F.when(near, F.lit("positions_4_15")), F.when(far, F.lit("positions_15_30"))))
    return (
        with_curve(totals, curves, settings, by)
        .withColumn("upside_if_top3_28d", round_half_up(upside, 1))
        .withColumn("band", F.explode(bands))
        .select("band", *dimensions, "clicks", "impressions", "ctr_pct", "avg_position", "upside_if_top3_28d")
    )


def cannibalization(
    rows: DataFrame,
    settings: SearchSettings = DEFAULT_SETTINGS,
    segment_key: str | None = None,
    normalize: bool = True,
    shards: int = 32,
) -> DataFrame:
    """Queries for which two or more pages hold a material share of the impressions.

    A page with a tenth of a query's impressions also has at least a tenth of
    its shard's, so each shard hands on at most ten pages and its total. The
    second step therefore collects a bounded list, however many pages a query has.
    """
    keys = [segment_key, "query"] if segment_key else ["query"]
    share, floor = settings["cannibalization_min_share"], settings["cannibalization_min_impressions"]
    pages = rollup(rows.where((F.col("query") != "") & (F.col("page") != "")), [*keys, "page"], normalize)
    sharded = pages.withColumn("_shard", F.pmod(F.xxhash64("page"), F.lit(shards)))
    part = Window.partitionBy(*keys, "_shard")
    total = F.sum("impressions").over(part)
    first = F.row_number().over(part.orderBy(F.desc("impressions"), "page")) == 1
    entry = F.struct("avg_position", "page", "impressions", "clicks", "ctr_pct")
    kept = sharded.select(
        *keys,
        F.when(first, total).alias("_total"),
        F.when(F.col("impressions") >= F.lit(share) * total, entry).alias("_page"),
        first.alias("_first"),
    ).where(F.col("_page").isNotNull() | F.col("_first"))
    # a zero-impression shard passes every page; none of them can reach the share of a non-zero query
    kept = kept.withColumn("_page", F.when(F.col("_page.impressions") > 0, F.col("_page")))
    grouped = kept.groupBy(*keys).agg(F.sum("_total").alias("query_impressions"), F.collect_list("_page").alias("_pages"))
    holds = F.filter(
        "_pages",
        lambda x: (x["impressions"] / F.col("query_impressions") >= share)
        & (x["avg_position"] <= settings["cannibalization_max_position"]),
    )
    found = (
        grouped.where(F.col("query_impressions") >= floor)
        .withColumn("urls", F.array_sort(holds))
        .where(F.size("urls") >= 2)
        .drop("_pages")
    )
    others = F.slice("urls", F.lit(2), F.size("urls"))
    contested = F.aggregate(others, F.lit(0).cast("bigint"), lambda acc, x: acc + x["impressions"])
    return found.withColumn("contested_impressions", contested)


def cannibalization_urls(findings: DataFrame, segment_key: str | None = None) -> DataFrame:
    """One row per competing page: rank by position, share of the query's impressions."""
    keys = [segment_key, "query"] if segment_key else ["query"]
    listed = findings.select(*keys, "query_impressions", "contested_impressions", F.posexplode("urls").alias("rank", "u"))
    share = round_half_up(F.col("u.impressions") / F.col("query_impressions") * 100, 1)
    return listed.select(
        *keys,
        "query_impressions",
        "contested_impressions",
        (F.col("rank") + 1).alias("rank"),
        F.col("u.page").alias("page"),
        F.col("u.impressions").alias("impressions"),
        share.alias("share_pct"),
        F.col("u.avg_position").alias("avg_position"),
        F.col("u.clicks").alias("clicks"),
    )


# ---- movement between two windows ------------------------------------------


def period_movement(
    rows: DataFrame,
    before: tuple[str, str],
    after: tuple[str, str],
    dimensions: Sequence[str] = ("query",),
    normalize: bool = True,
) -> DataFrame:
    """Both windows side by side per key, with deltas, p-value and movement class.

    Both windows are read in one pass and grouped once, so there is no join;
    a key seen in one window only is ``new`` or ``lost``.
    """
    day = F.col("date")
    in_before, in_after = (day.between(F.lit(w[0]).cast("date"), F.lit(w[1]).cast("date")) for w in (before, after))
    span = with_dimensions(rows.where(in_before | in_after), dimensions, normalize)
    labelled = span.groupBy(*dimensions).agg(
        *_sums(in_before, "b_"),
        *_sums(in_after, "a_"),
        F.count_if(in_before).alias("b_rows"),
        F.count_if(in_after).alias("a_rows"),
    )
    return movement_from_sums(labelled, dimensions, window_days(before), window_days(after))


def snapshot_movement(
    before_rows: DataFrame,
    after_rows: DataFrame,
    dimensions: Sequence[str],
    before_days: int = 28,
    after_days: int = 28,
    normalize: bool = True,
) -> DataFrame:
    """The same for two row sets without dates, such as two undated pulls."""
    columns = [*dimensions, "clicks", "impressions", "position"]
    both = before_rows.select(*columns, F.lit(True).alias("_old")).unionByName(
        after_rows.select(*columns, F.lit(False).alias("_old"))
    )
    labelled = with_dimensions(both, dimensions, normalize).groupBy(*dimensions).agg(
        *_sums(F.col("_old"), "b_"),
        *_sums(~F.col("_old"), "a_"),
        F.count_if("_old").alias("b_rows"),
        F.count_if(~F.col("_old")).alias("a_rows"),
    )
    return movement_from_sums(labelled, dimensions, before_days, after_days)


def window_days(window: tuple[str, str]) -> int:
    """Days of a fixed window, both ends counted."""
    return (date.fromisoformat(window[1]) - date.fromisoformat(window[0])).days + 1


def movement_from_sums(labelled: DataFrame, dimensions: Sequence[str], before_days: int, after_days: int) -> DataFrame:
    """Movement from the additive parts of both windows (``b_`` and ``a_`` columns)."""
    totals = labelled.select(*dimensions, "b_rows", "a_rows", *_totals("b_"), *_totals("a_"))
    scale = F.lit(before_days / after_days if before_days != after_days else 1.0)
    matched = (F.col("b_rows") > 0) & (F.col("a_rows") > 0)
    clicks_after = F.col("a_clicks") * scale
    position_delta = round_half_up(F.col("a_avg_position") - F.col("b_avg_position"), 2)
    ctr_delta = round_half_up(F.col("a_ctr_pct") - F.col("b_ctr_pct"), 2)
    z = rate_z(F.col("b_clicks"), F.lit(before_days), F.col("a_clicks"), F.lit(after_days))
    return totals.select(
        *dimensions,
        F.when(F.col("b_rows") == 0, "new")
        .when(F.col("a_rows") == 0, "lost")
        .otherwise(movement(position_delta, F.col("b_clicks"), clicks_after, ctr_delta))
        .alias("movement"),
        *[
            F.when(F.col(side + "rows") > 0, F.col(side + name)).alias(label + name)
            for side, label in (("b_", "before_"), ("a_", "after_"))
            for name in ("clicks", "impressions", "ctr_pct", "avg_position")
        ],
        F.when(matched, round_half_up(p_two_sided(z), 6)).alias("p_value"),
        F.when(matched, position_delta).alias("position_delta"),
        F.when(matched, round_half_up(clicks_after - F.col("b_clicks"), 1)).alias("clicks_delta"),
        F.when(matched, round_half_up(F.col("a_impressions") * scale - F.col("b_impressions"), 1)).alias("impressions_delta"),
        F.when(matched, ctr_delta).alias("ctr_delta_pp"),
    )


def movement_summary(moves: DataFrame) -> DataFrame:
    """Number of keys per movement class."""
    return moves.groupBy("movement").agg(F.count(F.lit(1)).alias("n"))


def new_and_lost(moves: DataFrame, dimensions: Sequence[str], limit: int = 10) -> DataFrame:
    """The largest new and lost keys by impressions."""
    impressions = F.coalesce("after_impressions", "before_impressions")
    order = Window.partitionBy("movement").orderBy(F.desc("impressions"), *dimensions)
    ends = moves.where(F.col("movement").isin("new", "lost")).withColumn("impressions", impressions)
    return ends.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def winners_and_decliners(
    moves: DataFrame, dimensions: Sequence[str], limit: int = 10, min_clicks: int = 5, q: float = 0.1
) -> DataFrame:
    """The largest significant click gains and losses, ``limit`` of each."""
    matched = moves.where(~F.col("movement").isin("new", "lost"))
    tested = matched.where(F.greatest("before_clicks", "after_clicks") >= min_clicks)
    kept = fdr_keep(tested, "p_value", q).where("keep").where(F.col("clicks_delta") != 0)
    sided = kept.withColumn("side", F.when(F.col("clicks_delta") > 0, "winning").otherwise("declining"))
    order = Window.partitionBy("side").orderBy(F.desc(F.abs("clicks_delta")), *dimensions)
    ranked = sided.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return ranked.select(
        "side", "rank", *dimensions, "movement", "before_clicks", "after_clicks", "clicks_delta", "p_value"
    )


def movement_test_counts(moves: DataFrame, min_clicks: int = 5, q: float = 0.1) -> DataFrame:
    """How many changes were tested and how many survive."""
    matched = moves.where(~F.col("movement").isin("new", "lost"))
    tested = matched.where(F.greatest("before_clicks", "after_clicks") >= min_clicks)
    return fdr_keep(tested, "p_value", q).agg(
        F.count(F.lit(1)).alias("tested"), F.count_if("keep").alias("significant")
    )


def content_decay(
    moves: DataFrame,
    dimensions: Sequence[str] = ("page",),
    settings: SearchSettings = DEFAULT_SETTINGS,
    before_days: int = 28,
    q: float = 0.1,
) -> DataFrame:
    """Keys whose clicks fell by the decline threshold, significant after false-discovery control."""
    change = round_half_up(F.col("clicks_delta") / F.col("before_clicks") * 100, 1)
    candidates = (
        moves.where(F.col("movement").isin("slipping", "dropped", "stable", "improved"))
        .where(F.col("before_clicks") >= settings["min_clicks_for_decline"])
        .withColumn("clicks_change_pct", change)
        .where(F.col("clicks_change_pct") <= -settings["decline_pct"])
    )
    loss = round_half_up(-F.col("clicks_delta") * 28 / F.lit(before_days), 1)
    return fdr_keep(candidates, "p_value", q).where("keep").select(
        *dimensions,
        "movement",
        "before_clicks",
        "after_clicks",
        "clicks_delta",
        "clicks_change_pct",
        "p_value",
        loss.alias("estimated_click_loss_28d"),
    )


# ---- rank tracking ----------------------------------------------------------

RANK_KEY = ("keyword", "location", "device", "engine")


def rank_changes(previous: DataFrame, current: DataFrame, settings: SearchSettings = DEFAULT_SETTINGS) -> DataFrame:
    """Current against previous rank observations; keywords compare without case.

    Both snapshots are grouped once by key. Of several observations of a key
    in one snapshot the latest counts (then the greatest remaining fields).
    """
    seen = F.struct("observed_at", "keyword", "position", "url", "serp_features", "provider").alias("_seen")
    keyed = [F.lower("keyword").alias("_keyword"), *RANK_KEY[1:], seen]
    both = previous.select(*keyed, F.lit(False).alias("_now")).unionByName(current.select(*keyed, F.lit(True).alias("_now")))
    pairs = both.groupBy("_keyword", *RANK_KEY[1:]).agg(
        F.max(F.when(~F.col("_now"), F.col("_seen"))).alias("was"), F.max(F.when(F.col("_now"), F.col("_seen"))).alias("now")
    )
    old, new = F.col("was.position"), F.col("now.position")
    delta = round_half_up((new - old).cast("double"), 1)
    had, has = F.col("was").isNotNull(), F.col("now").isNotNull()
    move = (
        F.when(~has, "not_observed")
        .when(old.isNull() & new.isNull(), "not_ranking")
        .when(old.isNull(), "new")
        .when(new.isNull(), "lost")
        .otherwise(movement(delta, F.lit(0), F.lit(0), F.lit(None).cast("double")))
    )
    none = F.array().cast("array<string>")
    before_features = F.coalesce("was.serp_features", none)
    after_features = F.coalesce("now.serp_features", none)
    switched = had & has & (page_key(F.col("was.url")) != page_key(F.col("now.url")))
    return pairs.select(
        F.coalesce("now.keyword", "was.keyword").alias("keyword"),
        *RANK_KEY[1:],
        old.alias("previous_position"),
        new.alias("current_position"),
        F.col("was.url").alias("previous_url"),
        F.col("now.url").alias("current_url"),
        F.col("was.observed_at").alias("previous_observed_at"),
        F.col("now.observed_at").alias("observed_at"),
        F.col("now.provider").alias("provider"),
        move.alias("movement"),
        F.when(has, delta).alias("delta"),
        F.coalesce(switched, F.lit(False)).alias("url_changed"),
        F.when(has, F.array_except(after_features, before_features)).alias("features_added"),
        F.when(has, F.array_except(before_features, after_features)).alias("features_removed"),
        F.coalesce(has & ((move == "lost") | (delta >= settings["ranking_loss_alert"])), F.lit(False)).alias("alert"),
    )


def rank_proxy(
    rows: DataFrame,
    window: tuple[str, str],
    min_impressions: int = 30,
    top_queries: int | None = 100,
    keywords: DataFrame | None = None,
    normalize: bool = True,
) -> DataFrame:
    """Rank-tracker-like rows from dated search rows: average position per query and country.

    ``keywords`` (one column ``keyword``) fixes the set, for a second window;
    otherwise the largest ``top_queries`` by impressions are taken.
    """
    start, end = (F.lit(day).cast("date") for day in window)
    inside = rows.where((F.col("query") != "") & F.col("date").between(start, end))
    device = F.col("device") if "device" in rows.columns else F.lit(None).cast("string")
    page = page_key(F.col("page")) if normalize else or_null(F.col("page"))
    amount = F.coalesce(F.col("impressions"), F.lit(0))
    seen = F.when(F.col("position").isNotNull(), amount)
    by_page = inside.groupBy("query", F.coalesce("country", F.lit("")).alias("country"), page.alias("page")).agg(
        F.sum(amount).alias("impressions"),
        F.sum(seen).alias("_w"),
        F.sum(F.col("position") * seen).alias("_s"),
        F.min(device).alias("device"),
    )
    top_page = F.max(F.when(F.col("page").isNotNull(), F.struct("impressions", F.col("page"))))
    grouped = by_page.groupBy("query", "country").agg(
        F.sum("impressions").alias("impressions"),
        F.sum("_w").alias("_w"),
        F.sum("_s").alias("_s"),
        F.min("device").alias("device"),
        top_page.alias("_top"),
    )
    observed = grouped.where((F.col("impressions") >= min_impressions) & (F.col("_w") > 0)).select(
        F.col("query").alias("keyword"),
        F.when(F.col("country") == "", "all").otherwise(F.col("country")).alias("location"),
        F.coalesce("device", F.lit("all")).alias("device"),
        F.lit("google").alias("engine"),
        round_half_up(F.col("_s").cast("double") / F.col("_w").cast("double"), 1).alias("position"),
        F.coalesce("_top.page", F.lit("")).alias("url"),
        F.array().cast("array<string>").alias("serp_features"),
        F.to_timestamp(F.lit(window[1] + " 23:59:59")).alias("observed_at"),
        F.lit("gsc_avg_position_proxy").alias("provider"),
        "impressions",
    )
    if keywords is not None:
        return observed.join(keywords.select("keyword").distinct(), "keyword", "left_semi")
    if top_queries is None:
        return observed
    return observed.orderBy(F.desc("impressions"), "keyword", "location").limit(top_queries)


# ---- reports ----------------------------------------------------------------


def top_rows(rows: DataFrame, dimension: str, measure: str, limit: int = 10, normalize: bool = True) -> DataFrame:
    """The largest values of a dimension by clicks or impressions."""
    return rollup(rows, [dimension], normalize).orderBy(F.desc(measure), dimension).limit(limit)


def top_pages_since(rows: DataFrame, since: str, limit: int | None = None) -> DataFrame:
    """Pages by clicks from a day on, ties by page; all of them without ``limit``."""
    sums = rows.where(F.col("date") >= F.lit(since).cast("date")).groupBy("page").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"))
    ranked = sums.orderBy(F.desc("clicks"), "page")
    return ranked if limit is None else ranked.limit(limit)


def rank_opportunities(gains: DataFrame, losses: DataFrame) -> DataFrame:
    """CTR gains and decay losses in one list by estimated clicks per 28 days."""
    left = gains.select(
        F.lit("ctr_opportunity").alias("type"),
        F.concat_ws(" → ", "query", "page").alias("subject"),
        F.col("estimated_click_gain_28d").alias("estimated_clicks_28d"),
    )
    right = losses.select(
        F.lit("content_decay").alias("type"),
        F.col("page").alias("subject"),
        F.col("estimated_click_loss_28d").alias("estimated_clicks_28d"),
    )
    return left.unionByName(right).orderBy(F.desc("estimated_clicks_28d"), "type", "subject")


def overview_trend(rows: DataFrame, before: tuple[str, str], after: tuple[str, str]) -> DataFrame:
    """Clicks and impressions per day in both windows, with the change or why there is none."""
    day = F.col("date")
    picks = {label: day.between(F.lit(w[0]).cast("date"), F.lit(w[1]).cast("date")) for label, w in (("b", before), ("a", after))}
    sums = rows.agg(
        *[
            F.coalesce(F.sum(F.when(where, F.col(name))), F.lit(0)).alias(f"{label}_{name}")
            for label, where in picks.items()
            for name in ("clicks", "impressions")
        ]
    )
    lines = F.array(
        *[
            F.struct(F.lit(name).alias("measure"), F.col(f"b_{name}").alias("before_total"), F.col(f"a_{name}").alias("after_total"))
            for name in ("clicks", "impressions")
        ]
    )
    b, a = F.col("before_total") / F.lit(window_days(before)), F.col("after_total") / F.lit(window_days(after))
    note = F.when(b > 0, "compared").when(a > 0, "new").otherwise("no volume")
    return sums.select(F.inline(lines)).select(
        "measure",
        "before_total",
        "after_total",
        round_half_up(b, 1).alias("before_per_day"),
        round_half_up(a, 1).alias("after_per_day"),
        F.when(b > 0, round_half_up((a - b) / b * 100, 1)).alias("change_pct"),
        note.alias("note"),
    )
