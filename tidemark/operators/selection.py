"""Which rows of which pulls answer a request.

Selection works on headers and on a slice index (distinct pull x day x series
x segment), never on the fact rows. The facts are joined once, at the end.
It is done once per distinct window (source, kind, period and dimensions), so a
million requests over ten windows cost ten selections; headers meet windows
through time buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import page_key
from ..session import cut_lineage
from .intervals import overlap_join

REQUEST = ("request_id", "label")
_SLICE = ("snapshot_id", "date", "series", "segment")


def list_snapshots(snapshots: DataFrame, source_id: str | None = None, kind: str | None = None) -> DataFrame:
    """Headers of a source and kind in retrieval order."""
    chosen = snapshots
    if source_id is not None:
        chosen = chosen.where(F.col("source_id") == source_id)
    if kind is not None:
        chosen = chosen.where(F.col("kind") == kind)
    return chosen.orderBy("retrieved_at", "snapshot_id")


def slice_index(facts: DataFrame) -> DataFrame:
    """Distinct pull x day x series x segment; small, and worth storing beside the facts."""
    return facts.select(
        "snapshot_id", "date", F.coalesce("series", F.lit("")).alias("series"), F.coalesce("segment", F.lit("")).alias("segment")
    ).distinct()


def eligible(dimensions: Column) -> Column:
    """All required dimensions present, none of the excluded ones."""
    has_all = F.size(F.array_except("require", dimensions)) == 0
    return has_all & ~F.arrays_overlap(F.col("exclude"), dimensions)


def candidates(requests: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Requests with every header that may answer them."""
    none = F.array().cast("array<string>")
    headers = snapshots.select(
        "source_id",
        "kind",
        "snapshot_id",
        "retrieved_at",
        F.col("period_start").alias("snapshot_start"),
        F.col("period_end").alias("snapshot_end"),
        F.coalesce("dimensions", none).alias("dimensions"),
        F.to_json(F.array_sort(F.map_entries(F.coalesce("filters", F.create_map().cast("map<string,string>"))))).alias("filters"),
        "headline_safe",
    )
    joined = overlap_join(requests, headers, ["source_id", "kind"], ("period_start", "period_end"), ("snapshot_start", "snapshot_end"))
    fits = eligible(F.col("dimensions"))
    grain = F.array_join(F.array_sort("dimensions"), ",")
    return joined.where(fits).withColumns({"grain": grain, "dated": F.array_contains("dimensions", "date")})


def grain_coverage(dated: DataFrame, slices: DataFrame, keys: Sequence[str] = REQUEST) -> DataFrame:
    """Days each grain covers inside the request, with its newest and first retrieval."""
    keys = list(keys)
    days = dated.select(*keys, "grain", "snapshot_id", "period_start", "period_end").join(
        slices.select("snapshot_id", "date").distinct(), "snapshot_id"
    )
    covered = days.where(F.col("date").between(F.col("period_start"), F.col("period_end"))).select(*keys, "grain", "date").distinct()
    counts = covered.groupBy(*keys, "grain").agg(F.count(F.lit(1)).alias("covered"))
    pulls = dated.groupBy(*keys, "grain").agg(
        F.max("retrieved_at").alias("latest"), F.min(F.struct("retrieved_at", "snapshot_id")).alias("first_seen")
    )
    return pulls.join(counts, [*keys, "grain"], "left").fillna(0, ["covered"])


def choose_grain(coverage: DataFrame, keys: Sequence[str] = REQUEST) -> DataFrame:
    """The grain covering most days; ties go to the newest retrieval, then to the grain seen first."""
    order = Window.partitionBy(*keys).orderBy(F.desc("covered"), F.desc("latest"), "first_seen")
    return coverage.withColumn("_r", F.row_number().over(order)).where(F.col("_r") == 1).drop("_r")


def slice_owners(dated: DataFrame, slices: DataFrame, keys: Sequence[str] = REQUEST) -> DataFrame:
    """Latest pull per day, fixed filters, series and segment.

    An aggregate with map-side combine over the slice index: the last
    retrieved pull owns the slice, and all its rows stay.
    """
    inside = dated.join(slices, "snapshot_id").where(F.col("date").between(F.col("period_start"), F.col("period_end")))
    series = F.when(F.col("kind") == "timeseries", F.col("series")).otherwise("")
    owned = inside.groupBy(*keys, "date", "filters", series.alias("owner_series"), "segment").agg(
        F.max(F.struct("retrieved_at", "snapshot_id")).alias("owner")
    )
    return owned.select(*keys, "date", F.col("owner_series").alias("series"), "segment", F.col("owner.snapshot_id").alias("snapshot_id"))


def with_window(requests: DataFrame) -> DataFrame:
    """``requests`` with ``window_id``, which requests that select alike share."""
    alike = F.struct("source_id", "kind", "period_start", "period_end", F.array_sort("require").alias("require"), F.array_sort("exclude").alias("exclude"))
    return requests.withColumn("window_id", F.sha2(F.to_json(alike, {"ignoreNullFields": "false"}), 256))


def window_slices(windows: DataFrame, snapshots: DataFrame, slices: DataFrame) -> DataFrame:
    """Slices that answer each distinct window: window_id, the slice, grain and expect_daily.

    ``windows`` has window_id, source_id, kind, period_start, period_end,
    require and exclude. ``expect_daily`` is false for an undated pull of exactly
    the period.
    """
    keys = ["window_id"]
    # headers and chosen grains are small and read several times below
    found = cut_lineage(candidates(windows, snapshots))
    dated = found.where("dated")
    best = cut_lineage(choose_grain(grain_coverage(dated, slices, keys), keys))
    chosen = dated.join(best.select(*keys, "grain"), [*keys, "grain"])
    owned = slice_owners(chosen, slices, keys).join(best.select(*keys, "grain"), keys).withColumn("expect_daily", F.lit(True))
    exact = (
        found.join(best.select(*keys), keys, "left_anti")
        .where((F.col("snapshot_start") == F.col("period_start")) & (F.col("snapshot_end") == F.col("period_end")))
        .groupBy(*keys)
        .agg(F.max(F.struct("retrieved_at", "snapshot_id", "grain")).alias("owner"))
        .select(*keys, F.col("owner.snapshot_id").alias("snapshot_id"), F.col("owner.grain").alias("grain"))
    )
    undated = exact.join(slices, "snapshot_id").withColumn("expect_daily", F.lit(False))
    columns = [*keys, *_SLICE, "grain", "expect_daily"]
    return owned.select(*columns).unionByName(undated.select(*columns))


def distinct_windows(asked: DataFrame) -> DataFrame:
    """The windows of requests with window_id, each once."""
    return asked.select("window_id", "source_id", "kind", "period_start", "period_end", "require", "exclude").dropDuplicates(["window_id"])


def select_slices(requests: DataFrame, snapshots: DataFrame, slices: DataFrame) -> DataFrame:
    """Slices that answer each request.

    ``requests`` has request_id, label, source_id, kind, period_start,
    period_end, require, exclude and optionally ``attempt``: of several
    attempts of a request the first with rows counts. Requests that share a
    window share its selection; the result has a row per request and slice, so
    callers with very many requests should join :func:`window_slices` instead.
    """
    if "attempt" not in requests.columns:
        requests = requests.withColumn("attempt", F.lit(0))
    asked = cut_lineage(with_window(requests))
    found = cut_lineage(window_slices(cut_lineage(distinct_windows(asked)), snapshots, slices))
    tried = asked.select(*REQUEST, "attempt", "window_id").distinct()
    first = tried.join(found.select("window_id").distinct(), "window_id").groupBy(*REQUEST).agg(F.min("attempt").alias("attempt"))
    columns = [*REQUEST, "attempt", *_SLICE, "grain", "expect_daily"]
    return tried.join(first, [*REQUEST, "attempt"]).join(found, "window_id").select(*columns)


def selection_notes(requests: DataFrame, snapshots: DataFrame, selected: DataFrame) -> DataFrame:
    """Why a request has no rows: no pull covers it, or only undated pulls of other periods do."""
    empty = requests.select(*REQUEST).distinct().join(selected.select(*REQUEST).distinct(), list(REQUEST), "left_anti")
    asked = with_window(requests)
    seen = candidates(distinct_windows(asked), snapshots).groupBy("window_id").agg(F.bool_or("dated").alias("dated"))
    seen = asked.join(seen, "window_id").groupBy(*REQUEST).agg(F.bool_or("dated").alias("dated"))
    note = F.when(F.col("dated").isNull(), "no snapshot covers this period").when(
        ~F.col("dated"), "only undated snapshots with a different period exist"
    )
    return empty.join(seen, list(REQUEST), "left").select(*REQUEST, note.alias("note"))


def select_rows(facts: DataFrame, selected: DataFrame, keys: Sequence[str] = REQUEST) -> DataFrame:
    """Fact rows of the selected slices, one copy per request that wants them."""
    slices = selected.select(*keys, *_SLICE).withColumnRenamed("date", "_day")
    keyed = facts.withColumns(
        {
            "_series": F.when(F.col("kind") == "timeseries", F.coalesce("series", F.lit(""))).otherwise(""),
            "_segment": F.coalesce("segment", F.lit("")),
        }
    )
    wanted = slices.withColumnsRenamed({"series": "_series", "segment": "_segment"})
    on = (
        (keyed["snapshot_id"] == wanted["snapshot_id"])
        & keyed["date"].eqNullSafe(wanted["_day"])
        & (keyed["_series"] == wanted["_series"])
        & (keyed["_segment"] == wanted["_segment"])
    )
    return keyed.join(wanted, on).select(*keys, *[keyed[c] for c in facts.columns])


def date_filter(rows: DataFrame, start: str | Column, end: str | Column) -> DataFrame:
    """Rows inside the period; undated rows pass."""
    first, last = (F.lit(x).cast("date") if isinstance(x, str) else x for x in (start, end))
    return rows.where(F.col("date").isNull() | F.col("date").between(first, last))


def scope_filter(rows: DataFrame, scope: dict[str, Sequence[str]]) -> DataFrame:
    """Rows whose dimensions are in the scope; an empty list does not restrict, a missing value fails."""
    for name, values in scope.items():
        if values:
            actual, wanted = F.col(name), [F.lit(v) for v in values]
            if name == "page":
                actual, wanted = page_key(actual), [page_key(v) for v in wanted]
            rows = rows.where(actual.isin(*wanted))
    return rows


def scope_join(rows: DataFrame, scopes: DataFrame, dimensions: Sequence[str], keys: Sequence[str] = ("request_id",)) -> DataFrame:
    """Rows for each request whose scope names their dimension values (an equi-join)."""
    exploded = scopes
    for name in dimensions:
        exploded = exploded.withColumn(name, F.explode(F.array_distinct(F.col("scope")[name])))
    return rows.join(exploded.select(*keys, *dimensions).distinct(), list(dimensions))


# ---- latest, supersede and registry lookups -------------------------------


def latest_two(snapshots: DataFrame, by: Sequence[str] = ("source_id", "kind")) -> DataFrame:
    """Current and previous header by the date the data describes, then retrieval."""
    described = F.coalesce("period_end", F.to_date("retrieved_at"))
    order = Window.partitionBy(*by).orderBy(F.desc(described), F.desc("retrieved_at"), F.desc("snapshot_id"))
    ranked = snapshots.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= 2)
    return ranked.withColumn("version", F.when(F.col("_r") == 1, "current").otherwise("previous")).drop("_r")


def latest_snapshot(snapshots: DataFrame, by: Sequence[str] = ("source_id", "kind")) -> DataFrame:
    """Newest header by retrieval."""
    return snapshots.groupBy(*by).agg(F.max(F.struct("retrieved_at", "snapshot_id")).alias("_l")).select(
        *by, F.col("_l.snapshot_id").alias("snapshot_id"), F.col("_l.retrieved_at").alias("retrieved_at")
    )


def first_of_type(sources: DataFrame, order: str = "position") -> DataFrame:
    """Default source per type: the first in registry order."""
    return sources.groupBy("type").agg(F.min_by("source_id", order).alias("source_id"))


def active_records(records: DataFrame, key: str, supersedes: str = "supersedes") -> DataFrame:
    """Records that no other record supersedes."""
    replaced = records.select(F.col(supersedes).alias(key)).where(F.col(key).isNotNull()).distinct()
    return records.join(replaced, key, "left_anti")


def _jumps(records: DataFrame, key: str, supersedes: str) -> DataFrame:
    """from_id, to_id and whether to_id still leads on, after doubling until nothing moves or only cycles do."""
    step = (
        records.where(F.col(supersedes).isNotNull())
        .groupBy(F.col(supersedes).alias("from_id"))
        .agg(F.min(key).alias("to_id"))
    )
    jumps = cut_lineage(step.withColumn("moved", F.lit(True)))
    reach, most = 1, jumps.count()
    while reach <= 2 * most:  # one round more than needed shows what never ends
        further = jumps.select(F.col("from_id").alias("to_id"), F.col("to_id").alias("_next"))
        doubled = jumps.join(further, "to_id", "left")
        jumps = cut_lineage(doubled.select("from_id", F.coalesce("_next", "to_id").alias("to_id"), F.col("_next").isNotNull().alias("moved")))
        reach *= 2
        if jumps.where("moved").isEmpty():
            break
    return jumps


def resolve_chains(records: DataFrame, key: str, supersedes: str = "supersedes") -> DataFrame:
    """Newest record of each record's supersede chain, however long.

    The jump length doubles per round, so a chain of a million takes twenty
    joins. Each round is written to the checkpoint folder; only records that
    have a successor take part. A record whose chain runs into a cycle has no
    newest one: it stands for itself, and :func:`chain_cycles` lists it.
    """
    jumps = _jumps(records, key, supersedes).where("not moved").select(F.col("from_id").alias(key), "to_id")
    ends = records.select(key).distinct().join(jumps, key, "left")
    return ends.select(key, F.coalesce("to_id", key).alias("current_id"))


def chain_cycles(records: DataFrame, key: str, supersedes: str = "supersedes") -> DataFrame:
    """Records whose supersede chain runs into a cycle."""
    return _jumps(records, key, supersedes).where("moved").select(F.col("from_id").alias(key))


def superseded_slices(pairs: DataFrame, slices: Sequence[str], order: str, pull: str) -> DataFrame:
    """Slice and pull combinations that a later pull of the same slice replaces."""
    owners = pairs.groupBy(*[F.col(c).alias(f"_{c}") for c in slices]).agg(F.max(F.struct(order, pull)).alias("_owner"))
    same = F.lit(True)
    for name in slices:
        same = same & F.col(name).eqNullSafe(F.col(f"_{name}"))
    return pairs.join(owners, same).where(F.col(pull) != F.col(f"_owner.{pull}")).select(*slices, pull)


def latest_wins(facts: DataFrame, slices: Sequence[str], order: str, pull: str) -> DataFrame:
    """Keep the rows of the last pull per slice.

    Only the replaced slice and pull pairs are looked up. They are few next to
    the facts, so Spark broadcasts them when they are small enough, and the
    facts then stay where they are; a large list joins with skew handling on.
    """
    pairs = facts.select(*slices, order, pull).distinct()
    replaced = superseded_slices(pairs, slices, order, pull).withColumnsRenamed({c: f"_{c}" for c in (*slices, pull)})
    same = F.col(pull) == F.col(f"_{pull}")
    for name in slices:
        same = same & F.col(name).eqNullSafe(F.col(f"_{name}"))
    return facts.join(replaced, same, "left_anti")
