"""Append-only ledgers: deduplication, current state, integrity, versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import round_half_up
from ..settings import (
    AGGREGATIONS, CAUSAL_SCALE, DEFAULT_SETTINGS, QUALITY_SCALE, SEARCH_CHANGE_TYPES, STRENGTH_SCALE, SearchSettings,
)

OPEN_STATES = ("open", "awaiting_review", "handed_off")


def record_key(*columns: Column) -> Column:
    """Stable id of a record from its natural key; no counter, so writers never coordinate."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256)


def append_open(new: DataFrame, ledger: DataFrame, key: str = "dedupe_key", open_states: Sequence[str] = OPEN_STATES) -> DataFrame:
    """New records whose key no open record holds; one per key."""
    held = ledger.where(F.col("status").isin(*open_states)).select(key).distinct()
    return new.join(held, key, "left_anti").dropDuplicates([key])


def import_changes(new: DataFrame, changes: DataFrame, since: str | None = None) -> DataFrame:
    """Change rows whose origin_ref no active record holds, optionally live since a day."""
    replaced = changes.select(F.col("supersedes").alias("change_id")).where("change_id IS NOT NULL").distinct()
    active = changes.join(replaced, "change_id", "left_anti").select("origin_ref").where("origin_ref IS NOT NULL").distinct()
    fresh = new.join(active, "origin_ref", "left_anti").dropDuplicates(["origin_ref"])
    return fresh.where(F.to_date("live_at") >= F.lit(since).cast("date")) if since else fresh


def current_status(events: DataFrame, key: str = "record_id") -> DataFrame:
    """Latest status per record from appended status events."""
    return events.groupBy(key).agg(F.max(F.struct("at", "status")).alias("_s"), F.count(F.lit(1)).alias("events")).select(
        key, F.col("_s.status").alias("status"), F.col("_s.at").alias("since"), "events"
    )


def valid_transitions(events: DataFrame, allowed: dict[str, Sequence[str]], kind: str = "kind") -> DataFrame:
    """Status events that their kind of record allows."""
    ok = F.lit(False)
    for name, states in allowed.items():
        ok = ok | ((F.col(kind) == name) & F.col("status").isin(*states))
    return events.where(ok)


def deploy(changes: DataFrame, deployments: DataFrame) -> DataFrame:
    """Superseding records for changes that went live: the live time and a new id, all else kept.

    ``deployments`` has change_id (the current record) and deployed_at;
    a change already live at that time is left out.
    """
    live = changes.join(deployments, "change_id")
    same = (F.col("deploy_status") == "deployed") & F.col("live_at").eqNullSafe(F.col("deployed_at"))
    fresh = live.where(~same)
    names = [n for n in changes.columns if n not in ("change_id", "supersedes", "live_at", "deploy_status", "confirmed")]
    return fresh.select(
        record_key(F.col("change_id"), F.col("deployed_at")).alias("change_id"), F.col("change_id").alias("supersedes"),
        F.col("deployed_at").alias("live_at"), F.lit("deployed").alias("deploy_status"), F.lit(True).alias("confirmed"), *names,
    )


def registry_versions(events: DataFrame, key: str, fields: Sequence[str], definition: Sequence[str], at: str = "at") -> DataFrame:
    """Current registry row per key: the last non-null value of each field, and a version per changed definition."""
    order = Window.partitionBy(key).orderBy(at)
    merged = events.select(
        key, at, *[F.last(f, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(f) for f in fields]
    )
    text = F.to_json(F.struct(*definition))
    stepped = merged.withColumn("_d", text).withColumn("_new", (~F.col("_d").eqNullSafe(F.lag("_d").over(order))).cast("int"))
    return stepped.groupBy(key).agg(F.max(F.struct(at, *fields)).alias("_r"), F.sum("_new").alias("version")).select(key, "_r.*", "version")


def ledger_violations(evidence: DataFrame, changes: DataFrame, metrics: DataFrame) -> DataFrame:
    """Rows that break the ledger's rules; empty when it is sound.

    Levels are known, weak data caps strength, strength caps causality,
    insufficient data carries no delta, and every reference exists.
    """
    rank = lambda column, scale: F.array_position(F.array(*[F.lit(x) for x in scale]), F.col(column)) - 1
    quality, strength, causal = rank("data_quality", QUALITY_SCALE), rank("evidence_strength", STRENGTH_SCALE), rank("causal_confidence", CAUSAL_SCALE)
    poor = F.col("data_quality") == "insufficient"
    linked = F.size(F.coalesce("change_ids", F.array().cast("array<string>"))) > 0
    rules = {
        "unknown_level": (quality < 0) | (strength < 0) | (causal < 0),
        "strength_over_quality": (F.col("evidence_strength") != "insufficient") & (quality > 3 - strength),
        "causality_over_strength": causal > F.greatest(F.lit(0), strength),
        "strength_from_insufficient": poor & (F.col("evidence_strength") != "insufficient"),
        "delta_from_insufficient": poor & F.col("delta_abs").isNotNull(),
        "causality_without_link": (F.col("causal_confidence") != "none") & ~linked & F.col("experiment_id").isNull(),
    }
    broken = F.array_compact(F.array(*[F.when(where, F.lit(name)) for name, where in rules.items()]))
    own = evidence.select("evidence_id", F.explode(broken).alias("violation"), F.lit(None).cast("string").alias("ref"))
    no_metric = evidence.join(metrics.select("metric_id"), "metric_id", "left_anti").select(
        "evidence_id", F.lit("unknown_metric").alias("violation"), F.col("metric_id").alias("ref")
    )
    refs = evidence.select("evidence_id", F.explode("change_ids").alias("change_id"))
    no_change = refs.join(changes.select("change_id"), "change_id", "left_anti").select(
        "evidence_id", F.lit("unknown_change").alias("violation"), F.col("change_id").cast("string").alias("ref")
    )
    older = evidence.where("supersedes IS NOT NULL").select(F.col("evidence_id").alias("_id"), F.col("supersedes").alias("evidence_id"))
    no_older = older.join(evidence.select("evidence_id"), "evidence_id", "left_anti").select(
        F.col("_id").alias("evidence_id"), F.lit("unknown_supersedes").alias("violation"), F.col("evidence_id").alias("ref")
    )
    return own.unionByName(no_metric).unionByName(no_change).unionByName(no_older)


def hash_violations(rows: DataFrame, snapshots: DataFrame, row_hash: Column) -> DataFrame:
    """Pulls whose rows no longer give the recorded hash or count."""
    actual = rows_digest(rows, ["snapshot_id"], row_hash)
    joined = snapshots.select("snapshot_id", "row_count", "rows_hash").join(actual, "snapshot_id", "left")
    changed = ~F.col("digest").eqNullSafe(F.col("rows_hash")) | (F.coalesce("rows", F.lit(0)) != F.col("row_count"))
    return joined.where(changed).select("snapshot_id", "row_count", "rows")


def rows_digest(rows: DataFrame, keys: Sequence[str], row_hash: Column) -> DataFrame:
    """Order-free digest per key from row hashes: count, and sums of the hash's four quarters.

    Sums combine on the map side, so no list of rows is ever collected. A quarter is
    added up as two halves of 32 bits about their middle, which stay in a bigint for
    four billion equal rows and cost far less than decimals; only the sums become decimals.
    """
    middle, names = 1 << 31, [f"_h{i}" for i in range(8)]
    half = lambda i: F.conv(F.substring(row_hash, 1 + 8 * i, 8), 16, 10).cast("bigint") - F.lit(middle)
    summed = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.count(row_hash).alias("_n"), *[F.sum(half(i)).alias(n) for i, n in enumerate(names)])
    total = lambda n: F.col(n).cast("decimal(25,0)") + F.col("_n").cast("decimal(14,0)") * F.lit(middle).cast("decimal(10,0)")
    quarters = [(total(a) * F.lit(1 << 32).cast("decimal(10,0)") + total(b)).cast("string") for a, b in zip(names[::2], names[1::2])]
    return summed.select(*keys, "rows", F.sha2(F.concat_ws(":", "rows", *quarters), 256).alias("digest"))


def dictionary_violations(metrics: DataFrame, sources: DataFrame) -> DataFrame:
    """Metric definitions that cannot be measured."""
    active = F.coalesce("status", F.lit("active")) == "active"
    rules = {
        "unknown_aggregation": ~F.coalesce(F.col("aggregation").isin(*AGGREGATIONS), F.lit(False)),
        "ratio_without_parts": (F.col("aggregation") == "ratio_of_sums") & (F.col("numerator").isNull() | F.col("denominator").isNull()),
        "mean_without_weight": (F.col("aggregation") == "weighted_mean") & F.col("weight").isNull(),
        "active_without_source": active & F.col("canonical_source").isNull(),
        "source_not_registered": active & F.col("canonical_source").isNotNull() & ~F.col("_known"),
    }
    known = metrics.join(
        sources.select(F.col("source_id").alias("canonical_source"), F.lit(True).alias("_known")).distinct(), "canonical_source", "left"
    ).fillna(False, ["_known"])
    broken = F.array_compact(F.array(*[F.when(where, F.lit(name)) for name, where in rules.items()]))
    return known.select("metric_id", F.explode(broken).alias("violation"))


def state_checks(health: DataFrame, anomalies: DataFrame, baselines: DataFrame, changes: DataFrame, now: Column, stale_days: int = 90) -> DataFrame:
    """Maintenance list: sources, open anomalies, stale baselines, pending, unconfirmed and unplaced changes."""
    today = F.to_date(now)
    replaced = changes.select(F.col("supersedes").alias("change_id")).where("change_id IS NOT NULL").distinct()
    live = changes.join(replaced, "change_id", "left_anti")

    def check(frame: DataFrame, area: str, subject: str, status: Column, action: Column) -> DataFrame:
        return frame.select(F.lit(area).alias("area"), F.col(subject).cast("string").alias("subject"), status.alias("status"), action.alias("action"))

    ok = F.col("health") == "ok"
    source = check(
        health, "source", "source_id", F.when(ok, "ok").otherwise("attention"),
        F.when(~ok, F.when(F.col("health") == "stale", "refresh data").otherwise("check access")),
    )
    age = F.datediff(today, F.to_date("detected_at"))
    opened = check(
        anomalies.where("status = 'open'"), "anomaly", "anomaly_id", F.lit("attention"), F.when(age > 14, "resolve or dismiss").otherwise("review")
    )
    old = check(
        baselines.where(F.datediff(today, F.col("period_end")) > stale_days), "baseline", "baseline_id", F.lit("attention"), F.lit("refresh the baseline")
    )
    pending = F.col("deploy_status") == "pending"
    act = (
        F.when(pending, "record the live time")
        .when(F.col("live_at").isNull(), "record the timestamp")
        .when(F.col("confirmed") == F.lit(False), "confirm the time")
    )
    change = check(live.where(act.isNotNull()), "change", "change_id", F.lit("attention"), act)
    return source.unionByName(opened).unionByName(old).unionByName(change)


def cap_findings(findings: DataFrame, settings: SearchSettings = DEFAULT_SETTINGS) -> DataFrame:
    """At most N findings per type go to the ledger, the most material first; the full list stays in the findings."""
    order = Window.partitionBy("type").orderBy(F.desc_nulls_last("gain"), "dedupe_key")
    ranked = findings.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= settings["max_recorded_per_type"])


def exports_state(exports: DataFrame, consumed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exported rows with whether the consumer already holds them."""
    held = consumed.select(*keys, F.lit(True).alias("consumed")).distinct()
    return exports.join(held, list(keys), "left").fillna(False, ["consumed"])


def prune_plan(snapshots: DataFrame, referenced: DataFrame, now: Column, older_than_days: int = 180) -> DataFrame:
    """Pulls that may be pruned: old, not the newest of their source and kind, and not referenced.

    The result doubles as the tombstone rows.
    """
    described = F.coalesce("period_end", F.to_date("retrieved_at"))
    newest = snapshots.groupBy("source_id", "kind").agg(
        F.max(F.struct(described.alias("d"), F.col("snapshot_id").alias("snapshot_id"))).alias("_n")
    ).select(F.col("_n.snapshot_id").alias("snapshot_id"))
    old = snapshots.where(described < F.date_sub(F.to_date(now), older_than_days))
    free = old.join(newest, "snapshot_id", "left_anti").join(referenced.select("snapshot_id").distinct(), "snapshot_id", "left_anti")
    return free.select("snapshot_id", "source_id", "kind", "period_start", "period_end", "row_count", "rows_hash", F.to_date(now).alias("pruned_on"))


def baseline_rows(measured: DataFrame, now: Column) -> DataFrame:
    """Baselines to append: the value is withheld when its data is insufficient.

    ``measured`` has metric_id, source_id, segment, period_start, period_end, value, sample and data_quality.
    """
    key = record_key(*[F.col(c) for c in ("metric_id", "source_id", "segment", "period_start", "period_end")], now)
    withheld = F.when(F.col("data_quality") != "insufficient", round_half_up(F.col("value")))
    return measured.select(
        key.alias("baseline_id"), "metric_id", "source_id", "segment", "period_start", "period_end", withheld.alias("value"),
        F.col("sample").alias("sample_size"), "data_quality", now.alias("recorded_at"),
    )


def evidence_rows(evidence: DataFrame, changes: DataFrame, selected: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Evidence to append, one row per comparison, and the lineage it names: set_id and snapshot_id.

    A row has the changes that its request links, which requests list themselves,
    and the id and number of its contributing pulls; equal sets of pulls are listed once.
    """
    from .provenance import member_sets

    linked = changes.where("relation = 'linked'").groupBy("request_id").agg(F.array_sort(F.collect_set("change_id")).alias("change_ids"))
    sets, lineage = member_sets(selected, ["request_id"], "snapshot_id")
    pulls = sets.select("request_id", F.col("set_id").alias("artifact_set"), F.col("n_members").alias("n_artifacts"))
    joined = evidence.join(linked, "request_id", "left").join(pulls, "request_id", "left")
    key = record_key(F.col("request_id"), F.col("metric_id"), F.col("source_id"), F.col("after_end"), now)
    rows = joined.withColumns(
        {"evidence_id": key, "change_ids": F.coalesce("change_ids", F.array().cast("array<string>")), "n_artifacts": F.coalesce("n_artifacts", F.lit(0)), "recorded_at": now}
    )
    return rows, lineage


def next_action(checks: DataFrame) -> DataFrame:
    """The most pressing of the maintenance checks: access first, then anomalies, stale data, changes, baselines."""
    order = (
        F.when(F.col("action") == "check access", 1).when(F.col("area") == "anomaly", 2).when(F.col("area") == "source", 3)
        .when(F.col("area") == "change", 4).otherwise(5)
    )
    open_checks = checks.where("status = 'attention'").withColumn("_o", order)
    return open_checks.orderBy("_o", "area", "subject").limit(1).drop("_o")


def recent_changes(changes: DataFrame, since: Column, types: Sequence[str] = SEARCH_CHANGE_TYPES) -> DataFrame:
    """Search-related changes that went live since a day."""
    return changes.where(F.col("type").isin(*types) & (F.to_date("live_at") >= since))
