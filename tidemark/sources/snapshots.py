"""Pulls to append-only snapshots: header, hash, period, freshness, compaction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import row_hash
from ..operators.ledger import rows_digest


def stamp(rows: DataFrame, values: dict[str, str]) -> DataFrame:
    """Fixed filters of a pull on every row."""
    return rows.withColumns({k: F.lit(v) for k, v in values.items()})


def outside_period(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Rows dated outside the declared period (the reject table)."""
    return rows.where(~F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def snapshot_headers(
    rows: DataFrame, now: Column, keys: Sequence[str] = ("snapshot_id", "source_id", "kind"), hashed: Sequence[str] | None = None,
    period: tuple[str, str] | None = None,
) -> DataFrame:
    """One header per pull in one aggregation: period, rows, digest, freshness and warnings.

    Freshness comes from dates in the rows, capped at today; later dates are flagged.
    """
    names = list(hashed) if hashed else [n for n in rows.columns if n not in keys]
    digest = rows_digest(rows, keys, row_hash(*[F.col(n) for n in names]))
    dates = rows.groupBy(*keys).agg(F.min("date").alias("_first"), F.max("date").alias("_last"))
    today = F.to_date(now)
    start, end = (F.lit(d).cast("date") for d in period) if period else (F.col("_first"), F.col("_last"))
    late = F.col("_last") > today
    warnings = F.array_compact(F.array(F.when(late, F.lit("rows are dated after the ingest date"))))
    return digest.join(dates, list(keys)).select(
        *keys, start.alias("period_start"), end.alias("period_end"), F.col("rows").alias("row_count"), F.col("digest").alias("rows_hash"),
        F.least(F.coalesce("_last", end, today), today).alias("data_through"), warnings.alias("warnings"), now.alias("retrieved_at"),
    )


def freshness(headers: DataFrame) -> DataFrame:
    """Latest data date and success per source."""
    return headers.groupBy("source_id").agg(F.max("data_through").alias("data_through"), F.max("retrieved_at").alias("last_success_at"))


def append_facts(facts: DataFrame, path: str) -> None:
    """Append fact rows, partitioned by source and month so that later reads prune."""
    dated = facts.withColumn("month", F.date_format("date", "yyyy-MM"))
    dated.repartition("source_id", "month", F.pmod(F.xxhash64(*facts.columns), F.lit(64))).write.mode("append").partitionBy("source_id", "month").parquet(path)


def append_headers(headers: DataFrame, path: str) -> None:
    headers.write.mode("append").parquet(path)


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def failure_events(failures: DataFrame, now: Column) -> DataFrame:
    """Failed pulls as source events; they make the source unavailable until the next success."""
    from ..functions.text import redacted

    return failures.select("source_id", F.lit("error").alias("event"), redacted(F.col("message")).alias("last_error"), now.alias("at"))


def compact_facts(facts: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Facts without the pruned pulls, ready to be rewritten into fewer files."""
    return facts.join(tombstones.select("snapshot_id"), "snapshot_id", "left_anti")
