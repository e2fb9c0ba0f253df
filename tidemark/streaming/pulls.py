"""Ingest laid out for pruning, and daily pulls in which late rows restate closed days.

One streaming job writes, for each batch, under one root:

* ``facts``: the rows, by source, month and batch;
* ``index``: the slice index of the batch (pull x day x series with rows and an order-free digest), laid out alike;
* ``headers``: one header per pull;
* ``progress``: the newest time seen per source, so the next batch reads one small folder;
* ``days``: daily pulls, by source, month and batch.

Every write replaces only the partitions of its own batch, so a batch that runs
again adds nothing. A day is closed when the newest time has passed it by the
lateness limit; its value is then pulled once. Rows behind that limit are kept as
facts too, and their days and series are pulled again from the facts, which Spark
prunes to the months concerned. The later pull owns the slice, so a restated day
equals what a batch over all rows would give, repeated events included.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.text import row_hash
from ..operators.ledger import rows_digest
from ..session import cut_lineage
from ..sources.snapshots import snapshot_headers

PARTITIONS = ("source_id", "month", "batch")
#: Slices to pull again that are broadcast, so that the scan of the facts is pruned while it runs; more are joined by a shuffle.
SMALL_SLICES = 200_000
#: Writers of one source and month in one batch.
MONTH_WRITERS = 16


def replace_partitions(rows: DataFrame, path: str) -> None:
    """Write ``rows``, replacing only the partitions that they have."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path)


def _month(date: str = "date") -> Column:
    return F.date_format(date, "yyyy-MM").alias("month")


def _read(spark: SparkSession, path: str, source_id: str | None, months: Sequence[str] | None) -> DataFrame:
    # names such as 2024-01 and 007 are text
    rows = spark.read.option("basePath", path).parquet(path)
    rows = rows.withColumns({"source_id": F.col("source_id").cast("string"), "month": F.col("month").cast("string")})
    if source_id is not None:
        rows = rows.where(F.col("source_id") == source_id)
    return rows.where(F.col("month").isin(*months)) if months is not None else rows


def read_facts(spark: SparkSession, root: str, source_id: str | None = None, months: Sequence[str] | None = None) -> DataFrame:
    """The facts of a source and some months; other partitions are not listed for the scan."""
    return _read(spark, f"{root}/facts", source_id, months)


def read_index(spark: SparkSession, root: str, source_id: str | None = None, months: Sequence[str] | None = None) -> DataFrame:
    return _read(spark, f"{root}/index", source_id, months)


def slice_rows(facts: DataFrame, hashed: Sequence[str]) -> DataFrame:
    """Rows and digest of each slice of the facts."""
    keys = ["source_id", "month", "batch", "snapshot_id", "kind", "date", "series"]
    return rows_digest(facts, keys, row_hash(*[F.col(c) for c in hashed]))


def _broadcast_if_small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.limit(SMALL_SLICES + 1).count() <= SMALL_SLICES else rows


def _daily(facts: DataFrame, key: str | None) -> DataFrame:
    unique = facts if key is None else facts.dropDuplicates(["source_id", "series", "date", key])
    return unique.groupBy("source_id", "month", "date", "series").agg(F.sum("value").alias("value"))


def day_pulls(facts: DataFrame, slices: DataFrame, key: str | None) -> DataFrame:
    """Values of the days and series in ``slices`` (source_id, month, date, series and kind) from all facts.

    A closing day is asked for with a null series: all its series count.
    """
    whole = slices.where("series IS NULL").select("source_id", "month", "date", "kind")
    single = slices.where("series IS NOT NULL").select("source_id", "month", "date", "series", "kind")
    closing = _daily(facts.join(_broadcast_if_small(whole.drop("kind")), ["source_id", "month", "date"]), key).withColumn("kind", F.lit("closed"))
    late = _daily(facts.join(_broadcast_if_small(single.drop("kind")), ["source_id", "month", "date", "series"]), key).withColumn("kind", F.lit("restated"))
    return closing.unionByName(late)


def ingest_days(
    stream: DataFrame, root: str, checkpoint: str, now: Callable[[], Column], late_days: int = 2, key: str | None = "event_id", kind: str = "timeseries"
) -> DataStreamWriter:
    """Take in a stream of source_id, ts, series, value and ``key``; see the module's description for what is written.

    With ``key`` rows that repeat it within a source, series and day count once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        dated = batch.withColumns({"ts": F.col("ts").cast("timestamp"), "kind": F.lit(kind)}).withColumn("date", F.to_date("ts"))
        names = [c for c in dated.columns if c != "source_id"]
        laid = dated.select("source_id", _month(), F.lit(batch_id).alias("batch"), F.concat_ws(":", "source_id", F.lit(str(batch_id))).alias("snapshot_id"), *names)
        spread = F.pmod(F.xxhash64(*names), F.lit(MONTH_WRITERS))
        replace_partitions(laid.repartition("source_id", "month", spread), f"{root}/facts")
        facts = read_facts(spark, root)
        own = facts.where(F.col("batch") == batch_id)
        replace_partitions(slice_rows(own, names), f"{root}/index")
        snapshot_headers(own, now()).write.mode("overwrite").parquet(f"{root}/headers/batch={batch_id}")

        newest = own.groupBy("source_id").agg(F.max("ts").alias("newest"))
        before = newest.where(F.lit(False))
        if batch_id > 0:
            before = spark.read.parquet(f"{root}/progress/batch={batch_id - 1}").select("source_id", "newest")
        both = newest.unionByName(before).groupBy("source_id").agg(F.max("newest").alias("newest"))
        limit = lambda c: F.date_sub(F.to_date(c), late_days)
        progress = both.join(before.withColumnRenamed("newest", "_before"), "source_id", "left").select("source_id", "newest", limit("_before").alias("closed_before"), limit("newest").alias("closed"))
        progress.write.mode("overwrite").parquet(f"{root}/progress/batch={batch_id}")
        moved = spark.read.parquet(f"{root}/progress/batch={batch_id}")

        sources = F.broadcast(moved) if moved.count() <= SMALL_SLICES else moved
        # only the months between the oldest and the newest limit can have days that close now
        first, last = moved.agg(F.min(F.coalesce("closed_before", F.lit("0001-01-01").cast("date"))), F.max("closed")).first()
        near = read_index(spark, root).where(F.col("month").between(first.isoformat()[:7], last.isoformat()[:7])).join(sources, "source_id")
        open_until = F.coalesce(F.col("date") >= F.col("closed_before"), F.lit(True))
        closing = near.where(open_until & (F.col("date") < F.col("closed"))).select("source_id", "month", "date", F.lit(None).cast("string").alias("series"), F.lit("closed").alias("kind"))
        fresh = read_index(spark, root).where(F.col("batch") == batch_id).join(sources, "source_id")
        late = fresh.where(F.col("date") < F.col("closed_before")).select("source_id", "month", "date", "series", F.lit("restated").alias("kind"))
        slices = cut_lineage(closing.unionByName(late).distinct())
        pulled = day_pulls(facts.where(F.col("batch") <= batch_id), slices, key)
        named = pulled.withColumns({"batch": F.lit(batch_id), "snapshot_id": F.concat_ws(":", "source_id", F.lit("day"), F.lit(str(batch_id)))})
        replace_partitions(named, f"{root}/days")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def owned_days(spark: SparkSession, root: str, source_id: str | None = None, months: Sequence[str] | None = None) -> DataFrame:
    """Closed days: of several pulls of a day and series the last owns it."""
    days = _read(spark, f"{root}/days", source_id, months)
    owned = days.groupBy("source_id", "date", "series").agg(F.max(F.struct("batch", "value", "kind")).alias("_o"))
    return owned.select("source_id", "date", "series", F.col("_o.value").alias("value"), F.col("_o.kind").alias("kind"))


def all_days(spark: SparkSession, root: str, key: str | None = "event_id") -> DataFrame:
    """Closed days and the values so far of open ones."""
    last = spark.read.option("basePath", f"{root}/progress").parquet(f"{root}/progress")
    closed = last.groupBy("source_id").agg(F.max("closed").alias("_closed"))
    facts = read_facts(spark, root).join(closed, "source_id").where(F.col("date") >= F.col("_closed"))
    return owned_days(spark, root).unionByName(_daily(facts, key).select("source_id", "date", "series", "value", F.lit("open").alias("kind")))
