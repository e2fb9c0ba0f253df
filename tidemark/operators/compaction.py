"""Compaction of a store of pulls, with proof, and one switch for all readers.

A store is a folder with ``data``, partitioned by generation and by the store's
own columns, and ``manifest``, whose newest complete version says which
generation of each part is in force. Compaction packs the files of a part into
as few of the target size and number of rows as it can, writes them as a new generation, and
publishes a version of the manifest only if every pull has the same rows before
and after, by an order-free digest. Readers that began earlier go on with the
files of their version; those that begin later get the new ones, all at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import row_hash
from ..session import cut_lineage
from .ledger import rows_digest

TARGET_BYTES = 256 << 20
#: Rows of a file; a task sorts the rows of one file, so this bounds its memory however well the rows compress.
TARGET_ROWS = 4_000_000
#: Parts or files up to which their list is broadcast, so that scans are pruned while they run; longer lists are joined by a shuffle.
SMALL_LIST = 200_000


#: How a null is kept in a column that names folders.
NONE = "(none)"


class Changed(ValueError):
    """Rows do not match what was recorded of them."""


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """Complete versions of the manifest, oldest first."""
    path, files = _files(spark, f"{root}/manifest")
    if not files.exists(path):
        return []
    found = [entry.getPath() for entry in files.listStatus(path)]
    done = [p for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in done)


def _manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    known = versions(spark, root)
    return spark.read.parquet(f"{root}/manifest/version={known[-1] if version is None else version}")


def _publish(parts: DataFrame, root: str, version: int) -> None:
    parts.write.parquet(f"{root}/manifest/version={version}")


def _small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.limit(SMALL_LIST + 1).count() <= SMALL_LIST else rows


def _named(rows: DataFrame, parts: Sequence[str]) -> DataFrame:
    return rows.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(NONE)) for c in parts})


def _data(spark: SparkSession, root: str, parts: Sequence[str]) -> DataFrame:
    rows = spark.read.option("basePath", f"{root}/data").parquet(f"{root}/data")
    return rows.withColumns({c: F.col(c).cast("string") for c in parts})


def create(rows: DataFrame, root: str, parts: Sequence[str] = ("source_id", "month")) -> None:
    """A store of ``rows`` as its generation 0; ``parts`` are columns of text."""
    _named(rows, parts).withColumn("generation", F.lit(0)).write.partitionBy("generation", *parts).parquet(f"{root}/data")
    spark = rows.sparkSession
    _publish(_data(spark, root, parts).select("generation", *parts).distinct(), root, 0)


def append(rows: DataFrame, root: str, parts: Sequence[str] = ("source_id", "month")) -> None:
    """More rows, as a generation of their own that is in force beside the earlier ones."""
    spark = rows.sparkSession
    version = versions(spark, root)[-1] + 1
    _named(rows, parts).withColumn("generation", F.lit(version)).write.mode("append").partitionBy("generation", *parts).parquet(f"{root}/data")
    fresh = _data(spark, root, parts).where(F.col("generation") == version).select("generation", *parts).distinct()
    _publish(_manifest(spark, root).unionByName(fresh), root, version)


def read(spark: SparkSession, root: str, parts: Sequence[str] = ("source_id", "month"), version: int | None = None) -> DataFrame:
    """The rows in force; other generations are pruned by their folders."""
    current = _manifest(spark, root, version)
    rows = _data(spark, root, parts).join(_small(current), ["generation", *parts], "left_semi").drop("generation")
    return rows.withColumns({c: F.nullif(F.col(c), F.lit(NONE)) for c in parts})


def file_bins(spark: SparkSession, root: str, parts: Sequence[str], target: int) -> DataFrame:
    """The files in force with their part and the bin that each goes to: file, parts, bytes, files, bins and bin.

    Within a part, files are laid end to end, the largest first, and cut at the
    target size, so a bin exceeds it by one small file at most. A file whose rows
    are a greater share of ``TARGET_ROWS`` counts by them.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{root}/data").select("path", "length")
    decoded = [F.url_decode(F.regexp_extract("path", rf"/{c}=([^/]+)/", 1)).alias(c) for c in parts]
    generation = F.regexp_extract("path", r"/generation=(\d+)/", 1).cast("int").alias("generation")
    current = _small(_manifest(spark, root))
    counted = _data(spark, root, parts).withColumn("path", F.col("_metadata.file_path")).join(current, ["generation", *parts], "left_semi").groupBy("path").agg(F.count(F.lit(1)).alias("_rows"))
    held = listed.select("path", "length", generation, *decoded).join(current, ["generation", *parts], "left_semi").join(counted, "path", "left")
    held = held.withColumn("_size", F.greatest("length", F.floor(F.coalesce("_rows", F.lit(0)) * F.lit(target / TARGET_ROWS)))).drop("_rows")
    order = Window.partitionBy(*parts).orderBy(F.desc("_size"), "path")
    until = F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    whole = Window.partitionBy(*parts)
    binned = held.withColumns({"bin": F.floor((until - F.col("_size") / 2) / target).cast("int"), "files": F.count(F.lit(1)).over(whole)})
    return binned.drop("_size").withColumn("bins", F.size(F.collect_set("bin").over(whole)))


def _numbered(chosen: DataFrame, parts: Sequence[str]) -> DataFrame:
    """Files with ``_slot``, the number of their bin among the bins of all parts, from 0."""
    of_part = chosen.select(*parts, "bin").distinct().withColumn("_n", F.dense_rank().over(Window.partitionBy(*parts).orderBy("bin")))
    # the only step over all parts has one row per part
    sizes = of_part.groupBy(*parts).agg(F.max("_n").alias("_k"))
    starts = sizes.withColumn("_start", F.sum("_k").over(Window.orderBy(*parts)) - F.col("_k")).drop("_k")
    slots = of_part.join(starts, list(parts)).select(*parts, "bin", (F.col("_start") + F.col("_n") - 1).cast("int").alias("_slot"))
    return chosen.join(slots, [*parts, "bin"])


def digests(rows: DataFrame, parts: Sequence[str]) -> DataFrame:
    """Rows and order-free digest of each pull in each part."""
    names = sorted(c for c in rows.columns if c not in ("generation", *parts))
    return rows_digest(rows, [*parts, "snapshot_id"], row_hash(*[F.col(c) for c in names]))


def _refuse_unless_same(before: DataFrame, after: DataFrame, keys: Sequence[str], what: str) -> None:
    both = before.join(after.withColumnsRenamed({"rows": "_rows", "digest": "_digest"}), list(keys), "full_outer")
    wrong = both.where(~F.col("digest").eqNullSafe(F.col("_digest")) | ~F.col("rows").eqNullSafe(F.col("_rows")))
    bad = wrong.select("snapshot_id").limit(5).collect()
    if bad:
        raise Changed(f"{what}: {[r['snapshot_id'] for r in bad]}")


def compact(
    spark: SparkSession, root: str, headers: DataFrame | None = None, tombstones: DataFrame | None = None, parts: Sequence[str] = ("source_id", "month"), target: int = TARGET_BYTES
) -> DataFrame:
    """Compact the parts that get fewer files, or hold pruned pulls; returns per part: files before and after, rows and digest.

    ``headers`` gives rows_hash and row_count as recorded for each snapshot_id
    (see :func:`pull_digests`); a pull that no longer has them stops the job
    before anything is written. ``tombstones`` names pulls to leave out. Parts
    are read and written once; a job that fails leaves only files that no
    manifest names.
    """
    current = _manifest(spark, root)
    rows = _data(spark, root, parts).withColumn("_file", F.col("_metadata.file_path"))
    held = rows.join(_small(current), ["generation", *parts], "left_semi")
    if headers is not None:
        recorded = headers.select("snapshot_id", F.col("row_count").alias("rows"), F.col("rows_hash").alias("digest"))
        actual = pull_digests(held.drop("_file"), parts)
        _refuse_unless_same(recorded.join(actual.select("snapshot_id"), "snapshot_id", "left_semi"), actual.join(recorded.select("snapshot_id"), "snapshot_id", "left_semi"), ["snapshot_id"], "rows do not match their header; refusing to compact changed pulls")
    bins = cut_lineage(file_bins(spark, root, parts, target))
    chosen, kept = bins.where(F.col("files") > F.col("bins")), held
    if tombstones is not None:
        gone = cut_lineage(tombstones.select("snapshot_id").distinct())
        touched = held.join(gone, "snapshot_id", "left_semi").select(*parts).distinct()
        chosen = chosen.unionByName(bins.where(F.col("files") <= F.col("bins")).join(touched, list(parts), "left_semi"))
        kept = held.join(gone, "snapshot_id", "left_anti")
    chosen = cut_lineage(_numbered(chosen.select("generation", *parts, F.col("path").alias("_file"), "bin", "files", "bins"), parts))
    if chosen.isEmpty():
        return spark.createDataFrame([], ", ".join([*[f"{c} string" for c in parts], "files long, bins int, n_rows long, digest string"]))
    moved = kept.join(_small(chosen.select("_file", "_slot")), "_file").drop("_file", "generation")
    version = versions(spark, root)[-1] + 1
    expected = cut_lineage(digests(moved.drop("_slot"), parts))
    # a task writes one bin
    slots = chosen.agg(F.max("_slot")).first()[0] + 1
    laid = moved.repartitionById(slots, F.col("_slot")).sortWithinPartitions(*parts, "snapshot_id", "date").drop("_slot")
    laid.withColumn("generation", F.lit(version)).write.mode("append").partitionBy("generation", *parts).parquet(f"{root}/data")
    written = _data(spark, root, parts).where(F.col("generation") == version)
    _refuse_unless_same(expected, digests(written, parts), [*parts, "snapshot_id"], "compacted rows differ from those read")
    old = chosen.select("generation", *parts).distinct()
    fresh = written.select("generation", *parts).distinct()
    _publish(current.join(old, ["generation", *parts], "left_anti").unionByName(fresh), root, version)
    sizes = chosen.groupBy(*parts).agg(F.first("files").alias("files"), F.first("bins").alias("bins"))
    names = [c for c in written.columns if c not in ("generation", *parts)]
    totals = rows_digest(written, parts, row_hash(*[F.col(c) for c in sorted(names)]))
    return sizes.join(totals, list(parts), "left").select(*parts, "files", "bins", F.coalesce("rows", F.lit(0)).alias("n_rows"), "digest")


def pull_digests(rows: DataFrame, parts: Sequence[str]) -> DataFrame:
    """Rows and digest of each pull, over all its parts: what a header records. ``parts`` are the store's columns."""
    rows = _named(rows, parts)
    names = sorted(c for c in rows.columns if c != "generation")
    return rows_digest(rows, ["snapshot_id"], row_hash(*[F.col(c) for c in names]))


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> list[int]:
    """Remove generations that none of the newest ``keep`` versions of the manifest names; returns them."""
    known = versions(spark, root)
    held = {r["generation"] for v in known[-keep:] for r in _manifest(spark, root, v).select("generation").distinct().collect()}
    path, files = _files(spark, f"{root}/data")
    removed = []
    for entry in files.listStatus(path):
        name = entry.getPath().getName()
        if name.startswith("generation=") and int(name.split("=")[1]) not in held:
            files.delete(entry.getPath(), True)
            removed.append(int(name.split("=")[1]))
    for version in known[:-keep]:
        files.delete(_files(spark, f"{root}/manifest/version={version}")[0], True)
    return sorted(removed)
