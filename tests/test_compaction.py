"""Compaction keeps every row, refuses changed ones, and switches readers at once."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import compaction as C

SCHEMA = "snapshot_id STRING, source_id STRING, month STRING, date DATE, value DOUBLE"


def pulls(spark, names, days=40):
    first = dt.date(2024, 1, 1)
    rows = [(n, f"s{i % 2}", None if i == 3 and d == 5 else (first + dt.timedelta(d)).isoformat()[:7], first + dt.timedelta(d), float(i + d)) for i, n in enumerate(names) for d in range(days)]
    return spark.createDataFrame(rows, SCHEMA)


def contents(frame):
    return sorted(map(str, frame.select(*[c.split(" ")[0] for c in SCHEMA.split(", ")]).collect()))


def files(tmp_path):
    return {g.name: sum(1 for _ in g.rglob("*.parquet")) for g in (tmp_path / "data").iterdir() if g.name.startswith("generation=")}


@pytest.mark.parametrize("small", [200_000, 0])
def test_compaction(spark, tmp_path, monkeypatch, small):
    monkeypatch.setattr(C, "SMALL_LIST", small)
    root = str(tmp_path)
    first, second = pulls(spark, ["a", "b", "c", "d"]), pulls(spark, ["e", "f"])
    C.create(first.repartition(4), root)
    C.append(second.repartition(3), root)
    whole = contents(first.unionByName(second))
    assert contents(C.read(spark, root)) == whole
    headers = C.pull_digests(C.read(spark, root), ["source_id", "month"]).select("snapshot_id", F.col("rows").alias("row_count"), F.col("digest").alias("rows_hash"))
    headers = spark.createDataFrame(headers.collect())
    before = sum(files(tmp_path).values())
    old = C.read(spark, root)
    report = C.compact(spark, root, headers)
    assert report.agg(F.sum("n_rows")).first()[0] == 239  # the undated row has one file as it is
    assert contents(C.read(spark, root)) == whole == contents(old)
    assert files(tmp_path)["generation=2"] == report.count() < before
    assert C.compact(spark, root, headers).collect() == []  # nothing is left to gain

    # pruned pulls leave; the rest is proved again
    tombstones = spark.createDataFrame([("a",), ("e",)], "snapshot_id STRING")
    C.compact(spark, root, headers, tombstones)
    assert contents(C.read(spark, root)) == contents(first.unionByName(second).where("snapshot_id NOT IN ('a', 'e')"))
    assert contents(C.read(spark, root, version=2)) == whole  # readers of the earlier version still have theirs
    C.vacuum(spark, root, keep=1)
    assert C.versions(spark, root) == [3] and "generation=1" not in files(tmp_path)
    assert contents(C.read(spark, root)) == contents(first.unionByName(second).where("snapshot_id NOT IN ('a', 'e')"))


def test_changed_rows_are_refused(spark, tmp_path):
    root = str(tmp_path)
    rows = pulls(spark, ["a", "b"])
    C.create(rows.withColumn("value", F.when((F.col("snapshot_id") == "b") & (F.col("date") == "2024-01-07"), 0.5).otherwise(F.col("value"))).repartition(3), root)
    headers = C.pull_digests(rows, ["source_id", "month"]).select("snapshot_id", F.col("rows").alias("row_count"), F.col("digest").alias("rows_hash"))
    with pytest.raises(C.Changed, match="'b'"):
        C.compact(spark, root, headers)
    assert C.versions(spark, root) == [0] and set(files(tmp_path)) == {"generation=0"}


def test_bins_stay_near_the_target(spark, tmp_path):
    root = str(tmp_path)
    C.create(pulls(spark, ["a", "b"], 200).repartition(6), root)
    sizes = C.file_bins(spark, root, ["source_id", "month"], 3000)
    largest = sizes.agg(F.max("length")).first()[0]
    assert sizes.groupBy("source_id", "month", "bin").agg(F.sum("length").alias("n")).where(F.col("n") > 3000 + largest).isEmpty()


def test_bins_are_bounded_in_rows_and_written_by_a_task_each(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "TARGET_ROWS", 100)
    root = str(tmp_path)
    rows = pulls(spark, ["a", "b"], 200)
    C.create(rows.repartition(40), root)
    report = C.compact(spark, root).collect()
    assert report and all(r.files > r.bins for r in report)
    # a year in one part: about as many files as it has hundreds of rows, none much larger
    other = str(tmp_path / "other")
    C.create(rows.withColumn("month", F.lit("all")).repartition(40), other)
    report = C.compact(spark, other).collect()
    assert {(r.source_id, r.bins, r.n_rows) for r in report} == {("s0", 2, 200), ("s1", 2, 200)}
    assert files(tmp_path / "other")["generation=1"] == 4
    sizes = spark.read.parquet(f"{other}/data/generation=1").groupBy(F.input_file_name()).count()
    assert sizes.agg(F.max("count")).first()[0] <= 120
    assert contents(C.read(spark, other)) == contents(rows.withColumn("month", F.lit("all")))


def test_writers_of_the_store_follow_its_rows(spark, tmp_path, monkeypatch):
    from tidemark.catalog import records

    lines = spark.range(1000).selectExpr("id AS l_orderkey", "1 AS l_linenumber", "id % 20 AS l_suppkey", "'R' AS l_returnflag", "TIMESTAMP_NTZ '1998-03-04 00:00:00' AS l_shipdate", "2.0D AS l_quantity")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(records, "_WRITER_ROWS", 100, raising=False)
    seen = []
    create = C.create
    monkeypatch.setattr(C, "create", lambda rows, root, *rest: (seen.append(root), create(rows, root, *rest))[1])
    from tidemark.catalog import load

    row = load().QUERIES["compacted_parts"](spark, str(tmp_path)).first()
    assert (row.source_id, row.month, row.n_rows, row.quantity, row.pulls) == ("R", "1998", 900, 1800.0, 18)
    written = spark.read.parquet(f"{seen[0]}/data/generation=0").groupBy(F.input_file_name()).count()
    assert written.count() == 10 and written.agg(F.max("count")).first()[0] <= 110
