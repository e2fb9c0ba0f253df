"""Sets as digests with one list each, and distinct counts by rows and by sketches."""

from pyspark.sql import functions as F

from tidemark.operators import provenance as P


def test_equal_sets_are_listed_once(spark):
    rows = [(r, p) for r in range(50) for p in (["a", "b"] if r % 2 else ["b", "a", "a"])] + [(90, "c"), (91, None), (None, "a"), (None, "b")]
    sets, members = P.member_sets(spark.createDataFrame(rows, "request_id INT, snapshot_id STRING"), ["request_id"], "snapshot_id")
    found = {r.request_id: (r.set_id, r.n_members) for r in sets.collect()}
    assert len(found) == 52 and len({v for v in found.values()}) == 2 and found[90][1] == 1 and found[None] == found[0]
    listed = {}
    for r in members.collect():
        listed.setdefault(r.set_id, []).append(r.snapshot_id)
    assert {k: sorted(v) for k, v in listed.items()} == {found[0][0]: ["a", "b"], found[90][0]: ["c"]}
    none = P.member_sets(spark.createDataFrame([], "request_id INT, snapshot_id STRING"), ["request_id"], "snapshot_id")
    assert none[0].collect() == [] and none[1].collect() == []


def test_sketches_add_up_over_days(spark):
    rows = spark.range(60_000).select((F.col("id") % 3).alias("k"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 30).cast("int")).alias("date"), F.concat(F.lit("p"), F.col("id") % 7_001).alias("page"))
    exact = {r.k: r.n_distinct for r in P.exact_distinct(rows, ["k"], "page").collect()}
    assert exact == {r.k: r.n for r in rows.groupBy("k").agg(F.countDistinct("page").alias("n")).collect()}
    near = {r.k: r.estimate for r in P.sketched_distinct(P.day_sketches(rows, ["k"], "page"), ["k"]).collect()}
    assert all(abs(near[k] - n) <= 2 * P.SKETCH_ERROR * n for k, n in exact.items())
