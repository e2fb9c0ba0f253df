"""Supersede chains, linked changes, control volume, redirects and checkpoints."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import confidence, selection
from tidemark.session import ensure_checkpoint_dir
from tidemark.sources import html


def test_long_chains_and_cycles(spark):
    rows = [(i, i - 1 if i else None) for i in range(300)] + [(1000, 1001), (1001, 1000), (1002, 1001)]
    frame = spark.createDataFrame(rows, "id long, supersedes long")
    ends = {r.id: r.current_id for r in selection.resolve_chains(frame, "id").collect()}
    assert all(ends[i] == 299 for i in range(300))
    cycles = {r.id for r in selection.chain_cycles(frame, "id").collect()}
    assert cycles == {1000, 1001} and ends[1000] == 1000


def test_superseded_link_is_its_successor(spark):
    changes = spark.createDataFrame(
        [("c1", None, "pending", ["/a"]), ("c2", "c1", "deployed", ["/a"])], "change_id string, supersedes string, deploy_status string, pages array<string>"
    ).withColumns({"type": F.lit("content_update"), "live_date": F.lit("2026-01-05").cast("date"), "experiment_id": F.lit(None).cast("string"), "confirmed": F.lit(True)})
    requests = spark.createDataFrame([("r", ["/a"], ["c1", "gone"])], "request_id string, scope_pages array<string>, change_ids array<string>").withColumns(
        {"experiment_id": F.lit(None).cast("string"), "before_start": F.lit("2026-01-01").cast("date"), "after_end": F.lit("2026-01-31").cast("date")}
    )
    assert [(r.change_id, r.relation) for r in confidence.classify_changes(changes, requests).collect()] == [("c2", "linked")]
    assert [(r.code, r.detail) for r in confidence.unknown_changes(changes, requests).collect()] == [("unknown_change", "gone")]


def test_redirects(spark):
    at = lambda k: f"https://e.com/d/{k}"
    rows = [(at(i), 301, f"/d/{i + 1}") for i in range(8)] + [(at(8), 200, None), (at(0), 301, "/d/1"), (at("x"), 302, "y"), (at("y"), 302, at("x")), ("https://f.com", 301, "//e.com/d/8")]
    frame = spark.createDataFrame(rows, "url string, status int, redirect_to string")
    got = {r.url: tuple(r)[2:] for r in html.redirect_chains(frame).collect()}
    assert got[at(0)] == (at(8), 8, False) and got[at(8)] == ("", 0, False) and got[at("x")][2] and got["https://f.com"] == (at(8), 1, False)
    cut = {r.url: tuple(r)[2:] for r in html.redirect_chains(frame, max_hops=5).collect()}
    assert cut[at(0)] == (at(5), 5, True) and cut[at(3)] == (at(8), 5, False)


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())
