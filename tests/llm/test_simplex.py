import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import simplex as S

SCHEMA = "vec_id long, embedding array<double>, cluster int, v string"


def brute(rows, k=40, rounds=5):
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    fine.sort(key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    points = np.array([v for _, v in fine], object)
    centroids = [list(v) for _, v in fine[:k]]

    def assign():
        d = np.stack([((points - np.array(c, object)) ** 2).sum(1) for c in centroids], 1)
        best = [min(range(len(centroids)), key=lambda j: (d[i, j], j)) for i in range(len(points))]
        return best, [d[i, b] for i, b in enumerate(best)]

    for _ in range(rounds):
        best, _ = assign()
        for j in range(len(centroids)):
            members = [i for i, b in enumerate(best) if b == j]
            if members:
                centroids[j] = [sum(points[i, t] for i in members) // len(members) for t in range(64)]
    best, least = assign()
    per = {b: sum(d for x, d in zip(best, least) if x == b) for b in set(best)}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    clip = lambda n: min(n, (1 << 63) - 1)
    return sorted([(fine[i][0], b, clip(d), clip(per[b]), clip(sum(least)), names[b]) for i, (b, d) in enumerate(zip(best, least))], key=str)


def run(spark, rows):
    got = S.clusters(spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA))
    return sorted([tuple(r)[:6] for r in got.collect()], key=str)


def mixture(n, spread=0.2, groups=15, scale=1.0):
    draw = np.random.default_rng(1)
    middle = draw.normal(size=(groups, 64))
    return [(i, ((middle[i % groups] + draw.normal(size=64) * spread) * scale).tolist()) for i in range(n)]


def test_matches_plain_rounds(spark):
    rows = mixture(300)
    odd = [(5, rows[5][1])] * 5 + [(600, None), (601, [1.0] * 63), (602, [1.0] * 63 + [None]), (603, [1.0] * 63 + [math.nan]), (604, [2e7] * 64), (605, [0.0] * 64), (None, [1.0] * 64)]
    assert run(spark, rows + odd) == brute(rows + odd)


@pytest.mark.parametrize("rows", [mixture(20), mixture(90, scale=1e15), [(i, [1.0] * 64) for i in range(60)]])
def test_few_large_and_equal_vectors(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


def test_filter_leaves_few_centroids(spark):
    got = S.clusters(spark.createDataFrame([(i, v, 1, "x") for i, v in mixture(400)], SCHEMA))
    assert got.agg(F.avg("compared")).first()[0] < 8


def test_bounds_hold():
    draw = np.random.default_rng(2)
    points = draw.integers(-300, 300, (200, 64))
    simplex = S.Simplex(points[:40], 16)
    apex = simplex.apex(simplex.distances(points))
    low, high = simplex.bounds(apex, apex)
    true = np.square(points[:, None].astype(float) - points[None]).sum(2)
    assert (low <= true).all() and (true <= high).all()
    flat = S.Simplex(np.array([[0] * 64, [9] * 64, [18] * 64]), 16)  # all on one line: two pivots
    assert len(flat.pivots) == 2
