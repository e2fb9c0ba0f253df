import numpy as np
import pytest

from tidemark.llm import nearest as N

SCHEMA = "vec_id long, embedding array<float>, cell int, block int"


def frame(spark, ids, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2) for i, v in zip(ids, vectors)], SCHEMA)


def run(spark, ids, vectors, **options):
    rows = N.top_k(frame(spark, ids, vectors), **options).collect()
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in rows)


def brute(ids, vectors):
    return [tuple(int(x) for x in r) for r in N.brute_force(ids, vectors).itertuples(index=False)]


@pytest.mark.parametrize("clusters", [1, 12])
def test_matches_all_scores(spark, monkeypatch, clusters):
    monkeypatch.setattr(N, "QUERY_BLOCK", 3)
    monkeypatch.setattr(N, "SLICE", 40)
    draw = np.random.default_rng(4)
    middle = draw.normal(size=(clusters, 6)) * (1 if clusters == 1 else 20)
    vectors = (middle[draw.integers(0, clusters, 900)] + draw.normal(size=(900, 6)) * 0.2).astype(np.float32)
    vectors[100:140] = vectors[100]
    ids = list(range(900))
    assert run(spark, ids, vectors, pivots=16) == brute(ids, vectors)


def test_bound_prunes():
    pivots = np.array([[100.0, 0], [0, 100.0], [-100.0, 0]])
    kept = N.needed_cells(pivots[0], 1.0, pivots, np.array([1.0, 1.0, 1.0]), np.array([50, 50, 50]), 10)
    assert kept.tolist() == [0]


def test_edges(spark):
    odd = [[1, 2], None, [None, 1], [float("nan"), 1], [float("inf"), 1], [1e6, -3e6], [0, 0]]
    ids = [0, 1, 2, 3, 4, 5, 100]
    fine = [0, 5, 6]
    assert run(spark, ids, odd) == brute([ids[i] for i in fine], [odd[i] for i in fine])
    assert run(spark, [], []) == []
    assert run(spark, [0], [[1, 1]]) == []
