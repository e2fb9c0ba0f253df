import random

from brute import groups

from tidemark.llm import neighbours as N

SCHEMA = "doc_id long, text string, node int, print string"


def rows_of(seed=2):
    draw = random.Random(seed)
    rows, base = [], [[f"w{draw.randrange(3000)}" for _ in range(draw.randrange(40, 120))] for _ in range(12)]
    for i in range(150):
        ws = list(draw.choice(base))
        for _ in range(draw.randrange(4)):
            ws[draw.randrange(len(ws))] = f"x{draw.randrange(50)}"
        if draw.random() < 0.2:
            ws = ws[draw.randrange(12) :]
        rows.append((i * 7 % 151, " \t".join(ws)))
    rows += [(200, None), (201, ""), (202, "\n "), (203, "a b"), (204, "a  b"), (205, "a"), (206, "a b c d e"), (207, "a b c d e a b c d e a"), (3, rows[9][1])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x") for d, t in rows], SCHEMA)


def test_matches_all_pairs(spark, monkeypatch):
    rows = rows_of()
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in N.similar_groups(frame(spark, rows)).collect())
    assert got == groups(rows)
    # blocks of a few classes and no broadcast give the same
    monkeypatch.setattr(N, "BLOCK", 8)
    monkeypatch.setattr(N, "SMALL_MEMBERS", 0)
    again = sorted((r.doc_id, r.class_id, r.n_links) for r in N.similar_groups(frame(spark, rows)).collect())
    assert again == got
    kept = sorted(r.doc_id for r in N.drop_neighbours(frame(spark, rows)).collect())
    assert kept == sorted({c for _, c, _ in got})


def test_repeated_rows_are_one_text(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    x, y = " ".join(words), " ".join([*words, "end"])
    for rows, limit in (([(1, x), (1, x), (2, y)], N.SMALL_MEMBERS), ([(None, x)] * 9 + [(2, y)] * 3 + [(3, y)], 0)):
        monkeypatch.setattr(N, "SMALL_MEMBERS", limit)
        got = N.similar_groups(frame(spark, rows)).collect()
        assert len(got) == len(rows) and all(r.n_links == 1 and r.class_size == len(rows) for r in got)


def test_many_pairs_in_one_tile():
    import numpy as np

    draw = np.random.default_rng(1)
    sets = [np.unique(draw.integers(0, 150, 140).astype(np.uint64)) for _ in range(70)]
    side = N._Side(range(70), [np.zeros(N.HASHES, np.uint16).tobytes()] * 70, [s.tobytes() for s in sets])
    i, j = (x.ravel() for x in np.meshgrid(np.arange(70), np.arange(70)))
    assert N._common(side, side, i, j).tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)]


def test_pruning_bound():
    least = N.least_matches()
    assert len(least) == 10 and least == sorted(least) and least[0] <= 5 and 90 < least[-1] < 115


def test_edges(spark):
    assert N.similar_groups(frame(spark, [])).collect() == []
    assert N.drop_neighbours(frame(spark, [])).collect() == []
    long_text = " ".join(f"z{i}" for i in range(50_000))
    rows = [(1, long_text), (2, long_text + " end"), (5, "q " * 30_000)]
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in N.similar_groups(frame(spark, rows)).collect()) == [(1, 1, 1), (2, 1, 1), (5, 5, 0)]
