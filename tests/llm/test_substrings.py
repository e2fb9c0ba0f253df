import random

from brute import repeats

from tidemark.llm.substrings import remove_repeats

SCHEMA = "doc_id long, text string, seed int, print string"


def run(spark, rows):
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], SCHEMA)
    return sorted(tuple(r)[:4] for r in remove_repeats(frame).collect())


def test_matches_every_window_compared(spark):
    draw = random.Random(5)
    shared = [" ".join(draw.choice("abcdefgh") for _ in range(120)) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [" ".join(f"w{draw.randrange(4000)}" for _ in range(draw.randrange(80)))]
        for _ in range(draw.randrange(3)):
            piece = draw.choice(shared).split()
            a = draw.randrange(60)
            parts += [" ".join(piece[a : a + draw.randrange(40, 70)]), f"u{draw.randrange(9999)}"]
        rows.append((i * 3 % 61, "\t".join(parts)))
    rows += [(100, "a " * 300), (101, "a " * 200 + "\n"), (102, "a\x0ba\n" * 49), (7, rows[0][1])]
    assert run(spark, rows) == repeats(rows)


def test_edges(spark):
    long_text = " ".join(f"é{i}" for i in range(300_000))
    rows = [(1, long_text), (2, "x " + long_text), (3, None), (4, ""), (5, "  \n"), (6, "w " * 49), (9, "w " * 49)]
    assert run(spark, rows) == repeats(rows)
    frame = spark.createDataFrame([(None, "a " * 60, 1, "x"), (2, "a " * 60, 1, "x")], SCHEMA)
    assert sorted((r.n_removed for r in remove_repeats(frame).collect())) == [0, 0]
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
    kept = remove_repeats(spark.createDataFrame([(1, "b " * 70, 1, "x"), (2, "c " + "b " * 70, 1, "x")], SCHEMA), texts=True).orderBy("doc_id").collect()
    assert kept[1]["kept"] == "c" and [tuple(s) for s in kept[1]["spans"]] == [(1, 71)]


def test_frequent_seed_is_split(spark, monkeypatch):
    monkeypatch.setattr("tidemark.llm.substrings.PART_ROWS", 3)
    draw = random.Random(6)
    base = " ".join(f"v{i}" for i in range(90)).split()
    rows = [(i, " ".join(base[: draw.randrange(55, 90)] + [f"t{draw.randrange(5)}"] * 3 + base)) for i in range(20)]
    assert run(spark, rows) == repeats(rows)


def test_equal_rows_are_read_once(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(1, "x " + text), (9, "y " + text)] + [(5, text)] * 10_000
    got = run(spark, rows)
    assert got == repeats(rows[:3])[:1] + [repeats(rows[:3])[1]] * 10_000 + repeats(rows[:3])[2:]
