import math
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from brute import words

from tidemark.llm import contexts as C

SCHEMA = "doc_id long, text string, bytes int"


def held(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 7 == 2


def joined(a, b):
    top = max(a, b)
    return top + math.log(math.exp(a - top) + math.exp(b - top)) - math.log(2)


def brute(rows, depth=C.DEPTH):
    """Context-tree weighting with dictionaries, node by node."""
    low = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    counts = {}
    for doc, text in rows:
        if not held(doc):
            data = bytes([255]) * depth + low(text).encode() + b"\xff"
            for t in range(depth, len(data)):
                for d in range(depth + 1):
                    for k in range(8):
                        node = counts.setdefault((data[t - d : t], k, data[t] >> (8 - k)), [0, 0])
                        node[data[t] >> (7 - k) & 1] += 1
    kt = {n: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) for n, (a, b) in counts.items()}
    weighted, below = {}, Counter()
    for node in sorted(counts, key=lambda n: -len(n[0])):
        weighted[node] = kt[node] if len(node[0]) == depth else joined(kt[node], below[node])
        if node[0]:
            below[(node[0][1:], *node[1:])] += weighted[node]

    def p(context, k, prefix, bit):
        value = None
        for d in range(depth, -1, -1):
            node = (context[len(context) - d :], k, prefix)
            if node not in counts:
                continue
            own = (counts[node][bit] + 0.5) / (sum(counts[node]) + 1)
            w = 1.0 if d == depth else 0.5 * math.exp(kt[node] - weighted[node])
            value = own if value is None else w * own + (1 - w) * value
        return 0.5 if value is None else value

    vocabulary, tokens, texts = Counter(), 0, 0
    for doc, text in rows:
        if not held(doc):
            vocabulary.update(words(low(text)))
            texts += 1
    tokens, size = sum(vocabulary.values()) + texts, len(vocabulary) + (texts > 0)
    out = []
    for doc, text in rows:
        data = bytes([255]) * depth + low(text).encode() + b"\xff"
        total = sum(math.log10(p(data[t - depth : t], k, data[t] >> (8 - k), data[t] >> (7 - k) & 1)) for t in range(depth, len(data)) for k in range(8))
        found = [vocabulary[w] for w in words(low(text))] + [texts]
        out.append((doc, held(doc), len(found), sum(c > 0 for c in found), tokens, sum(math.log10((c + 1) / (tokens + size + 1)) for c in found), total))
    return out


def rows_of(n=40):
    draw = random.Random(3)
    vocabulary = ["Abba", "cab", "Éa", "bc.", "a", "zz\x85"]
    rows = [(i, " ".join(draw.choice(vocabulary) for _ in range(draw.randrange(30)))) for i in range(n)]
    return rows + [(None, "no id"), (5, None), (6, ""), (7, "\t\n"), (7, "new日本 words"), (7, "new日本 words")]


@pytest.mark.parametrize("broadcast", [C.BROADCAST_ROWS, 0])
def test_matches_node_by_node(spark, broadcast):
    rows = rows_of()
    frame = spark.createDataFrame([(d, t, 1) for d, t in rows], SCHEMA)
    columns = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    got = [tuple(r[c] for c in columns) for r in C.context_tree_scores(frame, broadcast_rows=broadcast).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[6], 4))
    for a, b in zip(sorted(got, key=key), sorted(brute(rows), key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-8)


def test_a_distribution(spark):
    import numpy as np

    data = np.frombuffer(b"abracadabra" * 3, np.uint8)
    keys, _ = C.byte_runs(data, np.array([0, len(data)]))
    # all last bytes after the contexts seen
    contexts = np.unique(keys >> np.uint64(8))
    every = ((contexts[:, None] << np.uint64(8)) | np.arange(256, dtype=np.uint64)).ravel()
    seen, count = np.unique(keys, return_counts=True)
    counts = np.zeros(len(every), np.int64)
    counts[np.searchsorted(every, seen)] = count
    rows = C._top_rows((), C.pa.table([[every.tobytes()], [counts.tobytes()]], names=["keys", "counts"])).to_pylist()
    p = 10 ** C._log_probabilities(every, counts, C._top(rows))
    assert np.allclose(p.reshape(-1, 256).sum(1), 1)


def test_empty_and_untrained(spark):
    assert C.context_tree_scores(spark.createDataFrame([], SCHEMA)).collect() == []
    alone = next(i for i in range(99) if held(i))
    row = C.context_tree_scores(spark.createDataFrame([(alone, "ab", 1)], SCHEMA)).first()
    assert row["score"] == pytest.approx(-3 * math.log10(256)) and row["train_tokens"] == 0 and row["n_known"] == 0


def test_blocks_give_the_rows_of_a_broadcast(spark, monkeypatch):
    frame = spark.createDataFrame([(d, t, 1) for d, t in rows_of(120)], SCHEMA).repartition(3)
    want = C.context_tree_scores(frame).collect()
    monkeypatch.setattr(C, "BLOCK_BYTES", 300)  # some 40 blocks
    got = C.context_tree_scores(frame, broadcast_rows=0).collect()
    key = lambda r: str(tuple(r))
    assert sorted(got, key=key) == sorted(want, key=key)


def test_packed_numbers_come_back():
    for keys in ([], [0], [5, 5, 6], [0, 1 << 47, (1 << 64) - 1]):
        assert C._grown_keys(C._shrunk_keys(np.array(keys, np.uint64))).tolist() == keys
    values = np.array([-1.5, 0.0, 1e-300, 7])
    assert C._grown(C._shrunk(values), np.float64).tolist() == values.tolist()


def disk(spark):
    """Bytes of each file that Spark holds: shuffles, and rows in the checkpoint folder."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    held = {(f := files.apply(i)).getPath(): f.length() for i in range(files.size())}
    folder = spark.sparkContext.getCheckpointDir()
    return held | {str(f): f.stat().st_size for f in (Path(folder.removeprefix("file:")).rglob("*.parquet") if folder else ())}


def test_tables_beyond_the_broadcast_fit_three_times_the_input(spark, tmp_path):
    draw = random.Random(5)
    vocabulary = ["".join(draw.choices("etaoinshrdlu", k=draw.randrange(2, 9))) for _ in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    rows = [(i, " ".join(draw.choices(vocabulary, weights, k=300)), 1) for i in range(5000)]
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(f"{tmp_path}/in")
    size = sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    before = disk(spark)
    out = C.context_tree_scores(spark.read.parquet(f"{tmp_path}/in"), broadcast_rows=0)
    out.write.format("noop").mode("overwrite").save()
    used = sum(n for name, n in disk(spark).items() if name not in before)
    assert used < 3 * size, (used, size)
