import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import manifest as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, place int, tree string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)])


def levels(nodes, arity):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + arity]) for i in range(0, len(out[-1]), arity)])
    return out


def siblings(tree, i, arity):
    out = []
    for nodes in tree[:-1]:
        zero = i - i % arity
        out.append(("".join(nodes[zero:i]), "".join(nodes[i + 1 : zero + arity])))
        i //= arity
    return out


def brute(rows, arity):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    leaves = {s: sorted([(r[0] is not None, r[0] or 0, leaf(r, r[1]), r) for r in rows if r[3] == s], key=lambda x: x[:3]) for s in sources}
    trees = {s: levels([x[2] for x in leaves[s]], arity) for s in sources}
    top = levels([trees[s][-1][0] for s in sources], arity)
    out = []
    for j, s in enumerate(sources):
        for i, (_, _, h, r) in enumerate(leaves[s]):
            path = siblings(trees[s], i, arity) + siblings(top, j, arity)
            text = r[1]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            x = leaf(r, text)
            for left, right in path:
                x = digest(left, x, right)
            out.append((r[0], h, trees[s][-1][0], top[-1][0], digest(*[a + b for a, b in path]), x, x == top[-1][0]))
    return sorted(out, key=str)


def run(spark, rows, arity=16):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = M.merkle_manifest(frame, changed={"text": M.lower_ascii(F.col("text"))}, when=M.every_fifth(F.col("doc_id")), arity=arity)
    return sorted([tuple(r) for r in got.drop("source", "path").collect()], key=str)


@pytest.mark.parametrize("arity,blocks", [(2, 100_000), (16, 0)])
def test_matches_a_tree_in_memory(spark, monkeypatch, arity, blocks):
    monkeypatch.setattr(M, "SMALL_BLOCKS", blocks)
    draw = random.Random(3)
    names = ["a", "a", "a", None, "", "é", "b c", *[f"s{i}" for i in range(25)]]
    rows = [(draw.randrange(400), draw.choice(["Ab", "", None, "é X", "zZ" * 50]), draw.choice(["en", None]), draw.choice(names), draw.choice([1, None])) for _ in range(500)]
    rows += [(None, "Q", "en", "a", 1)] * 3 + [(7, "Q", "en", "a", 1)] * 40
    assert run(spark, rows, arity) == brute(rows, arity)


def test_edges(spark):
    alone = [(5, "Text " * 200_000, "en", None, 3)]
    assert run(spark, alone) == brute(alone, 16)
    run_of_16 = [(i, "t", None, "s", None) for i in range(17)]
    assert run(spark, run_of_16) == brute(run_of_16, 16)
    assert run(spark, []) == []


def test_paths_prove_membership(spark):
    rows = spark.createDataFrame([(i, f"T{i}", "en", f"s{i % 3}", i) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    for r in M.merkle_manifest(rows, arity=3).collect():
        x = r.leaf
        for step in r.path:
            x = digest(step.left, x, step.right)
        assert x == r.root and r.verified
