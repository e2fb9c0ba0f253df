import hashlib
import random
from collections import defaultdict

import pytest
from brute import words

from tidemark.llm import bpe, exact, mixing

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
FILE = public_tokenizers.path("byte_bpe_50k.json")


def test_bpe_agrees_with_the_library(spark):
    draw = random.Random(8)
    texts = ["".join(draw.choice("aaeetthis'nrl \n\t1.,-éßñ中😀\x85　") for _ in range(draw.randrange(60))) for _ in range(400)]
    texts += ["a" * 2000, "<|endoftext|> x<|endoftext|>", "  ", " ", "", "x ", "\r\n\n x", "Ünïcode 日本語 " * 500]
    rows = [(i, t, 1, "y") for i, t in enumerate(texts)] + [(None, None, 1, "y"), (0, texts[0], 1, "y")]
    tool = tokenizers.Tokenizer.from_file(FILE)
    got = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string, ids int, decoded string"), FILE).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = tool.encode("" if r.doc_id is None else texts[r.doc_id], add_special_tokens=False).ids
        back = tool.decode(ids, skip_special_tokens=False)
        assert (r.ids, r.decoded, r.n_tokens) == (ids, back, len(ids))
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), FILE).collect() == []


@pytest.mark.parametrize("support", [0.001, 0.2])
def test_exact_groups(spark, support):
    draw = random.Random(9)
    texts = ["a b", "ab", "a  b", None, "", " \n", "c d", "cd", "hot", "h o t", "hot "]
    rows = [(draw.randrange(40), draw.choice(texts)) for _ in range(60)] + [(i, "hot") for i in range(50, 90)] + [(None, "ab"), (None, "ab"), (5, "ab"), (5, "ab")]
    bare = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    groups = defaultdict(list)
    for d, t in rows:
        groups[bare(t)].append((-len(t or ""), d is None, d or 0, d))
    frame = spark.createDataFrame([(d, t, 1, "z") for d, t in rows], "doc_id long, text string, copies int, digest string")
    got = exact.exact_groups(frame, support=support).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(groups)
    named = {hashlib.sha256(k.encode()).hexdigest(): (min(g)[3], len(g)) for k, g in groups.items()}
    assert all((r.keep_id, r.group_size) == named[r.digest] for r in got)
    assert all(not r.kept or r.doc_id == r.keep_id for r in got)
    kept = exact.drop_copies(frame, support=support)
    assert kept.columns == frame.columns
    assert sorted((bare(r.text), r.doc_id or -1) for r in kept.collect()) == sorted((k, min(g)[3] or -1) for k, g in groups.items())
    assert exact.exact_groups(frame.where("false")).collect() == [] and exact.drop_copies(frame.where("false")).collect() == []


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 40)
    monkeypatch.setattr(mixing, "FAN_IN", 2)
    draw = random.Random(10)
    names = ["b", "a", None, "é", "Z"]
    rows = [(i % 500, "w " * draw.choice([0, 1, 3, 9, 30]), draw.choice(names + ["a"] * 5), "x") for i in range(700)] + [(None, None, "a", "x"), (3, "w w", "tiny", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mixing.mix(frame).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s, _ in rows:
        sizes[s] += len(words(t))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, full = {}, set()
    while True:  # share out, take off what is above, share again
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        target = {s: 3 * sizes[s] if s in full else rest * weight[s] / sum(weight[x] for x in order if x not in full) for s in order}
        above = {s for s in order if s not in full and target[s] > 3 * sizes[s]}
        if not above:
            break
        full |= above
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source] and 0 <= r.copies <= 3
        assert r.copies in (int(target[r.source] / sizes[r.source]), int(target[r.source] / sizes[r.source]) + 1) or not r.size
        taken[r.source] += r.copies * r.size
    assert all(abs(taken[s] - target[s]) <= 30 for s in order)
    again = mixing.mix(frame.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    out = mixing.mixed_rows(frame)
    assert out.columns == frame.columns
    counts = defaultdict(int)
    for r in out.collect():
        counts[r.source] += len(words(r.text))
    assert counts == {s: n for s, n in taken.items() if n}
    assert mixing.mix(frame.where("false")).collect() == [] and mixing.mixed_rows(frame.where("false")).collect() == []
