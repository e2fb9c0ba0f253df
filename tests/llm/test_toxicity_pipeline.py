import zlib

import corpus_pipeline
from tidemark.llm import bpe, toxicity
from tidemark.llm.queries import tokenizer_path

FOLDER = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(docs, labels).select("row.doc_id", "held_out", "score", "predicted").collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert len(scored) == docs.count()
    for r in scored:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(truth[r.doc_id], r.predicted) for r in scored if r.held_out and r.doc_id in truth]
    assert sum(p for t, p in held if t) / sum(t for t, _ in held) > 0.7
    assert sum(p for t, p in held if not t) / sum(not t for t, _ in held) < 0.02


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (None, "x " * 200_000, 1.0), (2, "", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.score(docs, labels).collect()
    assert len(rows) == 4 and all(r.score == 0 and r.predicted == 0 for r in rows)
    assert toxicity.keep_clean(docs, labels).columns == docs.columns
    assert toxicity.score(docs.where("false"), labels).collect() == []


def test_pipeline(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        rows = out.collect()
        seen[name] = rows
        docs = spark.createDataFrame(rows, docs.schema)
    ids = {name: {r.doc_id for r in rows} for name, rows in seen.items()}
    assert ids["toxicity"] >= ids["exact_dedup"] >= ids["jaccard_join"] >= ids["mix_sources"]
    assert len(seen["jaccard_join"]) == len(ids["jaccard_join"]) < len(ids["toxicity"])
    out = corpus_pipeline.run(spark, folder).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in seen["mix_sources"])
    tool = bpe.Encoder(open(tokenizer_path(), encoding="utf-8").read())
    text = {r.doc_id: r.text for r in seen["mix_sources"]}
    assert all(r.ids == tool.encode(text[r.doc_id]) for r in out)
