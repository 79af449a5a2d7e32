"""The pipeline: every stage keeps documents' columns, clean documents stay, duplicates go."""

import random

import corpus_pipeline as pipeline
from ledgerspark.llm import simhash
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    assert [n for n, _ in pipeline.STAGES] == ["language", "quality", "lines", "near_duplicates", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    columns, before = docs.columns, docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        had = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == columns and docs.count() <= before
        if name in ("language", "quality"):
            assert len(good & had - {r.doc_id for r in docs.select("doc_id").collect()}) <= 0.02 * len(good)
        before = docs.count()
    assert docs.groupBy("text").count().where("count > 1").count() == 0


def test_run(spark):
    out = pipeline.run(spark, SF)
    assert out.count() > 0 and out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_hard_rows(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "some words of text", "en", None, 3), (2, "some words of text", "en", None, 3), (3, "des mots encore", "fr", "b", None)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in pipeline.STAGES:
            stage(spark, docs, SF).collect()


def _words(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(n)]


def _jaccard(x, y):
    x, y = (set(simhash.shingles(t).tolist()) for t in (x, y))
    return len(x & y) / max(1, len(x | y))


def test_planted_near_copies_go(spark):
    texts = {}
    for i in range(40):  # 200 words of which the last are others: similarity 0.80 to 0.95
        w, other = _words(i, 200), 5 + i % 16
        texts[2 * i], texts[2 * i + 1] = " ".join(w), " ".join(w[:200 - other] + _words(1000 + i, other))
    pairs = [(2 * i, 2 * i + 1) for i in range(40)]
    assert all(0.8 <= _jaccard(texts[a], texts[b]) < 0.96 for a, b in pairs)
    texts[80], texts[81] = " ".join(_words(80, 200)), " ".join(_words(80, 200)[:150] + _words(1080, 50))
    assert _jaccard(texts[80], texts[81]) < 0.7
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars int")
    kept = {r.doc_id for r in pipeline.distinct_documents(spark, docs, SF).collect()}
    assert kept == {a for a, _ in pairs} | {80, 81}


def test_near_copies_in_a_common_passage(spark):
    passage = _words(0, 130)  # between pairs 0.65 at most: no link; within pairs more than 0.8
    own = {i: _words(10 + i, 40) for i in range(60)}
    texts = {2 * i + j: " ".join(passage + own[i] + _words(500 + 2 * i + j, 6)) for i in range(60) for j in range(2)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_texts(docs).collect()}
    assert got == {i: i - i % 2 for i in texts}


def test_near_copies_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id is not null")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.component_id for r in simhash.near_texts(docs).collect()}
    sets = {i: set(simhash.shingles(t).tolist()) for i, t in texts.items()}
    root = {i: i for i in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                x, y = sorted((root[a], root[b]))
                root = {k: x if v == y else v for k, v in root.items()}
    assert got == root
