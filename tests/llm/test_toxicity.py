"""Toxicity: held-out quality, no leakage, the risk estimator, edge cases."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from gridloom.llm import toxicity as T
from tests.llm import cases

HELD = lambda d: zlib.crc32(str(d).encode()) % 5 == 0


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    out = T.op3_toxicity_nnpu(spark, sf)
    rows = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    y, s, p = (np.array([r[c] for r in rows]) for c in ("toxic", "score", "predicted"))
    assert ((s >= 0) & (s <= 1)).all() and (p == (s >= 0.5)).all()
    assert (p[y == 1] == 1).mean() > 0.8 and (p[y == 0] == 1).mean() < 0.01
    order = s.argsort()
    rank = np.empty(len(s))
    rank[order] = np.arange(len(s))
    n = (y == 1).sum()
    assert (rank[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n)) > 0.93


def test_held_out_labels_and_other_columns_are_never_read(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    a = T.op3_toxicity_nnpu(spark, sf).orderBy("doc_id").collect()
    b = T.op3_toxicity_nnpu(spark, cases.put(spark, tmp_path, documents=other.repartition(5), labels=flipped)).orderBy("doc_id").collect()
    assert len(a) == docs.count()
    for x, y in zip(a, b, strict=True):
        assert x.doc_id == y.doc_id and abs(x.score - y.score) < 1e-6 and x.held_out == HELD(x.doc_id)


def test_edge_cases(spark):
    labels = spark.createDataFrame([(0, 1), (0, 1), (3, 1), (4, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    model = T.fit(cases.documents(spark), labels)
    rows = T.scored(cases.documents(spark), model).collect()
    assert len(rows) == len(cases.rows()) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (r.doc_id is not None and HELD(r.doc_id)) for r in rows)
    nothing = T.fit(cases.documents(spark), labels.where("false"))
    assert {round(r.score, 6) for r in T.scored(cases.documents(spark), nothing).collect()} == {T.DEFAULT_PRIOR}
    assert T.scored(cases.empty(spark), T.fit(cases.empty(spark), labels)).count() == 0


def test_filter_keeps_columns_and_clean_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    wide = docs.withColumn("score", F.lit("mine")).withColumn("held_out", F.lit(1))
    kept = T.without_toxic(wide, labels)
    assert kept.schema == wide.schema
    want = {r.doc_id for r in T.op3_toxicity_nnpu(spark, sf).where("predicted = 0").collect()}
    assert {r.doc_id for r in kept.collect()} == want and len(want) > 0.8 * docs.count()
    assert T.without_toxic(cases.documents(spark), labels.where("false")).count() == len(cases.rows())


def test_learner_separates_from_positive_and_unlabelled():
    rng = np.random.default_rng(0)
    p = rng.normal(2, 1, (300, 3))
    u = np.concatenate([rng.normal(2, 1, (100, 3)), rng.normal(-2, 1, (900, 3))])
    w, b = T.nnpu(p, u, 0.1)
    z = u @ w + b
    assert (z[:100] > z[100:].max()).mean() > 0.9


def test_pieces_of_a_long_text_count_every_gram_once(monkeypatch):
    text = (b"some words of a text " * 40)[:777]
    whole = T.counted(text, None, T.BUCKETS)
    monkeypatch.setattr(T, "_PIECE", 100)
    cut = T.counted(text, None, T.BUCKETS)
    assert (whole[0] == cut[0]).all() and whole[1] == cut[1]


def test_the_sample_is_the_first_by_hash(spark, monkeypatch):
    for ids in (list(range(5000)), list(range(30)), [7] * 4000 + list(range(60)), []):
        docs = spark.createDataFrame([(k,) for k in ids], "doc_id long").repartition(3)
        hashed = sorted((r.h, r.doc_id) for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit(T.SEED)).alias("h")).distinct().collect())
        assert sorted(r.doc_id for r in T.sampled(docs, len(ids), 50).collect()) == sorted(k for _, k in hashed[:50])
