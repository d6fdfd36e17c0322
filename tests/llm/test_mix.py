"""Mixing against exact arithmetic."""

import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from gridloom.llm import mix_sources as M
from tests.llm import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes: dict) -> dict:
    """Targets by source; sizes by source, None last."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        if not free:
            return {s: Fraction(3 * sizes[s]) for s in names}
        level = Fraction(total - sum(3 * sizes[s] for s in full), sum(weight[s] for s in free))
        over = {s for s in free if level * weight[s] >= 3 * sizes[s]}
        if not over:
            return {s: Fraction(3 * sizes[s]) if s in full else level * weight[s] for s in names}
        full |= over


def check(rows, docs):
    """rows: of the query; docs: (doc_id, text, source)."""
    size = lambda t: len(WORD.findall(t or ""))
    sizes: dict = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + size(t)
    targets = brute_targets(sizes)
    assert sorted((str(r.doc_id), r.size) for r in rows) == sorted((str(d), size(t)) for d, t, _ in docs)
    source = {d: s for d, _, s in docs}
    taken: dict = {}
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - float(targets[s])) < 1e-6 * max(1, float(targets[s]))
        assert 0 <= r.taken <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    for s, t in targets.items():
        assert taken[s] == int(t)


@pytest.mark.parametrize("bucket", [7, 20_000])
def test_documents(spark, monkeypatch, bucket):
    monkeypatch.setattr(M, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(M, "RUN_BUCKETS", 3)
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    one = M.op4_mix_sources(spark, sf).collect()
    check(one, docs)
    assert sorted(map(tuple, one)) == sorted(map(tuple, M.op4_mix_sources(spark, sf).collect()))


def test_edge_cases(spark):
    rows = [r for r in cases.rows() if r[0] is not None and r[0] not in (3, 6)]
    out = M.mix(M.sized(spark.createDataFrame(rows, cases.SCHEMA)))
    out = out.select("doc_id", F.col("_mix_size").alias("size"), F.col("_mix_total").alias("source_size"), F.col("_mix_target").alias("target"), F.col("_mix_taken").alias("taken")).collect()
    check(out, [(r[0], r[1], r[3]) for r in rows])
    assert M.mix(M.sized(cases.documents(spark))).count() == len(cases.rows())
    assert M.mix(M.sized(cases.empty(spark))).count() == 0
    silent = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert {(r._mix_taken, r._mix_target) for r in M.mix(M.sized(silent)).collect()} == {(0, 0.0)}


def test_many_sources_reach_their_limits(spark):
    docs = [(k, "w " * (k % 17), f"s{k % 11}") for k in range(300)] + [(1000, "w " * 5000, "s3")]
    out = M.mix(M.sized(spark.createDataFrame(docs, "doc_id long, text string, source string")))
    check(out.select("doc_id", F.col("_mix_size").alias("size"), F.col("_mix_total").alias("source_size"), F.col("_mix_target").alias("target"), F.col("_mix_taken").alias("taken")).collect(), docs)


def test_mixed_documents(spark):
    docs = cases.documents(spark)
    mixed = M.mixed_documents(docs)
    assert mixed.schema == docs.schema
    rows = mixed.collect()
    words: dict = {}
    for r in rows:
        words[r.doc_id] = words.get(r.doc_id, 0) + len(WORD.findall(r.text))
        assert r["_mix_size"] in ("m", None) and (r.n_chars is None or r.n_chars == len(r.text))
    taken: dict = {}
    for r in M.mix(M.sized(docs, F.xxhash64("text").alias("_mix_tie"))).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r["_mix_taken"]
    assert {d: n for d, n in taken.items() if n} == words
    assert M.mixed_documents(cases.empty(spark)).count() == 0


def test_sql(spark):
    from tests.compare import connect, from_spark, from_sql

    sf = "/root/testdata/sf0.01"
    assert from_spark(M.op4_mix_sources(spark, sf)) == from_sql(connect(sf), M.ORACLE_SQL["op4_mix_sources"])
