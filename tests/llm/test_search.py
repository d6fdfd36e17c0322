"""Exact top-k search against all inner products."""

import math

import numpy as np
import pytest

from gridloom.llm import topk_search as K
from tests.compare import connect, from_spark, from_sql
from tests.llm import cases


def brute(rows, k=5, step=50):
    kept = []
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, tuple(math.floor(256 * float(x)) for x in v)))
    kept.sort()
    out, asked = [], {}
    for i, v in kept:
        if i % step == 0:
            asked.setdefault(i, v)
    for q, a in asked.items():
        scores = sorted((-sum(x * y for x, y in zip(a, v, strict=False)), i) for i, v in kept if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def found(spark, rows, folder):
    return sorted(tuple(r) for r in K.op10_maxscore_top_k(spark, cases.put(spark, folder, embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3))).collect())


@pytest.mark.parametrize("window", [4, 1024])
def test_generated_vectors(spark, tmp_path, monkeypatch, window):
    monkeypatch.setattr(K, "WINDOW", window)
    monkeypatch.setattr(K, "SHARD_ROWS", 40)
    monkeypatch.setattr(K, "BLOCK_ROWS", 3)
    rng = np.random.default_rng(window)
    rows = [(k, np.round(rng.normal(size=8), 1).astype(np.float32).tolist(), 0) for k in range(400)]
    assert found(spark, rows, tmp_path) == brute([(r[0], r[1]) for r in rows])


def test_edge_cases(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (50, [1.0, 2.0], 1), (1, [1.0, 2.0], None), (2, [1.0, None], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (5, None, 1), (6, [], 1), (7, [0.5, -2.0, 9.0], 1), (8, [1.0, 2.0], 1), (8, [1.0, 2.0], 1), (8, [3.0, 2.0], 1), (100, [0.001, -0.001], 2), (None, [1.0, 1.0], 1), (-50, [1.0], 1), (150, [-1.0, -2.0], 0)]
    assert found(spark, rows, tmp_path) == brute([(r[0], r[1]) for r in rows])
    assert found(spark, [(0, [1.0], 1)], tmp_path / "one") == []
    assert found(spark, [], tmp_path / "none") == []


def test_large_components_stay_exact(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(k, (rng.normal(size=4) * 1e5).astype(np.float32).tolist(), 0) for k in range(60)]
    assert found(spark, rows, tmp_path) == brute([(r[0], r[1]) for r in rows])


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert from_spark(K.op10_maxscore_top_k(spark, sf)) == from_sql(connect(sf), K.ORACLE_SQL["op10_maxscore_top_k"])


def test_repeated_rows_take_a_rank_each(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "SHARD_ROWS", 3)
    rows = [(0, [1.0, 1.0], 0)] + [(1, [2.0, 2.0], 0)] * 3 + [(2, [2.0, 2.0], 0)] * 2 + [(3, [9.0, -1.0], 0), (50, [1.0, 0.0], 0), (50, [1.0, 0.0], 0)]
    out = found(spark, rows, tmp_path)
    assert out == brute([(r[0], r[1]) for r in rows])
    assert [x[2] for x in out if x[0] == 0] == [3, 1, 1, 1, 2]
