"""Language identification: held-out accuracy, rejection, edge cases."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from gridloom.llm import language_id as L
from tests.llm import cases

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = L.op6_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and r.lang is not None]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    sure = [r for r in held if r.accepted]
    assert len(sure) > 0.9 * len(held) and np.mean([r.lang_pred == r.lang for r in sure]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_held_out_rows_and_other_columns_are_never_read(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    other = docs.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    a = {r.doc_id: (r.lang_pred, round(r.score, 6)) for r in L.op6_language_id(spark, SF).collect()}
    b = {r.doc_id: (r.lang_pred, round(r.score, 6)) for r in L.op6_language_id(spark, cases.put(spark, tmp_path, documents=other.repartition(5))).collect()}
    assert a == b


def test_edge_cases(spark):
    model = L.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = L.identified(cases.documents(spark), model).collect()
    assert len(rows) == len(cases.rows())
    by_id: dict = {}
    for r in rows:
        by_id.setdefault(r.doc_id, set()).add(r.lang_pred)
    for k in (0, 1, 2, 11):
        assert by_id[k] == {"und"}
    assert by_id[8] != {"und"}
    assert {r.lang_pred for r in L.identified(cases.documents(spark), L.fit(cases.empty(spark))).collect()} == {"und"}
    assert L.identified(cases.empty(spark), model).count() == 0
    assert L.fit(cases.documents(spark)).names == ["de", "en"]


def test_letters():
    assert not any(map(L.has_letter, (b"", b"12 !?", "٣ ²".encode())))
    assert all(map(L.has_letter, (b"a", "日".encode(), "1é".encode())))


def test_pieces_of_a_long_text_give_the_same_buckets(monkeypatch):
    text = ("Über words and wörter " * 30).encode()
    whole = np.sort(np.concatenate(list(L.buckets(text))))
    monkeypatch.setattr(L, "_PIECE", 64)
    assert (np.sort(np.concatenate(list(L.buckets(text)))) == whole).all()


def many_languages(n: int, each: int, seed: int = 5) -> list[tuple[int, str, str]]:
    """(doc_id, text, lang): every language has words of its own."""
    rng = np.random.default_rng(seed)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    out = []
    for k in range(n):
        own = rng.choice(letters, 9, replace=False)
        words = ["".join(rng.choice(own, rng.integers(2, 8))) for _ in range(40)]
        out += [(len(out) + d, " ".join(rng.choice(words, 60)), f"l{k:03}") for d in range(each)]
    return out


def test_every_language_can_be_predicted(spark):
    rows = many_languages(500, 24)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = L.fit(docs)
    assert len(model.names) == 500
    found = L.identified(docs, model).collect()
    lang = {k: name for k, _, name in rows}
    held = [(lang[r.doc_id], r.lang_pred) for r in found if r.held_out]
    assert {p for _, p in held} == set(model.names) and np.mean([a == b for a, b in held]) > 0.95


def test_the_sample_is_the_first_by_hash_and_bounded(spark):
    rows = [(k, "t", "main" if k % 10 else f"l{k % 3}") for k in range(6000)] + [(7, "t", "main")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sizes = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("_lid_n"))
    got = {(r.doc_id, r.lang) for r in L.sampled(docs, sizes, 20).collect()}
    hashed = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit(L.SEED)).alias("h")).distinct().collect()}
    want = set()
    for name in ("main", "l0", "l1", "l2"):
        own = sorted({k for k, _, x in rows if x == name}, key=lambda k: (hashed[k], k))
        want |= {(k, name) for k in own[:20]}
    assert got == want
