"""Quality rules against a direct count."""

import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import quality_rules as Q
from tests.llm import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text) -> dict:
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = len(lines) - len(set(lines))
    found = Counter(tuple(words[i : i + 8]) for i in range(n - 7))
    inside = {k for i in range(n - 7) if found[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    failed = n < 20 or 100 * len(inside) > 30 * n
    chars = sum(map(len, words))
    kept, top, again = not failed, 0.0, 0.0
    for k, limit in Q.TOP_LIMITS.items():
        grams = Counter(tuple(words[i : i + k]) for i in range(n - k + 1))
        most = max(grams.values(), default=0)
        if most < Q.TOP_LEAST:
            break
        g = max((g for g, c in grams.items() if c == most), key=lambda g: sum(map(len, g)))  # of ties the first in the text
        at = {j for i in range(n - k + 1) if tuple(words[i : i + k]) == g for j in range(i, i + k)}
        share = sum(len(words[j]) for j in at) / chars
        top = max(top, share)
        kept &= share <= limit
    for k, limit in Q.DUP_LIMITS.items():
        seen, at = set(), set()
        for i in range(n - k + 1):
            g = tuple(words[i : i + k])
            if g in seen:
                at.update(range(i, i + k))
            seen.add(g)
        share = sum(len(words[j]) for j in at) / chars if chars else 0.0
        again = max(again, share)
        kept &= share <= limit
    return {"n_words": n, "word_chars": chars, "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": dup, "n_repeat_words": len(inside), "base_failed": failed, "dup_gram_share": again, "top_gram_share": top, "kept": kept and line_share(lines) <= Q.DUP_LINE_LIMIT}


def line_share(lines) -> float:
    sizes = [len(x.encode()) for x in lines]
    return sum(n for k, n in enumerate(sizes) if lines[k] in lines[:k]) / max(1, sum(sizes))


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def check(rows, docs):
    got = sorted((str(r.doc_id), *(r[c] for c in BASE)) for r in rows)
    assert got == sorted((str(d), *(brute(t)[c] for c in BASE)) for d, t in docs)
    assert not any(r.kept and r.base_failed for r in rows)


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = Q.op9_quality_rules(spark, sf).collect()
    check(rows, list(docs.items()))
    for r in rows:
        want = brute(docs[r.doc_id])
        assert r.kept == want["kept"]
        assert abs(r.dup_gram_share - want["dup_gram_share"]) < 1e-9 and abs(r.top_gram_share - want["top_gram_share"]) < 1e-9


def test_edge_cases(spark):
    long = cases.LONG.split(" ")
    small = [(r[0], r[1] if r[1] is None or len(r[1]) < 100_000 else None) for r in cases.rows()]
    check(Q.quality(spark.createDataFrame(small, "doc_id long, text string")).collect(), small)
    rows = Q.quality(cases.documents(spark)).collect()
    assert len(rows) == len(cases.rows()) and {r.n_words for r in rows if r.doc_id == 9} == {len(long)}
    assert Q.quality(cases.empty(spark)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "cc", "é", "\n", " ", "#"]), max_size=60))
def test_generated_texts(parts):
    text = " ".join(parts)
    got = dict(zip([c.split()[0] for c in Q.SCHEMA.split(", ")][1:], Q.measure(text.encode()), strict=True))
    want = brute(text)
    assert {c: got[c] for c in (*BASE, "kept")} == {c: want[c] for c in (*BASE, "kept")}


def test_sql(spark, tmp_path):
    from tests.compare import connect, from_spark, from_sql

    small = [(r[0], r[1] if r[1] is None or len(r[1]) < 100_000 else "b b " * 20) for r in cases.rows()]
    folder = cases.put(spark, tmp_path, documents=spark.createDataFrame(small, "doc_id long, text string"))
    for sf in ("/root/testdata/sf0.01", folder):
        assert from_spark(Q.op9_quality_rules(spark, sf)) == from_sql(connect(sf), Q.ORACLE_SQL["op9_quality_rules"])


def test_rolled_hashes_are_equal_exactly_for_equal_windows():
    words = np.random.default_rng(0).integers(0, 3, 500)
    h = (words.astype(np.uint64) + np.uint64(17)) * np.uint64(0x9E3779B97F4A7C15)
    for n in range(1, 11):
        windows = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        rolled = Q.rolled(h, n).tolist()
        assert len(rolled) == len(windows) and len(set(zip(rolled, windows, strict=True))) == len(set(rolled)) == len(set(windows))
