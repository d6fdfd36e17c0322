"""SimHash near-duplicates against brute force over all pairs."""

import re

import numpy as np
import pytest
import xxhash

from gridloom.llm import simhash_dedup as S
from tests.llm import cases

UPPER = {c: c + 32 for c in range(65, 91)}


def brute_print(text) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints: list[int], ids: list) -> list:
    f = np.array(prints, np.uint64)
    root = list(range(len(f)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= 3) + i + 1:
            a, b = top(i), top(int(j))
            root[max(a, b)] = min(a, b)
    least: dict = {}
    for i, d in enumerate(ids):
        r = top(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return [least.get(top(i)) for i in range(len(ids))]


def check(spark, pairs):
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in S.near_duplicates(df).collect())
    prints = [brute_print(t) for _, t in pairs]
    comps = brute_components(prints, [d for d, _ in pairs])
    assert got == sorted((str(d), f"{p:016x}", str(c)) for (d, _), p, c in zip(pairs, prints, comps, strict=True))


def test_real_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(spark, [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])


def test_generated_documents(spark):
    check(spark, cases.generated(300))


def test_edge_cases(spark):
    rows = [r for r in cases.rows()]
    df = cases.documents(spark)
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in S.near_duplicates(df).collect())
    prints = [brute_print(r[1]) for r in rows]
    comps = brute_components(prints, [r[0] for r in rows])
    assert got == sorted((str(r[0]), f"{p:016x}", str(c)) for r, p, c in zip(rows, prints, comps, strict=True))
    assert S.near_duplicates(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("most", [2, 8, 4096])
def test_large_groups_are_split_without_loss(spark, monkeypatch, most):
    """Many fingerprints that share bands: each level of splitting must keep every link."""
    monkeypatch.setattr(S, "GROUP_MOST", most)
    monkeypatch.setattr(S, "BATCH_LEAST", 16)
    rng = np.random.default_rng(most)
    base = rng.integers(0, 1 << 62, 6)
    prints = {int(b) for b in base}
    for b in base:
        for _ in range(60):
            flips = rng.choice(64, rng.integers(1, 6), replace=False)
            x = int(b)
            for f in flips:
                x ^= 1 << int(f)
            prints.add(x - (1 << 64) if x >= 1 << 63 else x)
    prints = sorted(prints)
    classes = spark.createDataFrame([(p, k, 1) for k, p in enumerate(prints)], "fp long, rep long, n_same long").repartition(4)
    stars = {r.u: r.v for r in S.components(S.links(classes)).collect()}
    want = brute_components([p & 0xFFFFFFFFFFFFFFFF for p in prints], list(range(len(prints))))
    groups: dict = {}
    for p, c in zip(prints, want, strict=True):
        groups.setdefault(c, set()).add(p)
    got: dict = {}
    for p in prints:
        got.setdefault(stars.get(p, p), set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_a_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(200)], "u long, v long")
    assert {(r.u, r.v) for r in S.components(edges).collect()} == {(k, 0) for k in range(1, 201)}


def test_one_of_each(spark):
    df = cases.documents(spark)
    kept = S.one_of_each(df)
    assert kept.schema == df.schema
    rows = kept.collect()
    comps = {r.doc_id: r.component_id for r in S.near_duplicates(df).where("doc_id is not null").collect()}
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(d for d in set(comps) if any(c == d for c in comps.values()))
    assert sum(r.doc_id is None for r in rows) == 2


def test_the_row_that_stays_heads_its_own_component(spark):
    """Each even id has a text of its own, which it heads, and a copy of text 0: whatever the hashes, its own text stays."""
    texts = [f"text {k} of words that {k * 7} no other {k * 13} text has {k * 29} at all {k}" for k in range(9)]
    prints = [brute_print(t) for t in texts]
    assert min((a ^ b).bit_count() for i, a in enumerate(prints) for b in prints[:i]) > 3
    pairs = [(0, texts[0])] + [(2 * k, t) for k in range(1, 9) for t in (texts[k], texts[0])] + [(2 * k + 1, texts[k]) for k in range(1, 9)]
    kept = S.one_of_each(spark.createDataFrame(pairs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(2 * k, t) for k, t in enumerate(texts)]
