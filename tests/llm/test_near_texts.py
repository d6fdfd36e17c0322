"""Near texts of five-word similarity 0.8 or more against all pairs."""

import random

import numpy as np
import pytest

from gridloom.llm import near_texts as N
from tests.llm import cases


def sets_of(rows) -> list[tuple]:
    out = []
    for doc_id, text in rows:
        words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
        out.append((doc_id, frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])))
    return out


def brute(rows) -> dict[int, int]:
    """Row number -> smallest doc_id of its component, by all pairs of different sets."""
    sets = sets_of(rows)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a == b or a and b and 5 * len(a & b) >= 4 * len(a | b):
                parent[find(i)] = find(j)
    least: dict = {}
    for k, (doc_id, _) in enumerate(sets):
        if doc_id is not None:
            least[find(k)] = min(doc_id, least.get(find(k), doc_id))
    return {k: least.get(find(k)) for k in range(len(sets))}


def edited(n: int, seed: int, size: int) -> list[tuple[int, str]]:
    """Texts of which many are others with some words replaced, moved, left out or added, about 0.8."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(3000)]
    out: list[tuple[int, str]] = []
    for k in range(n):
        if out and rng.random() < 0.6:
            own = rng.choice(out)[1].split()
            for _ in range(rng.randint(0, max(1, len(own) // 30))):
                at = rng.randrange(len(own))
                own[at : at + rng.randint(0, 1)] = [rng.choice(words)] * rng.randint(0, 2)
        else:
            own = [rng.choice(words) for _ in range(rng.randint(1, size))]
        out.append((k, " ".join(own) or "x"))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("seed", "size", "sketch"), [(1, 200, 512), (2, 400, 64), (3, 30, 512)])
def test_groups_equal_all_pairs(spark, monkeypatch, seed, size, sketch):
    monkeypatch.setattr(N, "SKETCH", sketch)
    monkeypatch.setattr(N, "MARGIN", 0.25 if sketch == 64 else N.MARGIN)
    rows = edited(300, seed, size)
    want = {rows[k][0]: c for k, c in brute(rows).items()}
    got = {r.doc_id: r.component_id for r in N.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == want and len(set(want.values())) < 0.8 * len(rows)


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(6)
    base = [f"v{rng.randrange(500)}" for _ in range(120)]
    rows = []
    for k in range(400):
        own = list(base)
        own[rng.randrange(len(own))] = f"z{k}"
        rows.append((k, " ".join(own)))
    rows += [(1000 + k, " ".join(f"u{rng.randrange(500)}" for _ in range(80))) for k in range(50)]
    kept = sorted(r.doc_id for r in N.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())
    assert kept == [0, *range(1000, 1050)]
    pairs = N.paired(spark.createDataFrame([(1, k, k) for k in range(3000)] + [(2, k, k) for k in range(3)], "key long, place long, sid long").repartition(3))
    assert pairs.count() <= 3000 + N.WHOLE**2


@pytest.mark.parametrize("rows", [1, 7, 10_000])
def test_pairs_of_a_key_do_not_depend_on_batches(spark, rows):
    rng = np.random.default_rng(rows)
    keyed = sorted({(int(k), int(s)) for k, s in zip(rng.integers(0, 4, 400) * rng.integers(1, 4, 400), rng.integers(-10**6, 10**6, 400), strict=True)})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        got = {tuple(r) for r in N.paired(spark.createDataFrame([(k, s, s) for k, s in keyed], "key long, place long, sid long")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 512)
    want = set()
    for k in range(10):
        own = [s for x, s in keyed if x == k]
        want |= {(own[i], own[j]) for i in range(len(own)) for j in ({0} if i > N.WHOLE else range(i)) if i != j}
    assert got == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        got = {tuple(r) for r in N.apart(spark.createDataFrame([(k, s, s, s % 3) for k, s in keyed], "key long, place long, sid long, root long")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 512)
    ordered = {k: [s for x, s in keyed if x == k] for k in range(10)}
    assert got == {(own[i], own[j]) for own in ordered.values() for i in range(len(own)) for j in range(max(0, i - N.NEXT), i) if own[i] % 3 != own[j] % 3}


def test_edge_cases(spark):
    docs = cases.documents(spark)
    rows = [(r[0], r[1]) for r in cases.rows()]
    got = sorted((str(r.doc_id), str(r.component_id)) for r in N.groups(docs).collect())
    assert got == sorted((str(rows[k][0]), str(c)) for k, c in brute(rows).items())
    kept = N.one_of_each(docs)
    assert kept.schema == docs.schema and sum(r.doc_id is None for r in kept.collect()) == 2
    assert N.one_of_each(cases.empty(spark)).count() == 0 and N.groups(cases.empty(spark)).count() == 0


def altered(rng: random.Random, tag: str, size: int, times: int) -> list[str]:
    """A new text of words of its own, and copies of it with one word replaced: about 0.8 or more to one another."""
    own = [f"{tag}{rng.randrange(10**6)}" for _ in range(size)]
    out = [" ".join(own)]
    for k in range(times):
        other = list(own)
        other[rng.randrange(size)] = f"{tag}x{k}"
        out.append(" ".join(other))
    return out


def test_no_link_of_a_crowded_key_is_lost(spark):
    """One key holds 360 texts of 120 groups: no order of it makes all the near ones neighbours."""
    rng = random.Random(11)
    texts = [t for g in range(120) for t in altered(rng, f"g{g}w", rng.randint(60, 700), 2)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    prints = N.written(N.sketched(docs).selectExpr("doc_id", "tie", "sid", "fp", "n", "sketch", "array(7L) bands"), "test-crowded")
    got = {r.doc_id: r.component_id for r in prints.join(N.grouped(prints, docs), "sid").collect()}
    assert got == {rows[k][0]: c for k, c in brute(rows).items()}


@pytest.mark.parametrize(("seed", "least"), [(1, 1), (2, 20), (3, 90)])
def test_forest_equals_all_pairs(monkeypatch, seed, least):
    monkeypatch.setattr(N, "AT_ONCE", 7)
    rng = np.random.default_rng(seed)
    common = rng.integers(0, 1 << 32, 40, dtype=np.uint32)
    sets = []
    for _ in range(150):
        size = int(rng.integers(least, least + 60))
        own = rng.integers(0, 1 << 32, size, dtype=np.uint32)
        if sets and rng.random() < 0.6:
            own = sets[int(rng.integers(len(sets)))].copy()
            own[rng.integers(0, len(own), int(rng.integers(0, 1 + len(own) // 8)))] = rng.integers(0, 1 << 32)
        sets.append(np.unique(np.concatenate([own, common]) if rng.random() < 0.1 else own))
    roots = np.arange(150)
    roots[100:] = 100
    u, v = N.forest(roots, sets)
    want = roots.copy()
    near = [(i, j) for i in range(150) for j in range(i) if N.reaches(sets[i], sets[j])]
    for i, j in near:
        want[want == want[i]] = want[j]
    got = roots.copy()
    for i, j in zip(u, v, strict=True):
        assert (max(i, j), min(i, j)) in near and got[i] != got[j]
        got[got == got[i]] = got[j]
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want)) == 101 - len(u) and len(u)


@pytest.mark.parametrize("rows", [1, 7, 512])
def test_links_within_a_key_do_not_depend_on_batches(spark, rows):
    """A group of near copies gives a link for each text but one, and keys do not mix."""
    rng = random.Random(5)
    sets = [N.sketch(N.shingle_set(t.encode()), None).tobytes() for t in altered(rng, "w", 300, 99)]
    keyed = [(k, s, s, x) for k in (1, 2, 3) for s, x in enumerate(sets) if k < 3 or s < 2]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        got = N.within(spark.createDataFrame(keyed, "key long, sid long, root long, whole binary").repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 512)
    assert 99 <= len(got) and len(set(got)) == len(got) <= 100 and {r.u for r in got} == set(range(1, 100))
