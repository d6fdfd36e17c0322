"""Near-duplicate texts of five-word similarity 0.8 or more, as the pipeline's stage wants them.

A text is the set of its WORDS-word shingles (lower-cased as in simhash_dedup). SimHash fingerprints of these sets find
pairs by the pivot tables of simhash_dedup, but a pair at similarity 0.8 differs by about ten of 64 bits, and no exact
search at that distance is cheap. So further candidates come from BANDS keys of ROWS smallest hashes each, which a pair at
0.8 has in common in one band or more with probability 1 - (1 - 0.8**3)**16, above 0.99999. No text that shares a key is
left out. First each text is paired within one key only, the largest that it shares: by set id, the first WHOLE + 1 all
with all, each further one with the first. Keys whose texts are then in different groups follow, all of them: of a key of up
to NEXT + 1 texts all pairs from different groups are candidates; the texts of a larger one meet in one task by their whole
sets, which finds all links between its groups and gives a spanning forest of them. Candidates more than MOST_FAR
bits apart in their fingerprints are discarded; the others are verified by the similarity of their sets: exactly for up to
SKETCH shingles, and beyond by the SKETCH smallest hashes of the union, or again by whole sets where that estimate is
within MARGIN of the limit. Components of the verified pairs are the groups.

Defined results: null, empty and blank texts have the empty set and are copies of one another; a text of fewer words than a
shingle is one shingle; a null doc_id counts in no minimum, and rows without an id all stay; repeated rows are copies; an
empty table gives no rows. Columns other than doc_id and text are carried along.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import simhash_dedup as simhash
from gridloom.llm.common import as_bytes, drop, map_rows, small_batches, written

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 3
SKETCH = 512
WHOLE, NEXT = 16, 16
#: Verdicts, and how near to SIMILARITY an estimate of cut sketches is unsure: over four standard errors.
NO, YES, UNSURE = 0, 1, 2
MARGIN = 0.08
MOST_FAR = 28
#: Candidates of one text that are compared at once.
AT_ONCE = 1024
_RNG = np.random.default_rng(5_000_808)
#: Multipliers and addends of the hashes whose smallest values make the bands.
_MULTIPLY, _ADD = (_RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1), _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64))
_POSITIONS = np.arange(8, dtype=np.int64) * 256
_PIECE = 1 << 14
SCHEMA = "doc_id long, tie long, sid long, fp long, n long, sketch binary, bands array<long>"


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """XXH64 hashes of the different shingles, ascending."""
    own = text.lower().split()
    if not own:
        return np.empty(0, np.uint64)
    if len(own) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(own), 42)], np.uint64)
    runs = zip(*(own[k:] for k in range(words)), strict=False)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, runs), repeat(42)), np.uint64, len(own) - words + 1))


def fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set: a bit is that of most of its members."""
    if not len(hashes):
        return 0
    counts = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _POSITIONS).ravel(), minlength=2048).reshape(8, 256) @ simhash._BITS
    return int(np.packbits((2 * counts > len(hashes)).ravel(), bitorder="little").view("<u8")[0])


def bands(hashes: np.ndarray) -> list[int]:
    """A key for each band: a hash of the set's smallest values under ROWS hash functions."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for s in range(0, len(hashes), _PIECE):
        part = hashes[s : s + _PIECE]
        mixed = part[None, :] * _MULTIPLY[:, None] + _ADD[:, None]
        mixed ^= mixed >> np.uint64(29)
        least = np.minimum(least, (mixed * np.uint64(0x9E3779B97F4A7C15)).min(axis=1))
    return [xxhash.xxh64_intdigest(bytes([b]) + least[b * ROWS : (b + 1) * ROWS].tobytes()) for b in range(BANDS)]


def sketched(docs: DataFrame) -> DataFrame:
    """SCHEMA for every document; sid stands for its set."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def rows(_, batch):
        out: list[list] = [[], [], [], [], []]
        for t in batch.column(1):
            own = shingle_set(t.as_py())
            for column, x in zip(out, (signed(xxhash.xxh64_intdigest(own.tobytes())), signed(fingerprint(own)), len(own), sketch(own).tobytes(), [signed(k) for k in bands(own)] if len(own) else []), strict=True):
                column.append(x)
        yield [batch.column(0), batch.column(2), *out]

    return map_rows(docs.select("doc_id", as_bytes(), F.xxhash64("text").alias("tie")), rows, SCHEMA)


def sketch(hashes: np.ndarray, most: int | None = SKETCH) -> np.ndarray:
    """The smallest of the set's hashes, mixed and cut to 32 bits, ascending."""
    return np.unique((hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32))[:most]


def judged(a: bytes, b: bytes, n: int, m: int) -> int:
    """Whether two sets of n and m members reach SIMILARITY, by their sketches: YES or NO, UNSURE where these are cut and
    their estimate is near it."""
    if min(n, m) < SIMILARITY * max(n, m):
        return NO
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    if max(n, m) <= SKETCH:
        return YES if reaches(x, y) else NO
    least = np.union1d(x, y)[:SKETCH]
    share = (np.isin(least, x, assume_unique=True) & np.isin(least, y, assume_unique=True)).mean()
    return UNSURE if abs(share - SIMILARITY) <= MARGIN else YES if share > SIMILARITY else NO


def reaches(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= SIMILARITY * (len(x) + len(y) - both)


def paired(keyed: DataFrame) -> DataFrame:
    """(u, v): of the texts (key, place, sid) that share a key the first WHOLE + 1 are paired all with all, which is every pair
    of most keys; each further one is paired with the first. A key's texts are read as a stream and not held."""
    dealt = keyed.repartition("key").sortWithinPartitions("key", "place", "sid").select("key", "sid")

    def run(batches):
        import pyarrow as pa

        keys = sids = np.empty(0, np.int64)
        first = held = 0  # of the last key: its first text, and how many came before what is kept of it
        for batch in batches:
            k, s = (np.concatenate((old, batch.column(i).to_numpy())) for i, old in enumerate((keys, sids)))
            start = len(keys)
            if len(k) == start:
                continue
            opens = np.append(True, k[1:] != k[:-1])
            at = np.maximum.accumulate(np.where(opens, np.arange(len(k)), 0))
            heads, place = s[at], np.arange(len(k)) - at
            if start and k[0] == k[start - 1]:  # the key at the front began before what is kept of it
                heads[k == k[0]] = first
                place[k == k[0]] += held
            u, v = [s[start:]], [heads[start:]]
            for back in range(1, WHOLE + 1):
                i = np.arange(max(start, back), len(k))
                i = i[(k[i] == k[i - back]) & (place[i] <= WHOLE)]
                u.append(s[i])
                v.append(s[i - back])
            kept = slice(max(0, len(k) - WHOLE), None)
            first, held = int(heads[-1]), int(place[kept][0]) if k[kept][0] == k[-1] else 0
            keys, sids = k[kept], s[kept]
            u, v = np.concatenate(u), np.concatenate(v)
            if (u != v).any():
                yield pa.RecordBatch.from_arrays([pa.array(u[u != v]), pa.array(v[u != v])], ["u", "v"])

    return dealt.mapInArrow(run, "u long, v long").distinct()


def apart(keyed: DataFrame) -> DataFrame:
    """(u, v): each text (key, place, sid, root) with those of the NEXT before it, of the same key, that have another root."""
    dealt = keyed.repartition("key").sortWithinPartitions("key", "place", "sid").select("key", "sid", "root")

    def run(batches):
        import pyarrow as pa

        tails = [np.empty(0, np.int64)] * 3
        for batch in batches:
            k, s, r = (np.concatenate((old, batch.column(i).to_numpy())) for i, old in enumerate(tails))
            start, u, v = len(tails[0]), [], []
            for back in range(1, NEXT + 1):
                i = np.arange(max(start, back), len(k))
                i = i[(k[i] == k[i - back]) & (r[i] != r[i - back])]
                u.append(s[i])
                v.append(s[i - back])
            tails = [x[max(0, len(x) - NEXT) :] for x in (k, s, r)]
            u, v = np.concatenate(u), np.concatenate(v)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return dealt.mapInArrow(run, "u long, v long").distinct()


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its length."""
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())


def forest(roots: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (i, j) of sets that reach SIMILARITY: a spanning forest of all such links between different roots.

    Of two sets that reach it, either misses few members of the other, so that they share one of their rarest members, as
    many as may be missed and one more. Only sets of different roots that share such a one are compared.
    """
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, member, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rarer = np.empty(len(counts), np.int64)
    rarer[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    member = rarer[member]
    member = member[np.lexsort((member, owner))]  # of each set, the rarest first
    begins = np.cumsum(sizes) - sizes
    rare = np.arange(len(member)) - begins[owner] <= sizes[owner] - np.ceil(SIMILARITY * sizes - 1e-6)[owner]
    lists, of = member[rare], owner[rare]
    order = np.argsort(lists, kind="stable")
    lists, of = lists[order], of[order]
    first = np.flatnonzero(np.append(True, lists[1:] != lists[:-1]))
    lengths = np.diff(np.append(first, len(lists)))
    mixed = np.minimum.reduceat(roots[of], first) != np.maximum.reduceat(roots[of], first)
    at, begin = np.arange(len(lists)), np.repeat(first, lengths)
    used = (at > begin) & np.repeat(mixed, lengths)  # each set meets those before it in its lists
    turn = at[used][np.argsort(of[used], kind="stable")]
    now, has = roots.copy(), np.zeros(len(counts), bool)
    out: list[tuple[int, int]] = []
    for places in np.split(turn, np.flatnonzero(np.diff(of[turn])) + 1) if len(turn) else []:
        i = int(of[places[0]])
        met = np.unique(of[ranges(begin[places], places - begin[places])])
        met = met[np.minimum(sizes[met], sizes[i]) >= SIMILARITY * np.maximum(sizes[met], sizes[i]) - 1e-6]
        own = member[begins[i] : begins[i] + sizes[i]]
        has[own] = True
        for s in range(0, len(met), AT_ONCE):
            part = met[s : s + AT_ONCE]
            part = part[now[part] != now[i]]
            if not len(part):
                continue
            both = np.add.reduceat(has[member[ranges(begins[part], sizes[part])]], np.cumsum(sizes[part]) - sizes[part], dtype=np.int64)
            for j in part[both >= SIMILARITY * (sizes[part] + sizes[i] - both)].tolist():
                if now[j] != now[i]:
                    now[now == now[j]] = now[i]
                    out.append((i, j))
        has[own] = False
    links = np.array(out, np.int64).reshape(-1, 2)
    return links[:, 0], links[:, 1]


def within(crowds: DataFrame) -> DataFrame:
    """(u, v): of the texts (key, sid, root, whole) of each key, a spanning forest of the links between different roots. A
    key's texts are held by one task."""
    dealt = crowds.repartition("key").sortWithinPartitions("key", "sid").select("key", "sid", "root", "whole")

    def joined(held):
        import pyarrow as pa

        sids, roots = (np.array([row[c] for row in held], np.int64) for c in (0, 1))
        u, v = forest(roots, [np.frombuffer(row[2], np.uint32) for row in held])
        return pa.RecordBatch.from_arrays([pa.array(sids[u]), pa.array(sids[v])], ["u", "v"])

    def run(batches):
        key, held = None, []
        for batch in batches:
            for k, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key and held:
                    yield joined(held)
                    held = []
                key = k
                held.append(row)
        if held:
            yield joined(held)

    small_batches(crowds.sparkSession)
    return dealt.mapInArrow(run, "u long, v long").distinct()


def verified(pairs: DataFrame, rows: DataFrame, docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The pairs (u, v) of sets that reach SIMILARITY, and the written tables that they are read from."""
    prints = rows.groupBy("sid").agg(F.min("fp").alias("fp"))
    near = pairs.join(prints.select(F.col("sid").alias("u"), F.col("fp").alias("_a")), "u").join(prints.select(F.col("sid").alias("v"), F.col("fp").alias("_b")), "v")
    near = written(near.where(F.bit_count(F.col("_a").bitwiseXOR(F.col("_b"))) <= MOST_FAR).select("u", "v"), "near-pairs")
    sets = rows.join(ends(near), "sid", "left_semi").groupBy("sid").agg(F.min(F.struct("n", "sketch")).alias("x"))
    sets = written(sets.select("sid", "x.n", "x.sketch"), "near-sets")

    def judge(_, batch):
        yield [batch.column(0), batch.column(1), [judged(a.as_py(), b.as_py(), n.as_py(), m.as_py()) for a, b, n, m in zip(*batch.columns[2:], strict=True)]]

    both = with_ends(near, sets, "sketch", "n").select("u", "v", "sketch0", "sketch1", "n0", "n1")
    said = written(map_rows(both, judge, "u long, v long, verdict int"), "near-verdicts")
    drop(near, sets)
    unsure = said.where(F.col("verdict") == UNSURE).select("u", "v")
    return said.where(F.col("verdict") == YES).select("u", "v").unionAll(exactly(unsure, rows, docs)), [said]


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("sid")).unionAll(pairs.select(F.col("v").alias("sid"))).distinct()


def with_ends(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """The pairs with the columns of both their sets, numbered 0 and 1."""
    named = lambda k, of: sets.select(F.col("sid").alias(of), *(F.col(c).alias(f"{c}{k}") for c in columns))
    return pairs.join(named(0, "u"), "u").join(named(1, "v"), "v")


def whole_sets(sids: DataFrame, rows: DataFrame, docs: DataFrame) -> DataFrame:
    """sid and whole, the set without a cut, made again from a document of each."""
    one = rows.join(sids, "sid", "left_semi").groupBy("sid").agg(F.min(F.struct("doc_id", "tie")).alias("x"))
    one = written(one.select("sid", F.col("x.doc_id").alias("_id"), F.col("x.tie").alias("_tie")), "near-unsure")
    texts = docs.select(F.col("doc_id").cast("long").alias("_doc"), as_bytes(), F.xxhash64("text").alias("_t"))
    texts = texts.join(one, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_tie"))).select("sid", "text")

    def whole(_, batch):
        yield [batch.column(0), [sketch(shingle_set(t.as_py()), None).tobytes() for t in batch.column(1)]]

    sets = written(map_rows(texts, whole, "sid long, whole binary").groupBy("sid").agg(F.min("whole").alias("whole")), "near-whole")
    drop(one)
    return sets


def exactly(unsure: DataFrame, rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the pairs that reach SIMILARITY by their whole sets."""
    sets = whole_sets(ends(unsure), rows, docs)

    def judge(_, batch):
        keep = np.flatnonzero([reaches(*(np.frombuffer(x.as_py(), np.uint32) for x in ab)) for ab in zip(batch.column(2), batch.column(3), strict=True)])
        yield [batch.column(0).to_numpy()[keep], batch.column(1).to_numpy()[keep]]

    out = written(map_rows(with_ends(unsure, sets, "whole").select("u", "v", "whole0", "whole1"), judge, "u long, v long"), "near-exact")
    drop(sets)
    return out


def with_roots(texts: DataFrame, stars: DataFrame) -> DataFrame:
    return texts.join(stars.withColumnsRenamed({"u": "sid", "v": "root"}), "sid", "left").withColumn("root", F.coalesce("root", "sid"))


def grouped(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """sid and the component_id, the smallest doc_id, of its group."""
    keyed = written(rows.select(F.explode("bands").alias("key"), "sid").distinct(), "near-keys")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    keyed, every = written(keyed.join(shared, "key").select("key", "n", F.col("sid").alias("place"), "sid"), "near-shared"), keyed
    drop(every)
    largest = keyed.groupBy("sid").agg(F.max(F.struct("n", "key")).alias("x")).select("x.key", F.col("sid").alias("place"), "sid")
    # by the pivot tables: fingerprints at most three bits apart, and sets that share a fingerprint
    classes = rows.groupBy("fp").agg(F.min("sid").alias("sid"))
    steps: list[DataFrame] = []
    close = simhash.links(classes, steps)
    one = lambda c: classes.select(F.col("fp").alias(c), F.col("sid").alias(f"_{c}"))
    pivots = close.join(one("u"), "u").join(one("v"), "v").select(F.col("_u").alias("u"), F.col("_v").alias("v"))
    same = rows.select("fp", "sid").distinct().join(classes.withColumnRenamed("sid", "v"), "fp").select(F.col("sid").alias("u"), "v")
    both = paired(largest).unionAll(pivots).unionAll(same).where("u <> v")
    ordered = lambda pairs: pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs = written(ordered(both), "near-candidates")
    drop(*steps)
    links, tables = verified(pairs, rows, docs)
    stars = simhash.components(links)
    rooted = with_roots(keyed, stars)
    mixed = rooted.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b")
    rooted = written(rooted.join(mixed, "key", "left_semi"), "near-mixed")
    rest = written(ordered(apart(rooted.where(F.col("n") <= NEXT + 1))).join(pairs, ["u", "v"], "left_anti"), "near-rest")
    more, more_tables = verified(rest, rows, docs)
    crowds = rooted.where(F.col("n") > NEXT + 1)
    wholes = whole_sets(crowds.select("sid").distinct(), rows, docs)
    crowded = written(within(crowds.join(wholes, "sid")), "near-crowded")
    first, stars = stars, simhash.components(links.unionAll(more).unionAll(crowded))
    drop(keyed, pairs, rooted, rest, wholes, crowded, first, *tables, *more_tables)
    sets = rows.groupBy("sid").agg(F.min("doc_id").alias("rep"))
    rooted = with_roots(sets, stars)
    heads = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    out = written(rooted.join(heads, "root").select("sid", "component_id"), "near-groups")
    drop(stars)
    return out


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, tie (a hash of the text) and component_id for every document."""
    rows = written(sketched(docs), "near-sketches")
    return rows.join(grouped(rows, docs), "sid").select("doc_id", "tie", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents whose id heads a group: one row each, with the columns of docs. Rows without an id all stay.

    Of rows that share an id, those whose own group it heads are asked, and the one whose text has the smallest hash stays.
    """
    heads = groups(docs).where("doc_id = component_id").groupBy("doc_id").agg(F.min("tie").alias("tie"))
    return simhash.heading(docs, heads)
