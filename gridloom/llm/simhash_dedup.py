"""SimHash near-duplicates by pivot distance tables.

Fingerprints are grouped by value first, so that copies meet once. Candidates come from exact bit bands: two
fingerprints at most three bits apart agree in one of four bands, and a band value that too many fingerprints share is
split by four bands of the bits that are left, again and again, which loses no pair. Within a band value, tables hold
the Hamming distances to many reference fingerprints: by the triangle inequality a pair whose distances to any one
reference differ by more than three is discarded; the survivors are verified bit by bit. Only a spanning forest of a
band value's links is kept, never all pairs of a group. Components then follow from large-star and small-star steps.

Defined results: a null, empty or blank text has fingerprint zero and is linked like any other; a null doc_id counts
in no minimum, and a component of null ids alone has a null component_id; repeated rows give repeated rows; an empty
table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import as_bytes, drop, map_rows, table, written

SHINGLE = 3
MOST_BITS = 3
#: Widths of the bands by level: each level splits the bits that its ancestors left over into four. The last one leaves
#: 11 bits, in which at most 2,048 different fingerprints can differ, so that no group of it is large.
LEVELS = (16, 12, 9, 7, 5, 4)
#: A band value that more fingerprints share is split at the next level.
GROUP_MOST = 4096
#: Rows of whole groups that are compared at once.
BATCH_LEAST = 32_768
#: The reference fingerprints of the distance tables.
PIVOTS = np.random.default_rng(20_240_229).integers(0, 1 << 63, 24, dtype=np.uint64) << np.uint64(1) | np.random.default_rng(7).integers(0, 2, 24, dtype=np.uint64)
_POSITIONS = np.arange(8, dtype=np.int64) * 256
_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def fingerprint(text: bytes) -> int:
    """SimHash over the XXH64 hashes (seed 42) of all 3-word shingles of the lower-cased text."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    if n < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)  # one shingle: each bit is set in all of them or none
    m = n - SHINGLE + 1
    h = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(words, words[1:], words[2:], strict=False)), repeat(42)), np.uint64, m)
    counts = np.bincount((h.view(np.uint8).reshape(m, 8) + _POSITIONS).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits((2 * counts > m).ravel(), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, tie: bool = False) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and, if asked for, tie: a hash of the text as it is."""

    def rows(_, batch):
        fps = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
        yield [batch.column(0), fps.view(np.int64), *batch.columns[2:]]

    return map_rows(docs.select("doc_id", as_bytes(), *([F.xxhash64("text").alias("tie")] if tie else [])), rows, "doc_id long, fp long" + (", tie long" if tie else ""))


def forest(keys: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """For rows sorted by key, the index of each row's root: rows of a key that links connect share the smallest index."""
    n = len(fps)
    u = fps.view(np.uint64)
    distances = np.bitwise_count(u[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    order = np.lexsort((distances[:, 0], keys))
    keys, u, distances = keys[order], u[order], distances[order]
    first = distances[:, 0].copy()
    root = np.arange(n)
    alive = np.arange(n - 1)
    step = 0
    while len(alive):
        step += 1
        alive = alive[alive + step < n]
        other = alive + step
        near = (keys[alive] == keys[other]) & (first[other] - first[alive] <= MOST_BITS)  # sorted by the first table
        alive, other = alive[near], other[near]
        open_pairs = root[alive] != root[other]
        a, b = alive[open_pairs], other[open_pairs]
        for column in range(1, len(PIVOTS), 4):
            if not len(a):
                break
            ok = np.abs(distances[a, column : column + 4] - distances[b, column : column + 4]).max(axis=1) <= MOST_BITS
            a, b = a[ok], b[ok]
        if len(a):
            ok = np.bitwise_count(u[a] ^ u[b]) <= MOST_BITS
            joined(root, a[ok], b[ok])
    out = np.empty(n, np.int64)
    out[order] = order[root]
    return out


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the trees of a and b pairwise, in place; afterwards root[i] is the smallest index of i's tree."""
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        if not len(a):
            return
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root[:] = up


def split(rows: DataFrame, width_left: int, band: int) -> DataFrame:
    """Rows (key, fp, rest) for each of the four bands of the bits that are left: rest loses the band's bits."""
    parts = []
    for i in range(4):
        low = i * band
        wide = band if i < 3 else width_left - 3 * band
        bits = F.shiftrightunsigned("rest", low).bitwiseAND(F.lit((1 << wide) - 1))
        below = F.col("rest").bitwiseAND(F.lit((1 << low) - 1))
        above = F.shiftrightunsigned(F.shiftrightunsigned("rest", low), wide)
        parts.append(F.struct(F.xxhash64("key", F.lit(i), bits).alias("key"), F.shiftleft(above, low).bitwiseOR(below).alias("rest")))
    return rows.withColumn("_part", F.explode(F.array(*parts))).select(F.col("_part.key").alias("key"), "fp", F.col("_part.rest").alias("rest"))


def band_links(rows: DataFrame, last: bool) -> DataFrame:
    """kind 0: a link (a, b) of a spanning forest; kind 1: a fingerprint a with rest b of a group that is too large."""
    dealt = rows.repartition("key").sortWithinPartitions("key")

    def compared(keys: np.ndarray, fps: np.ndarray) -> list:
        root = forest(keys, fps)
        at = np.flatnonzero(root != np.arange(len(root)))
        return [np.zeros(len(at), np.int32), keys[at], fps[at], fps[root[at]]]

    def run(batches):
        import pyarrow as pa

        names = ["kind", "key", "a", "b"]
        emit = lambda cols: pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        count, large = 0, None
        for batch in batches:
            k, f, r = (batch.column(i).to_numpy() for i in range(3))
            if large is not None:  # the rest of a group that is being passed on
                m = int(np.searchsorted(k != large, True)) if (k == large).any() else 0
                if m:
                    yield emit([np.ones(m, np.int32), k[:m], f[:m], r[:m]])
                    k, f, r = k[m:], f[m:], r[m:]
                if not len(k):
                    continue
                large = None
            held.append((k, f, r))
            count += len(k)
            if count < BATCH_LEAST:
                continue
            k, f, r = map(np.concatenate, zip(*held, strict=True))
            end = int(np.searchsorted(k, k[-1]))  # the last group may go on
            if end:
                yield from groups(k[:end], f[:end], r[:end], emit)
            k, f, r = k[end:], f[end:], r[end:]
            if len(k) > GROUP_MOST and not last:
                yield emit([np.ones(len(k), np.int32), k, f, r])
                large, held, count = k[0], [], 0
            else:
                held, count = [(k, f, r)], len(k)
        if count:
            yield from groups(*map(np.concatenate, zip(*held, strict=True)), emit)

    def groups(k, f, r, emit):
        if not last:
            edges = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1], [True])))
            big = np.repeat(np.diff(edges) > GROUP_MOST, np.diff(edges))
            if big.any():
                yield emit([np.ones(int(big.sum()), np.int32), k[big], f[big], r[big]])
                k, f = k[~big], f[~big]
        if len(k):
            yield emit(compared(k, f))

    return dealt.mapInArrow(run, "kind int, key long, a long, b long")


def links(classes: DataFrame, steps: list[DataFrame] | None = None) -> DataFrame:
    """(u, v) with u > v: links among distinct fingerprints fp that connect whatever is connected at three bits.

    steps gets the written tables that they are read from."""
    steps = [] if steps is None else steps
    rows = classes.select(F.lit(0).cast("long").alias("key"), "fp", F.col("fp").alias("rest"))
    found, left = None, 64
    for level, band in enumerate(LEVELS):
        last = level == len(LEVELS) - 1
        out = written(band_links(split(rows, left, band), last), f"simhash-bands-{level}")
        steps.append(out)
        edges = out.where("kind = 0").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        found = edges if found is None else found.unionAll(edges)
        rows = out.where("kind = 1").select("key", F.col("a").alias("fp"), F.col("b").alias("rest"))
        left -= band
        if last or rows.isEmpty():
            return found.distinct()
    raise AssertionError


def components(edges: DataFrame) -> DataFrame:
    """Stars (u, v): every node u that is not the least of its component, with that least node v.

    Large-star and small-star steps in turn; a node's minimum is pre-aggregated, and a hub's rows are joined to it by
    a join that may be split for skew. Each round ends in a written table.
    """
    stars, before = written(edges, "stars"), None
    while True:
        both = stars.unionAll(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).distinct()
        done, stars = stars, written(small, "stars")
        drop(done)
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(now) == before:
            return stars
        before = tuple(now)


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def grouped(prints: DataFrame) -> DataFrame:
    """fp, the component_id of its component, and the number of documents with the same fingerprint."""
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_same"))
    steps: list[DataFrame] = []
    stars = components(links(classes, steps))
    drop(*steps)
    rooted = classes.join(stars.withColumnsRenamed({"u": "fp", "v": "root"}), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    heads = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    out = written(rooted.join(heads, "root").select("fp", "component_id", "n_same"), "simhash-classes")
    drop(stars)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id and the number of documents with the same fingerprint."""
    prints = written(fingerprints(docs), "simhash")
    return prints.join(grouped(prints), "fp").select("doc_id", hexed(F.col("fp")).alias("fingerprint"), "component_id", "n_same")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents whose id heads a component: one row each, with the columns of docs. Rows without an id all stay.

    Of rows that share an id, those whose own component it heads are asked, and the one whose text has the smallest hash stays.
    """
    prints = written(fingerprints(docs, tie=True), "simhash")
    heads = prints.join(grouped(prints), "fp").where("doc_id = component_id").groupBy("doc_id").agg(F.min("tie").alias("tie"))
    return heading(docs, heads)


def heading(docs: DataFrame, heads: DataFrame) -> DataFrame:
    """The rows of docs that heads (doc_id, and tie, the hash of the text) names, one each, and those without an id."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    kept = rows.where(F.col("doc_id").isNotNull()).join(heads, ["doc_id", "tie"], "left_semi")
    first = Window.partitionBy("doc_id", "tie").orderBy("tie")
    kept = kept.withColumn("n", F.row_number().over(first)).where("n = 1")
    return kept.select("row.*").unionByName(docs.where(F.col("doc_id").isNull()))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
