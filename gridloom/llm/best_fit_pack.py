"""Best-fit packing by a linear grouping scheme.

Only the histogram of piece lengths (as many numbers as a sequence has tokens) is planned on the driver. Large lengths
are split into groups of equal cardinality, at most MOST_SIZES, and rounded up to their group's largest; the few sizes
that result are combined into configurations, each a best filling of a sequence. Then actual documents are substituted:
a slot takes the longest document of its group, the last slot the longest one of any group that fits the room which the
others left, and room for another large document is filled in the same way. Small pieces are best-fitted into the rest.
Several numbers of groups are planned and the one with the fewest sequences is taken. The plan is a list of runs:
documents of a length, by rank, to a range of sequences.

Ids are those of the plain call of the vocabulary's JSON form: a special string in a text (`<|endoftext|>`) is its id.

The ranks are made apart: documents of a length are dealt to buckets by hash, counts by bucket are summed ahead, and a
bucket is numbered by itself, so that a length that a third of all documents have is no hot group.

Defined results: a null text counts as empty, one token long (the end id); repeated rows are packed as often as they
occur; null ids are carried along; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import as_bytes, map_rows, table, written
from gridloom.llm.tokens import as_text, encoder

SIZE = 1024
END = 2
BUCKET_ROWS = 50_000
#: Sizes that large lengths are rounded to at most, the numbers of groups that are tried, and the share of a sequence from
#: which a length is large.
MOST_SIZES = 64
GROUPS = (8, 16, 32, MOST_SIZES)
LARGE = 1 / 8
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, size: int = SIZE, place: str | None = None) -> DataFrame:
    """The pieces of every document: its ids and the end id, cut from the end, so that the first piece may be shorter."""

    def rows(encode, batch):
        out: list[list] = [[], [], [], [], []]
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = np.append(encode(as_text(text.as_py())), np.uint32(END)).astype("<u4")
            first = (len(ids) - 1) % size + 1
            for k, start in enumerate([0, *range(first, len(ids), size)]):
                part = ids[start : first if not k else start + size]
                for column, x in zip(out, (doc_id, k, start, len(part), zlib.crc32(part.tobytes())), strict=True):
                    column.append(x)
        yield out

    return map_rows(docs.select("doc_id", as_bytes()), rows, PIECES, once=lambda: encoder(place, special=True))


@dataclass
class Plan:
    """Runs: the rank-th document of a length goes to sequence first_seq + (rank - rank0) // each, and so on."""

    size: int
    n: int = 0
    runs: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)  # length, rank0, n, each, first_seq, offset
    used: dict[int, int] = field(default_factory=dict)
    open: dict[int, list[tuple[int, int]]] = field(default_factory=dict)  # room -> (first_seq, number) of sequences
    sizes: list[int] = field(default_factory=list)  # that large lengths were rounded to

    def place(self, length: int, n: int, each: int, first_seq: int, offset: int) -> None:
        rank = self.used.get(length, 0)
        self.runs.append((length, rank, n, each, first_seq, offset))
        self.used[length] = rank + n

    def leave(self, room: int, first_seq: int, number: int) -> None:
        if number and room:
            self.open.setdefault(room, []).append((first_seq, number))


def grouped(counts: np.ndarray, least: int, groups: int) -> tuple[list[int], np.ndarray]:
    """The rounded sizes, largest first, and the group of each length (-1: small): about equal numbers of documents each."""
    of = np.full(len(counts), -1)
    lengths = np.flatnonzero(counts)
    lengths = lengths[lengths >= least][::-1]
    if not len(lengths):
        return [], of
    before = np.cumsum(counts[lengths]) - counts[lengths]
    _, own = np.unique(before * groups // counts[lengths].sum(), return_inverse=True)
    of[lengths] = own
    return [int(lengths[own == g].max()) for g in range(own.max() + 1)], of


def filling(sizes: list[int], left: list[int], room: int) -> list[int]:
    """Numbers of each size (largest first) that fill the room best, none above what is left; larger sizes are preferred.

    Sums that can be reached are bits of one number; the sizes are then read back from the smallest."""
    reach, before = 1, []
    within = (1 << (room + 1)) - 1
    for size, n in zip(sizes, left, strict=True):
        before.append(reach)
        for k in range(1, min(n, room // size) + 1):
            reach |= before[-1] << k * size & within
        if reach >> room:
            break
    best = reach.bit_length() - 1
    out = [0] * len(sizes)
    for i in range(len(before) - 1, -1, -1):
        while not before[i] >> best & 1:
            # the least number of this size that leads back to a sum of the larger ones
            out[i] = next(k for k in range(1, left[i] + 1) if k * sizes[i] <= best and before[i] >> best - k * sizes[i] & 1)
            best -= out[i] * sizes[i]
    return out


def substituted(slots: list[int], of: np.ndarray, left: np.ndarray, size: int, least: int) -> list[int]:
    """Actual lengths for a configuration's slots (groups, largest first)."""
    out, room, free = [], size, left.copy()

    def take(fitting: np.ndarray) -> bool:
        nonlocal room
        if not len(fitting):
            return False
        out.append(int(fitting[-1]))
        free[fitting[-1]] -= 1
        room -= int(fitting[-1])
        return True

    for group in slots[:-1]:
        take(np.flatnonzero((free[: room + 1] > 0) & (of[: room + 1] == group)))
    while room >= least and take(np.flatnonzero((free[: room + 1] > 0) & (of[: room + 1] >= 0))):
        pass
    return out


def plan(counts: np.ndarray, groups: int, size: int = SIZE, large: float = LARGE) -> Plan:
    """counts[length]: documents of that length, 0 to size."""
    made = Plan(size)
    least = max(1, int(size * large))
    sizes, of = grouped(counts, least, min(groups, MOST_SIZES))
    made.sizes = sizes
    left = counts.astype(np.int64).copy()
    while True:
        by_group = np.bincount(of[of >= 0], weights=left[of >= 0], minlength=len(sizes)).astype(np.int64).tolist() if sizes else []
        first = next((g for g, n in enumerate(by_group) if n), None)
        if first is None:
            break
        by_group[first] -= 1
        rest = filling(sizes, by_group, size - sizes[first])
        rest[first] += 1
        own = substituted([g for g, n in enumerate(rest) for _ in range(n)], of, left, size, least)
        kinds, each = np.unique(own, return_counts=True)
        times = int((left[kinds] // each).min())  # the same documents' lengths in so many sequences
        offset = 0
        for length in own:
            made.place(length, times, 1, made.n, offset)
            offset += length
        left[kinds] -= each * times
        made.leave(size - offset, made.n, times)
        made.n += times
    for length in range(min(least, size + 1) - 1, 0, -1):
        small(made, length, int(counts[length]))
    return made


def small(made: Plan, length: int, n: int) -> None:
    """Best fit of n documents of a length: the least room that takes one, filled as far as it goes."""
    while n:
        fits = [room for room in made.open if room >= length]
        if not fits:
            each = made.size // length
            number = max(1, n // each)
            made.leave(made.size, made.n, number)
            made.n += number
            continue
        room = min(fits)
        first_seq, number = made.open[room].pop()
        if not made.open[room]:
            del made.open[room]
        each = room // length
        offset = made.size - room
        if n >= each:
            whole = min(number, n // each)
            made.place(length, whole * each, each, first_seq, offset)
            made.leave(room - each * length, first_seq, whole)
            made.leave(room, first_seq + whole, number - whole)
            n -= whole * each
        else:
            made.place(length, n, n, first_seq, offset)
            made.leave(room - n * length, first_seq, 1)
            made.leave(room, first_seq + 1, number - 1)
            n = 0


def best_plan(counts: np.ndarray, size: int = SIZE) -> Plan:
    return min((plan(counts, g, size) for g in GROUPS), key=lambda p: p.n)


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """cut (columns of PIECES) with sequence_id and offset."""
    cut = written(cut, "pack-pieces")
    by_length = cut.groupBy("length").count().collect()  # at most `size` rows
    counts = np.zeros(size + 1, np.int64)
    for r in by_length:
        counts[r["length"]] = r["count"]
    runs = np.array(sorted(best_plan(counts, size).runs), np.int64).reshape(-1, 6)
    lengths, rank0, _, each, first_seq, offset = runs.T
    starts = np.searchsorted(lengths, np.arange(size + 2))
    buckets = max(1, -(-int(counts.sum()) // BUCKET_ROWS))
    dealt = cut.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    ahead = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("length", "_bucket").count().select("length", "_bucket", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_before"))
    own = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("_own", F.row_number().over(own) - 1).join(before, ["length", "_bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_own") + F.col("_before")).alias("rank"))

    def rows(_, batch):
        length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
        run = np.empty(len(length), np.int64)
        for own_length in np.unique(length):
            at = length == own_length
            a, b = starts[own_length], starts[own_length + 1]
            run[at] = a + np.searchsorted(rank0[a:b], rank[at], side="right") - 1
        step = rank - rank0[run]
        yield [*(batch.column(i) for i in range(5)), first_seq[run] + step // each[run], offset[run] + step % each[run] * length]

    return map_rows(ranked, rows, f"{PIECES}, sequence_id long, offset long")


def packed(docs: DataFrame) -> DataFrame:
    return pack(pieces(docs))


def op8_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
