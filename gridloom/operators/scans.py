"""Segmented scans, compaction and binning for arrays of rank 1, in two or more levels of blocks (plans.prefix)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import numbers as N
from gridloom.functions.dtypes import DType
from gridloom.functions.index import check_box, inside
from gridloom.operators.elementwise import upsert
from gridloom.plans.engine import Array
from gridloom.plans.prefix import BLOCK, block_of, numbered, running_sums, segmented_sums


def check_scan(src: Array, dst: Array, mask: Array, lo: int, hi: int) -> None:
    if src.ndim != 1 or dst.ndim != 1 or mask.ndim != 1:
        raise ValueError("scans take rank 1")
    if src is dst:
        raise ValueError("source and destination are one array")
    if src.dtype != dst.dtype:
        raise ValueError("types differ")
    for a in (src, dst, mask):
        check_box(([lo], [hi]), a.dims)


def parts_of(v: Column, d: DType) -> dict[str, Column]:
    """Columns that can be summed: two for a complex number."""
    if d.kind == "complex":
        return {"re": v["re"].cast("double"), "im": v["im"].cast("double")}
    return {"x": v.cast("double" if d.kind == "real" else "long")}


def together(d: DType, column) -> Column:
    return N.pair(column("re"), column("im"), d) if d.kind == "complex" else column("x").cast(d.spark)


def aligned(lo: int, hi: int, block: int, columns: dict[str, tuple[Array, Column, int]]) -> DataFrame:
    """_blk, k (0 at lo) and a column of each array over lo..hi. columns: array, value over v, and shift of its cells.

    One shuffle, by block: the aggregation that brings a cell's values together, the scan's windows and the carries of
    earlier blocks all keep its partitions.
    """
    parts = None
    for name, (a, value, shift) in columns.items():
        k = F.col("i0") - lo + shift
        one = a.df.where(inside(([lo], [hi - shift]))).select(block_of(k, block).alias("_blk"), k.alias("k"), value.alias(name))
        parts = one if parts is None else parts.unionByName(one, allowMissingColumns=True)
    return parts.repartition("_blk").groupBy("_blk", "k").agg(*(F.max(name).alias(name) for name in columns))


def bits(mask: Array) -> Column:
    return N.nonzero(F.col("v"), mask.dtype)


def replaced(dst: Array, lo: int, hi: int, rows: DataFrame, value: Column) -> Array:
    """dst with lo..hi taken from rows (k and what value needs); other cells stay where they are."""
    cells = rows.select((F.col("k") + lo).alias("i0"), value.alias("v"))
    rest = ([lo], [hi])
    return dst.with_df(cells if (lo, hi) == (0, dst.dims[0] - 1) else cells.unionByName(dst.df.where(~inside(rest)).select("i0", "v")))


def scan_add(src: Array, dst: Array, mask: Array, lo: int, hi: int, exclusive: bool = False, block: int = BLOCK) -> Array:
    """Running sums since the last set bit; cells before the first bit of lo..hi keep dst's values.

    Exclusive: the inclusive sum of the cells one place on, with 0 at every bit.
    """
    check_scan(src, dst, mask, lo, hi)
    d = src.dtype
    own = parts_of(F.col("v"), d)
    given = {n: (src, c, int(exclusive)) for n, c in own.items()}
    rows = aligned(lo, hi, block, given | {"bit": (mask, bits(mask), 0), "old": (dst, F.col("v"), 0)})
    zero = F.lit(0)
    values = [(F.when(F.col("bit"), zero).otherwise(F.coalesce(n, zero)) if exclusive else F.col(n)).alias(n) for n in own]
    out = segmented_sums(rows.select("_blk", "k", "bit", "old", *values), hi - lo + 1, list(own), block)
    return replaced(dst, lo, hi, out, F.when(F.col("seen"), together(d, lambda n: F.col(f"sum_{n}"))).otherwise(F.col("old")))


def scan_copy(src: Array, dst: Array, mask: Array, lo: int, hi: int, block: int = BLOCK) -> Array:
    """The source at the last set bit; 0 before the first bit of lo..hi."""
    check_scan(src, dst, mask, lo, hi)
    own = parts_of(F.col("v"), src.dtype)
    rows = aligned(lo, hi, block, {n: (src, c, 0) for n, c in own.items()} | {"bit": (mask, bits(mask), 0)})
    zero = F.lit(0)
    rows = rows.select("_blk", "k", "bit", *(F.when(F.col("bit"), F.col(n)).otherwise(zero).alias(n) for n in own))
    out = segmented_sums(rows, hi - lo + 1, list(own), block)  # a segment has one number that isn't 0
    return replaced(dst, lo, hi, out, together(src.dtype, lambda n: F.when(F.col("seen"), F.col(f"sum_{n}")).otherwise(zero)))


def ranked(rows: DataFrame, n: int, block: int) -> DataFrame:
    """rows (_blk, k, bit and more) with rank: the number of masked cells before."""
    on = rows.withColumn("on", F.col("bit").cast("long"))
    return running_sums(on, n, ["on"], block).withColumn("rank", F.col("sum_on") - F.col("on"))


def pack(src: Array, dst: Array, mask: Array, lo: int, hi: int, block: int = BLOCK) -> tuple[Array, DataFrame]:
    """dst with the masked cells of src in its first places, and a frame of their number, `count`."""
    check_scan(src, dst, mask, lo, hi)
    rows = aligned(lo, hi, block, {"bit": (mask, bits(mask), 0), "v": (src, F.col("v"), 0)})
    new = ranked(rows, hi - lo + 1, block).where("on = 1").select(F.col("rank").alias("i0"), "v")
    return upsert(dst, new), counted(mask, lo, hi)


def counted(mask: Array, lo: int, hi: int) -> DataFrame:
    return mask.df.where(inside(([lo], [hi]))).agg(F.count_if(bits(mask)).alias("count"))


def unpack(src: Array, dst: Array, mask: Array, lo: int, hi: int, block: int = BLOCK) -> tuple[Array, DataFrame]:
    """dst with src's first cells in its masked places, and their number."""
    check_scan(src, dst, mask, lo, hi)
    rows = ranked(aligned(lo, hi, block, {"bit": (mask, bits(mask), 0), "old": (dst, F.col("v"), 0)}), hi - lo + 1, block)
    # unmasked cells get keys of their own that meet nothing, so that they don't gather in one task
    rows = rows.withColumn("at", F.when(F.col("on") == 1, F.col("rank")).otherwise(-F.col("k") - 1))
    given = src.df.select(F.col("i0").alias("at"), F.col("v").alias("new"), F.lit(True).alias("there"))
    out = rows.join(given, "at", "left")
    return replaced(dst, lo, hi, out, F.when(F.col("there"), F.col("new")).otherwise(F.col("old"))), counted(mask, lo, hi)


# bins: rows (bin, value, pos), bins numbered from 1
def bin_counts(rows: DataFrame, n_bins: int) -> DataFrame:
    """bin, cnt and off for every bin, empty ones too."""
    found = rows.groupBy("bin").agg(F.count(F.lit(1)).alias("cnt"))
    every = rows.sparkSession.range(1, n_bins + 1).select(F.col("id").alias("bin"))
    counts = every.join(found, "bin", "left").select((F.col("bin") - 1).alias("k"), F.coalesce("cnt", F.lit(0)).alias("cnt"))
    return running_sums(counts, n_bins, ["cnt"]).select((F.col("k") + 1).alias("bin"), "cnt", (F.col("sum_cnt") - F.col("cnt")).alias("off"))


def checked_bins(rows: DataFrame, n_bins: int) -> DataFrame:
    b = F.col("bin").cast("long")
    return rows.withColumn("bin", F.when(b.between(1, n_bins), b).otherwise(F.raise_error(F.lit(f"wrong bin: not in 1..{n_bins}")).cast("long")))


def bin_index(rows: DataFrame, n_bins: int, sort: bool = False) -> DataFrame:
    """bin, value and place: values by bin, in order of pos within it (of value, if sort).

    A place is the row's number in that order of the whole table, so a hot bin is split over range partitions.
    """
    order = ["bin", "value", "pos"] if sort else ["bin", "pos", "value"]
    return numbered(checked_bins(rows, n_bins), order, "place").select("bin", "value", "place")


def bin_sorter(rows: DataFrame, n_bins: int) -> DataFrame:
    """bin, value and place with the values of each bin sorted."""
    return bin_index(rows.withColumn("pos", F.lit(0)) if "pos" not in rows.columns else rows, n_bins, sort=True)


def bin_range(placed: DataFrame, n_processes: int, total: int) -> DataFrame:
    """process, first and last bin of each process' share of the places."""
    each = -(-total // n_processes)
    return placed.groupBy(F.floor(F.col("place") / each).alias("process")).agg(F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"))

