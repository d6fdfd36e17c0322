"""Reading and writing cells: boxes, strided and periodic boxes, lists of subscripts, fields, blocks, tickets.

A read gives a DataFrame whose subscripts start at 0 in the box. A write takes such a DataFrame (or a numpy array) and
gives a new version of the array; the old one stays as it was. Plans are lazy, so a handle of a pending operation is
the DataFrame itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import numbers as N
from gridloom.functions.dtypes import require
from gridloom.functions.index import Box, check_box, inside, linear, names, shape_of
from gridloom.operators.elementwise import upsert
from gridloom.plans.engine import Array
from gridloom.plans.prefix import numbered


def rebased(df: DataFrame, lo: Sequence[int], step: Sequence[int] | None = None) -> DataFrame:
    step = step or [1] * len(lo)
    at = [(F.floor((F.col(n) - low) / s) if s > 1 else F.col(n) - low).cast("long").alias(n) for n, low, s in zip(names(len(lo)), lo, step, strict=True)]
    return df.select(*at, "v")


def as_cells(a: Array, values, shape: Sequence[int]) -> DataFrame:
    """values as rows (i0.., v) of the array's type; values: a DataFrame, an Array, or anything numpy takes."""
    if isinstance(values, Array):
        values = values.df
    if not isinstance(values, DataFrame):
        import numpy as np

        values = np.broadcast_to(np.asarray(values), shape)
        values = a.engine.from_numpy(values, a.dtype).df
    v = F.col("v") if a.dtype.kind == "complex" else F.col("v").cast(a.dtype.spark)
    return values.select(*names(len(shape)), v.alias("v"))


def placed_at(a: Array, values, box: Box, step: Sequence[int] | None = None) -> DataFrame:
    box = check_box(box, a.dims)
    step = step or [1] * a.ndim
    shape = [-(-n // s) for n, s in zip(shape_of(box), step, strict=True)]
    cells = as_cells(a, values, shape)
    return cells.select(*((F.col(n) * s + low).alias(n) for n, low, s in zip(a.index, box[0], step, strict=True)), "v")


def get(a: Array, lo: Sequence[int], hi: Sequence[int]) -> DataFrame:
    """The box as rows with subscripts from 0; the filter reaches the scan of a stored array."""
    box = check_box((lo, hi), a.dims)
    return rebased(a.df.where(inside(box)), box[0])


def put(a: Array, lo: Sequence[int], hi: Sequence[int], values) -> Array:
    return upsert(a, placed_at(a, values, (lo, hi)))


def accumulated(a: Array, new: DataFrame, alpha) -> Array:
    require(a.dtype, "accumulate")
    return upsert(a, new, lambda old, x: N.add(old, N.mul(x, N.constant(alpha, a.dtype), a.dtype), a.dtype))


def acc(a: Array, lo: Sequence[int], hi: Sequence[int], values, alpha=1) -> Array:
    """a[box] += alpha * values."""
    return accumulated(a, placed_at(a, values, (lo, hi)), alpha)


def check_step(a: Array, step: Sequence[int]) -> None:
    if len(step) != a.ndim or min(step) < 1:
        raise ValueError(f"steps {list(step)}")


def strided_get(a: Array, lo: Sequence[int], hi: Sequence[int], step: Sequence[int]) -> DataFrame:
    check_step(a, step)
    box = check_box((lo, hi), a.dims)
    on = F.lit(True)
    for n, low, s in zip(a.index, box[0], step, strict=True):
        on = on & (F.pmod(F.col(n) - low, F.lit(s)) == 0)
    return rebased(a.df.where(inside(box) & on), box[0], step)


def strided_put(a: Array, lo: Sequence[int], hi: Sequence[int], step: Sequence[int], values) -> Array:
    check_step(a, step)
    return upsert(a, placed_at(a, values, (lo, hi), step))


def strided_acc(a: Array, lo: Sequence[int], hi: Sequence[int], step: Sequence[int], values, alpha=1) -> Array:
    check_step(a, step)
    return accumulated(a, placed_at(a, values, (lo, hi), step), alpha)


def check_periodic(a: Array, lo: Sequence[int], hi: Sequence[int]) -> list[int]:
    """The box may pass the bounds, up to twice a dimension."""
    if len(lo) != a.ndim or len(hi) != a.ndim:
        raise ValueError("rank")
    for low, high, n in zip(lo, hi, a.dims, strict=True):
        if not low <= high or high - low + 1 > 2 * n:
            raise ValueError(f"periodic range {low}..{high} of dimension {n}")
    return shape_of((lo, hi))


def periodic_get(a: Array, lo: Sequence[int], hi: Sequence[int]) -> DataFrame:
    """A box that wraps round: every cell goes to each of its places in it, without a join."""
    check_periodic(a, lo, hi)
    df = a.df
    for n, low, high, size in zip(a.index, lo, hi, a.dims, strict=True):
        first = F.lit(low).cast("long") + F.pmod(F.col(n) - low, F.lit(size))
        df = df.where(first <= high).withColumn(n, F.explode(F.sequence(first, F.lit(high).cast("long"), F.lit(size).cast("long"))))
    return rebased(df, lo)


def wrapped(a: Array, lo: Sequence[int], hi: Sequence[int], values) -> DataFrame:
    """values at their places in the array, with `pos`, their linear place in the box."""
    shape = check_periodic(a, lo, hi)
    pos = F.lit(0).cast("long")
    for n, size in zip(a.index, shape, strict=True):
        pos = pos * size + F.col(n)
    cells = as_cells(a, values, shape).withColumn("pos", pos)
    return cells.select(*(F.pmod(F.col(n) + low, F.lit(size)).alias(n) for n, low, size in zip(a.index, lo, a.dims, strict=True)), "v", "pos")


def periodic_put(a: Array, lo: Sequence[int], hi: Sequence[int], values) -> Array:
    """Of two values for one cell the later one in linear order stays."""
    return scatter(a, wrapped(a, lo, hi, values))


def periodic_acc(a: Array, lo: Sequence[int], hi: Sequence[int], values, alpha=1) -> Array:
    return scatter_acc(a, wrapped(a, lo, hi, values), alpha)


def checked_subscripts(a: Array, subs: DataFrame) -> DataFrame:
    """An out-of-range subscript is an error when the plan runs."""
    out = subs
    for n, size in zip(a.index, a.dims, strict=True):
        x = F.col(n).cast("long")
        wrong = F.raise_error(F.concat(F.lit(f"subscript {n} is outside 0..{size - 1}: "), F.coalesce(x.cast("string"), F.lit("null")))).cast("long")
        out = out.withColumn(n, F.when(x.between(0, size - 1), x).otherwise(wrong))
    return out


def gather(a: Array, subs: DataFrame) -> DataFrame:
    """subs: pos and subscripts; gives pos, subscripts and v."""
    return checked_subscripts(a, subs).select("pos", *a.index).join(a.df, a.index)


def scatter(a: Array, subs: DataFrame) -> Array:
    """subs: pos, subscripts and v; of repeated subscripts the greatest pos stays. Repeats are reduced before the join."""
    v = F.col("v") if a.dtype.kind == "complex" else F.col("v").cast(a.dtype.spark)
    last = checked_subscripts(a, subs).groupBy(*a.index).agg(F.max_by(v, F.col("pos")).alias("v"))
    return upsert(a, last)


def scatter_acc(a: Array, subs: DataFrame, alpha=1) -> Array:
    """a[sub] += alpha * v; repeats all add, summed map-side before the shuffle."""
    require(a.dtype, "accumulate")
    total = checked_subscripts(a, subs).groupBy(*a.index).agg(N.wide_sum(F.col("v"), a.dtype).alias("v"))
    add = lambda old, x: N.narrowed(N.add(wide(old, a), N.mul(x, N.constant(alpha, wide_type(a)), wide_type(a)), wide_type(a)), a.dtype)
    return upsert(a, total, add)


def wide_type(a: Array):
    from gridloom.functions.dtypes import CDOUBLE, DOUBLE, LONG

    return {"complex": CDOUBLE, "real": DOUBLE, "int": LONG}[a.dtype.kind]


def wide(v: Column, a: Array) -> Column:
    d = wide_type(a)
    return N.pair(v["re"], v["im"], d) if d.kind == "complex" else v.cast(d.spark)


# non-blocking forms: a lazy plan is the handle
nb_get, nb_put, nb_acc = get, put, acc
gather_flat, scatter_flat, scatter_acc_flat = gather, scatter, scatter_acc


def put_notify(a: Array, lo, hi, values, b: Array, at: Sequence[int], flag) -> tuple[Array, Array]:
    """The box and then the element that tells of it; both are new versions."""
    return put(a, lo, hi, values), put(b, at, at, flag)


def read_inc(a: Array, at: Sequence[int], inc: int = 1) -> tuple[int, Array]:
    """The old value of an integer cell, and the array in which it is inc more."""
    require(a.dtype, "ticket")
    row = a.df.where(inside(check_box((at, at), a.dims))).select("v").first()
    here = F.lit(True)
    for n, x in zip(a.index, at, strict=True):
        here = here & (F.col(n) == x)
    return int(row[0]), a.with_df(a.df.withColumn("v", F.when(here, (F.col("v") + inc).cast(a.dtype.spark)).otherwise(F.col("v"))))


def tickets(df: DataFrame, order: Sequence[str], base: int = 0, inc: int = 1, name: str = "ticket") -> DataFrame:
    """What every row would get from a shared counter, in the given order: base, base + inc, .."""
    return numbered(df, order, name).withColumn(name, F.col(name) * inc + base)


def get_field(a: Array, lo: Sequence[int], hi: Sequence[int], field: str) -> DataFrame:
    """A field of elements of a registered type."""
    return get(a, lo, hi).withColumn("v", F.col("v")[field])


def put_field(a: Array, lo: Sequence[int], hi: Sequence[int], field: str, values: DataFrame) -> Array:
    box = check_box((lo, hi), a.dims)
    new = values.select(*((F.col(n) + low).alias(n) for n, low in zip(a.index, box[0], strict=True)), "v")
    return upsert(a, new, lambda old, x: old.withField(field, x))


nb_get_field, nb_put_field = get_field, put_field


# blocks: the surface for functions over what a process holds
def block(a: Array, number: int) -> DataFrame:
    """A block by its number in row-major order of blocks."""
    flat = F.lit(0).cast("long")
    for b, n in zip(a.layout.block_columns(), a.layout.n_blocks, strict=True):
        flat = flat * n + b
    return a.df.where(flat == number)


def block_at(a: Array, subscript: Sequence[int]) -> DataFrame:
    here = F.lit(True)
    for b, x in zip(a.layout.block_columns(), subscript, strict=True):
        here = here & (b == x)
    return a.df.where(here)


def segment(a: Array, process: int) -> DataFrame:
    """All that a process holds."""
    return a.df.where(a.layout.owner_column() == process)


#: Cells that one frame of map_blocks holds at most.
FRAME_CELLS = 1 << 20


def map_blocks(a: Array, fn, dtype=None) -> Array:
    """fn(pandas frame of a process' cells) -> frame of the same columns, for each process; the array's new version.

    A process that holds much gets several frames, each of the cells of one range of FRAME_CELLS linear indices.
    """
    schema = ", ".join(f"{n} long" for n in a.index) + f", v {(dtype or a.dtype).spark.simpleString()}"
    owned = a.df.withColumn("_owner", a.layout.owner_column()).withColumn("_part", F.floor(linear(a.dims) / FRAME_CELLS))
    return a.with_df(owned.groupBy("_owner", "_part").applyInPandas(lambda pdf: fn(pdf.drop(columns=["_owner", "_part"])), schema), **({"dtype": dtype} if dtype else {}))
