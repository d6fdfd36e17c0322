"""Projections and index equi-joins: one code path, in which the whole array is the box of its dimensions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions import numbers as N
from gridloom.functions.dtypes import DType, require
from gridloom.functions.index import Box, check_box, full, inside, linear, moved, names, shape_of
from gridloom.plans.engine import Array

Binary = Callable[[Column, Column, DType], Column]


def fill(a: Array, value, box: Box | None = None) -> Array:
    return a.with_value(N.constant(value, a.dtype), box and check_box(box, a.dims))


def zero(a: Array, box: Box | None = None) -> Array:
    return fill(a, 0, box)


def scale(a: Array, alpha, box: Box | None = None) -> Array:
    return a.with_value(N.mul(F.col("v"), N.constant(alpha, a.dtype), a.dtype), box and check_box(box, a.dims))


def add_constant(a: Array, alpha, box: Box | None = None) -> Array:
    return a.with_value(N.add(F.col("v"), N.constant(alpha, a.dtype), a.dtype), box and check_box(box, a.dims))


def abs_value(a: Array, box: Box | None = None) -> Array:
    return a.with_value(N.absolute(F.col("v"), a.dtype), box and check_box(box, a.dims))


def recip(a: Array, box: Box | None = None) -> Array:
    """1 / v; a zero is an error, integers truncate."""
    return a.with_value(N.div(N.constant(1, a.dtype), F.col("v"), a.dtype), box and check_box(box, a.dims))


def randomize(a: Array, most, seed: int = 0) -> Array:
    """Uniform numbers below most, by a hash of seed and linear index: a part that is computed again gets the same ones."""
    require(a.dtype, "random")
    share = N.hashed_bits(F.concat_ws(":", F.lit(str(seed)), linear(a.dims).cast("string"))) / F.lit(float(1 << 52))
    return a.with_value((share * F.lit(most)).cast(a.dtype.spark))


def patch_enum(a: Array, lo: int, hi: int, start, step) -> Array:
    """Rank 1: a[i] = start + (i - lo) * step for lo <= i <= hi."""
    if a.ndim != 1:
        raise ValueError("patch_enum takes rank 1")
    at = (F.col("i0") - lo).cast("double" if a.dtype.kind != "int" else "long")
    value = N.pair(F.lit(complex(start).real) + at * complex(step).real, F.lit(complex(start).imag) + at * complex(step).imag, a.dtype) if a.dtype.kind == "complex" else (F.lit(start) + at * F.lit(step)).cast(a.dtype.spark)
    return a.with_value(value, check_box(([lo], [hi]), a.dims))


def copy(a: Array, name: str = "") -> Array:
    return replace(a, name=name)


def placed(a: Array, source: Box, target: Box, trans: bool = False):
    """The cells of the source box, as (index in the target box, v)."""
    box = a.df.where(inside(source))
    if trans:
        if a.ndim != 2:
            raise ValueError("a transposed copy takes rank 2")
        box = box.select(F.col("i1").alias("i0"), F.col("i0").alias("i1"), "v")
        source = (list(source[0])[::-1], list(source[1])[::-1])
    return box.select(*(c.alias(n) for c, n in zip(moved(source, target), names(len(target[0])), strict=True)), "v")


def upsert(b: Array, new, value: Callable[[Column, Column], Column] | None = None) -> Array:
    """b with the cells of new (index, v) replaced, or combined by value(old, new)."""
    new = new.withColumnRenamed("v", "_new").withColumn("_hit", F.lit(True))
    merged = value(F.col("v"), F.col("_new")) if value else F.col("_new")
    df = b.df.join(new, b.index, "left").withColumn("v", F.when(F.col("_hit"), merged).otherwise(F.col("v")))
    return b.with_df(df)


def copy_patch(a: Array, source: Box, b: Array, target: Box, trans: bool = False) -> Array:
    """b with the source box of a in the target box; boxes of equal capacity pair up in linear order."""
    source, target = check_box(source, a.dims), check_box(target, b.dims)
    if a.dtype != b.dtype:
        raise ValueError("types differ")
    if a is b:
        if source == target and not trans:
            return b
        from gridloom.functions.index import intersect

        if intersect(source, target):
            raise ValueError("boxes of one array overlap")
    return upsert(b, placed(a, source, target, trans))


def zipped(arrays: list[Array], boxes: list[Box] | None, target: Box):
    """The arrays' boxes joined by index in the target box; columns v0, v1, .."""
    out = None
    for k, a in enumerate(arrays):
        box = check_box(boxes[k], a.dims) if boxes else full(a.dims)
        one = placed(a, box, target).withColumnRenamed("v", f"v{k}")
        out = one if out is None else out.join(one, names(len(target[0])))
    return out


def combine(arrays: list[Array], value: Column, boxes: list[Box] | None = None, into: Array | None = None, target: Box | None = None) -> Array:
    """A new array, or `into` with its target box replaced, of value over v0, v1, ..; into's old values are not read otherwise."""
    if len({a.dtype for a in arrays}) > 1:
        raise ValueError("types differ")
    if boxes is None and len({a.dims for a in arrays}) > 1:
        raise ValueError("dimensions differ")
    if into is None:
        shape = shape_of(boxes[0]) if boxes else arrays[0].dims
        target = full(shape)
        df = zipped(arrays, boxes, target).withColumn("v", value)
        if boxes is None:
            return arrays[0].with_df(df)
        return arrays[0].engine.from_df(df, shape, arrays[0].dtype)
    target = check_box(target, into.dims) if target else full(into.dims)
    df = zipped(arrays, boxes, target).withColumn("v", value).select(*into.index, "v")
    return into.with_df(df) if target == full(into.dims) else upsert(into, df)


def add(alpha, a: Array, beta, b: Array, **boxes) -> Array:
    """alpha * a + beta * b."""
    d = a.dtype
    value = N.add(N.mul(N.constant(alpha, d), F.col("v0"), d), N.mul(N.constant(beta, d), F.col("v1"), d), d)
    return combine([a, b], value, **boxes)


def _pairwise(op: Binary) -> Callable[..., Array]:
    def run(a: Array, b: Array, **boxes) -> Array:
        return combine([a, b], op(F.col("v0"), F.col("v1"), a.dtype), **boxes)

    return run


elem_multiply = _pairwise(N.mul)
elem_divide = _pairwise(N.div)
elem_maximum = _pairwise(N.greater)
elem_minimum = _pairwise(N.lesser)


def ratio(a: Column, b: Column, d: DType) -> Column:
    return F.call_function("div", a, b).cast(d.spark) if d.kind == "int" else (a / b).cast(d.spark)


def step_divide_value(a: Column, b: Column, d: DType) -> Column:
    """a / b; 0 / b is infinite for b >= 0 and 0 for b < 0; a / 0 is infinite. Infinite is a finite sentinel."""
    inf = N.constant(d.infinity, d)
    return F.when(a == 0, F.when(b >= 0, inf).otherwise(N.constant(0, d))).when(b == 0, inf).otherwise(ratio(a, F.when(b == 0, N.constant(1, d)).otherwise(b), d))


def stepb_divide_value(a: Column, b: Column, d: DType) -> Column:
    """a / b; 0 / b is 0 for b > 0 and infinite for b <= 0; a / 0 is infinite."""
    inf = N.constant(d.infinity, d)
    return F.when(a == 0, F.when(b > 0, N.constant(0, d)).otherwise(inf)).when(b == 0, inf).otherwise(ratio(a, F.when(b == 0, N.constant(1, d)).otherwise(b), d))


def elem_step_divide(a: Array, b: Array, **boxes) -> Array:
    require(a.dtype, "step")
    return combine([a, b], step_divide_value(F.col("v0"), F.col("v1"), a.dtype), **boxes)


def elem_stepb_divide(a: Array, b: Array, **boxes) -> Array:
    require(a.dtype, "step")
    return combine([a, b], stepb_divide_value(F.col("v0"), F.col("v1"), a.dtype), **boxes)


def step_mask(a: Array, b: Array, **boxes) -> Array:
    """b where a is not 0, else 0."""
    return combine([a, b], F.when(N.nonzero(F.col("v0"), a.dtype), F.col("v1")).otherwise(N.constant(0, a.dtype)), **boxes)


def median(a: Array, b: Array, c: Array, **boxes) -> Array:
    return combine([a, b, c], N.middle(F.col("v0"), F.col("v1"), F.col("v2"), a.dtype), **boxes)


def linear_index(a: Array) -> Column:
    return linear(a.dims)
