"""Reductions: partial and final aggregates; only the results reach the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import numbers as N
from gridloom.functions.dtypes import require
from gridloom.functions.index import Box, check_box, full, inside, linear, shape_of
from gridloom.operators.elementwise import placed, step_divide_value, stepb_divide_value, zipped
from gridloom.plans.engine import Array


def scalar(value, a: Array):
    if a.dtype.kind == "complex":
        return complex(0 if value is None or value["re"] is None else value["re"], 0 if value is None or value["im"] is None else value["im"])
    return 0 if value is None else int(value) if a.dtype.kind == "int" else value


def exact_frame(products: DataFrame, x: Column, y: Column) -> DataFrame:
    """One row: the exact sum of products of integers, a long where it fits and a decimal of 38 digits beyond; the type depends on the sum, so it is made at once."""
    wide = "decimal(19,0)"
    total = products.agg(F.sum(x.cast(wide) * y.cast(wide)).alias("dot")).first()[0]
    kind = "long" if total is None or -(1 << 63) <= total < 1 << 63 else "decimal(38,0)"
    return products.sparkSession.range(1).select(F.lit(None if total is None else str(total)).cast(kind).alias("dot"))


def dot_frame(a: Array, b: Array, boxes: tuple[Box, Box] | None = None, trans: tuple[bool, bool] = (False, False)) -> DataFrame:
    """One row: the sum of products; complex numbers aren't conjugated, sums of integers are exact (exact_frame)."""
    if a.dtype != b.dtype:
        raise ValueError("types differ")
    own = [check_box(box, x.dims) for box, x in zip(boxes, (a, b), strict=True)] if boxes else [full(a.dims), full(b.dims)]
    shape = shape_of(own[0])[::-1] if trans[0] else shape_of(own[0])
    target = full(shape)
    if a is b and own[0] == own[1] and trans[0] == trans[1]:
        both = placed(a, own[0], target, trans[0]).withColumnRenamed("v", "v0").withColumn("v1", F.col("v0"))
    else:
        left = placed(a, own[0], target, trans[0]).withColumnRenamed("v", "v0")
        both = left.join(placed(b, own[1], target, trans[1]).withColumnRenamed("v", "v1"), [f"i{d}" for d in range(len(shape))])
    x, y = F.col("v0"), F.col("v1")
    if a.dtype.kind == "complex":
        re = F.sum(x["re"].cast("double") * y["re"] - x["im"].cast("double") * y["im"])
        im = F.sum(x["re"].cast("double") * y["im"] + x["im"].cast("double") * y["re"])
        return both.agg(F.struct(re.alias("re"), im.alias("im")).alias("dot"))
    if a.dtype.kind == "int":
        return exact_frame(both, x, y)
    return both.agg(F.sum(x.cast("double") * y.cast("double")).alias("dot"))


def dot(a: Array, b: Array, boxes: tuple[Box, Box] | None = None, trans: tuple[bool, bool] = (False, False)):
    return scalar(dot_frame(a, b, boxes, trans).first()[0], a)


def check_norm(a: Array) -> None:
    require(a.dtype, "norm")
    if a.ndim > 2:
        raise ValueError("norms take rank 1 or 2")


def norm_frame(a: Array) -> DataFrame:
    """norm1: the sum, norm_inf: the largest of the absolute values of all elements (not the operator norms)."""
    check_norm(a)
    size = N.modulus(F.col("v"), a.dtype).cast("long" if a.dtype.kind == "int" else "double")
    return a.df.agg(F.sum(size).alias("norm1"), F.max(size).alias("norm_inf"))


def norm1(a: Array):
    return norm_frame(a).first()["norm1"]


def norm_infinity(a: Array):
    return norm_frame(a).first()["norm_inf"]


def select_frame(a: Array, op: str, box: Box | None = None) -> DataFrame:
    """One row: v and the linear index of the smallest or largest element; ties to the lowest index."""
    if op not in ("min", "max"):
        raise ValueError(f"select takes min or max, not {op!r}")
    df = a.df.where(inside(check_box(box, a.dims))) if box else a.df
    key = N.square(F.col("v")) if a.dtype.kind == "complex" else F.col("v")
    if op == "min":
        best = F.min(F.struct(key.alias("key"), linear(a.dims).alias("lin"), F.col("v").alias("v")))
        return df.agg(best.alias("x")).select(F.col("x.v").alias("v"), F.col("x.lin").alias("lin"))
    best = F.max(F.struct(key.alias("key"), (-linear(a.dims)).alias("neg"), F.col("v").alias("v")))
    return df.agg(best.alias("x")).select(F.col("x.v").alias("v"), (-F.col("x.neg")).alias("lin"))


def select_elem(a: Array, op: str, box: Box | None = None) -> tuple:
    """(value, subscripts)."""
    row = select_frame(a, op, box).first()
    at, lin = [], row["lin"]
    for n in reversed(a.dims):
        at.append(lin % n)
        lin //= n
    return scalar(row["v"], a), at[::-1]


def step_max_frame(a: Array, b: Array, boxes: list[Box] | None = None) -> DataFrame:
    """One row, step_max: the largest t with a + t * b >= 0; no element that blocks gives the type's infinity."""
    require(a.dtype, "step")
    inf = N.constant(a.dtype.infinity, a.dtype)
    if a is b and boxes is None:
        return a.df.limit(1).select(inf.alias("step_max"))
    target = full(shape_of(boxes[0]) if boxes else a.dims)
    both = zipped([a, b], boxes, target)
    v0 = F.when(F.col("v0") >= 0, F.col("v0")).otherwise(F.raise_error(F.lit("step_max: negative element")).cast(a.dtype.spark))
    t = step_divide_value(v0, F.col("v1"), a.dtype)
    return both.agg(F.abs(F.max(F.when(t > 0, -inf).otherwise(t))).alias("step_max"))


def step_max(a: Array, b: Array, boxes: list[Box] | None = None):
    return step_max_frame(a, b, boxes).first()[0]


def step_bound_frame(x: Array, v: Array, low: Array, high: Array, boxes: list[Box] | None = None) -> DataFrame:
    """One row: boundmin, wolfemin, boundmax of a line search from x along v between low and high; one 4-way join."""
    d = x.dtype
    require(d, "step")
    target = full(shape_of(boxes[0]) if boxes else x.dims)
    both = zipped([x, v, low, high], boxes, target)
    at, way, lo, hi = (F.col(f"v{k}") for k in range(4))
    zero = N.constant(0, d)
    below = lambda c, what: F.when(c >= 0, c).otherwise(F.raise_error(F.lit(f"step_bound_info: {what} is no bound")).cast(d.spark))
    up, down = below((hi - at).cast(d.spark), "upper"), below((at - lo).cast(d.spark), "lower")
    t1 = stepb_divide_value(up, F.greatest(way, zero), d)
    t2 = stepb_divide_value(down, F.abs(F.least(way, zero)), d)
    both = both.select(t1.alias("t1"), t2.alias("t2"), ((way != 0) | ((at != lo) & (at != hi))).alias("moves"))
    t = F.when(F.col("moves"), F.least("t1", "t2")).otherwise(zero)
    return both.agg(F.min(t).alias("boundmin"), F.least(F.min("t1"), F.min("t2")).alias("wolfemin"), F.max(t).alias("boundmax"))


def step_bound_info(x: Array, v: Array, low: Array, high: Array, boxes: list[Box] | None = None) -> tuple:
    return tuple(step_bound_frame(x, v, low, high, boxes).first())


def _any(c: Column) -> Column:
    return F.max((c != 0).cast("int"))


#: Aggregate by operation. "or" and "and" work on bits for integers.
GLOBAL_OPS = {
    "+": F.sum, "*": F.product, "max": F.max, "min": F.min,
    "absmax": lambda c: F.max(F.abs(c)), "absmin": lambda c: F.min(F.abs(c)),
    "or": F.bit_or, "|": F.bit_or, "bor": F.bit_or, "&": F.bit_and, "band": F.bit_and,
    "and": lambda c: F.min((c != 0).cast("int")), "&&": lambda c: F.min((c != 0).cast("int")), "land": lambda c: F.min((c != 0).cast("int")),
    "||": _any, "lor": _any,
}


def global_op(x: DataFrame, op: str, group: str | None = None) -> DataFrame:
    """x: (process, k, v), a vector of each process; gives (k, v) for all, or (group, k, v) for each group of processes."""
    if op not in GLOBAL_OPS:
        raise ValueError(f"unknown operation {op!r}")
    keys = [group, "k"] if group else ["k"]
    kind = dict(x.dtypes)["v"]
    return x.groupBy(*keys).agg(GLOBAL_OPS[op](F.col("v")).cast(kind).alias("v"))


def broadcast_from(x: DataFrame, root: int, processes: list[int]) -> DataFrame:
    """(process, k, v): the root's vector for every process."""
    ranks = F.array(*(F.lit(p) for p in processes))
    return x.where(F.col("process") == root).select(F.explode(ranks).alias("process"), "k", "v")


def merge_mirrored(replicas: list[Array]) -> Array:
    """The sum of all replicas."""
    first = replicas[0]
    df = first.df
    for r in replicas[1:]:
        df = df.unionByName(r.df)
    total = df.groupBy(*first.index).agg(N.wide_sum(F.col("v"), first.dtype).alias("v"))
    return first.with_df(total.withColumn("v", N.narrowed(F.col("v"), first.dtype)))


def merge_distr_patch(replicas: list[Array], source: Box, b: Array, target: Box) -> Array:
    """The sum of the replicas' box, in b's box of the same shape."""
    from gridloom.operators.elementwise import copy_patch

    return copy_patch(merge_mirrored(replicas), source, b, target)


def num_nonzeros(a: Array) -> int:
    return a.df.where(N.nonzero(F.col("v"), a.dtype)).count()


