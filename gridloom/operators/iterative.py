"""Iterative solvers over sparse matrices: vectors stay distributed, each step's vectors end in a written table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.sparse import BLOCK_BITS, Sparse, packed
from gridloom.plans.engine import Array
from gridloom.plans.lineage import cut


@dataclass(frozen=True)
class Solution:
    x: Array
    steps: int
    residual: float


def stepped(s: Sparse) -> DataFrame:
    """The matrix as each step reads it, written once: a row's elements in a block of columns as arrays."""
    return cut(packed(s.df, "j", "i"), "matrix")


def whole(b: Array) -> DataFrame:
    """(i, b) with a row for each cell, as the vectors' arrays need; absent ones and nulls are 0."""
    found = b.df.select(F.col("i0").alias("i"), F.col("v").cast("double").alias("b"))
    return b.engine.spark.range(b.dims[0]).select(F.col("id").alias("i")).join(found, "i", "left").withColumn("b", F.coalesce("b", F.lit(0.0)))


def product(packs: DataFrame, p: DataFrame, column: str) -> DataFrame:
    """(i, q) with q = A p; p has a row for each i. Rows without elements are absent and count as 0.

    The vector is written as one array for each block of columns, so the matrix isn't shuffled while these arrays fit a broadcast, and at most once a step beyond.
    """
    found = F.array_sort(F.collect_list(F.struct("i", F.coalesce(column, F.lit(0.0)).alias("_p")))).alias("_l")
    vector = cut(p.groupBy(F.shiftright("i", BLOCK_BITS).alias("_block")).agg(found).select("_block", F.col("_l._p").alias("_p")), "vector")
    terms = packs.join(vector, "_block").select("_k", "_v", "_p", F.posexplode("_x").alias("_n", "_j"))
    return terms.select(F.col("_k").alias("i"), (F.get("_v", "_n") * F.get("_p", "_j")).alias("_t")).groupBy("i").agg(F.sum("_t").alias("q"))


def conjugate_gradient(s: Sparse, b: Array, tolerance: float = 1e-8, most: int = 200) -> Solution:
    """A symmetric positive matrix: x with |A x - b| <= tolerance * |b|. Two scalars a step reach the driver."""
    if s.dims[0] != s.dims[1] or b.dims != (s.dims[0],):
        raise ValueError("a square matrix and a vector of its length are needed")
    state = cut(whole(b).select("i", F.lit(0.0).alias("x"), F.col("b").alias("r"), F.col("b").alias("p")), "cg")
    packs = stepped(s)
    rr = start = float(state.agg(F.sum(F.col("r") * F.col("r"))).first()[0] or 0.0)
    step = 0
    while rr > tolerance**2 * start and step < most:
        step += 1
        q = cut(state.join(product(packs, state, "p"), "i", "left").withColumn("q", F.coalesce("q", F.lit(0.0))), "cg")
        alpha = rr / float(q.agg(F.sum(F.col("p") * F.col("q"))).first()[0])
        moved = q.select("i", (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("q")).alias("r"), "p")
        new = float(moved.agg(F.sum(F.col("r") * F.col("r"))).first()[0])
        state, rr = moved.withColumn("p", F.col("r") + (new / rr) * F.col("p")), new
    return Solution(b.engine.from_df(state.select(F.col("i").alias("i0"), F.col("x").alias("v")), b.dims, "double"), step, rr**0.5)


def jacobi(s: Sparse, b: Array, tolerance: float = 1e-8, most: int = 500) -> Solution:
    """A diagonally dominant matrix: x' = x + (b - A x) / diagonal, until the largest change is below the tolerance."""
    diagonal = s.df.where("i = j").groupBy("i").agg(F.sum("v").alias("d"))
    some = F.when(F.col("d") != 0, F.col("d")).otherwise(F.raise_error(F.lit("jacobi: a row has no diagonal element")).cast("double"))
    state = cut(whole(b).join(diagonal, "i", "left").withColumn("d", some).withColumn("x", F.lit(0.0)), "jacobi")
    packs, step, change = stepped(s), 0, float("inf")
    while change > tolerance and step < most:
        step += 1
        q = state.join(product(packs, state, "x"), "i", "left")
        state = cut(q.select("i", "b", "d", (F.col("x") + (F.col("b") - F.coalesce("q", F.lit(0.0))) / F.col("d")).alias("x"), F.abs((F.col("b") - F.coalesce("q", F.lit(0.0))) / F.col("d")).alias("change")), "jacobi")
        change = float(state.agg(F.max("change")).first()[0] or 0.0)
        state = state.drop("change")
    return Solution(b.engine.from_df(state.select(F.col("i").alias("i0"), F.col("x").alias("v")), b.dims, "double"), step, change)
