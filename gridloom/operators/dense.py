"""Dense linear algebra: blocked products in numpy over Arrow batches, joins for diagonals, single-group solvers.

A product C = alpha * op(A) op(B) + beta * C is cut into tiles of C and chunks of the inner dimension: a group holds one
strip of A and one of B of bounded size, whatever the matrices' sizes, and partial tiles are summed map-side before the
shuffle. Systems of up to MOST_GLOBAL rows are solved in one group, larger ones by column panels (factor.py);
eigenvectors run in one group and refuse more than MOST_GLOBAL rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import numbers as N
from gridloom.functions.dtypes import require
from gridloom.functions.index import Box, check_box, full, shape_of
from gridloom.operators import factor
from gridloom.operators.elementwise import placed, upsert
from gridloom.plans.engine import Array

#: Edge of a tile of C, and inner length of a chunk: a group holds 2 * TILE * CHUNK numbers at most.
TILE, CHUNK = 256, 1024
MOST_GLOBAL = 4096


def triples(a: Array, box: Box, trans: bool) -> DataFrame:
    """i, j, re (and im) of op(box)."""
    shape = shape_of(box)
    target = full(shape[::-1] if trans else shape)
    df = placed(a, box, target, trans)
    if a.dtype.kind == "complex":
        return df.select(F.col("i0").alias("i"), F.col("i1").alias("j"), F.col("v")["re"].cast("double").alias("re"), F.col("v")["im"].cast("double").alias("im"))
    return df.select(F.col("i0").alias("i"), F.col("i1").alias("j"), F.col("v").cast("double").alias("re"))


def tile_product(complex_: bool, tile: int, chunk: int) -> Callable:
    names = ["re", "im"] if complex_ else ["re"]

    def dense(t, rows: str, columns: str, shape: tuple[int, int], r0: int, c0: int) -> np.ndarray:
        out = np.zeros(shape, complex if complex_ else float)
        value = t.column("re").to_numpy() + (1j * t.column("im").to_numpy() if complex_ else 0)
        out[t.column(rows).to_numpy() - r0, t.column(columns).to_numpy() - c0] = value
        return out

    def run(key, a, b):
        import pyarrow as pa

        bi, bj, bk = (k.as_py() for k in key)
        if not a.num_rows or not b.num_rows:
            return pa.table({n: pa.array([], pa.int64() if n in "ij" else pa.float64()) for n in ["i", "j", *names]})
        c = dense(a, "i", "j", (tile, chunk), bi * tile, bk * chunk) @ dense(b, "i", "j", (chunk, tile), bk * chunk, bj * tile)
        some = np.zeros(tile, bool), np.zeros(tile, bool)  # rows and columns that exist in this tile
        some[0][a.column("i").to_numpy() - bi * tile] = True
        some[1][b.column("j").to_numpy() - bj * tile] = True
        i, j = np.flatnonzero(some[0]), np.flatnonzero(some[1])
        values = c[np.ix_(i, j)].ravel()
        at = {"i": np.repeat(i + bi * tile, len(j)), "j": np.tile(j + bj * tile, len(i))}
        return pa.table(at | ({"re": values.real.copy(), "im": values.imag.copy()} if complex_ else {"re": values}))

    return run


def product(a: DataFrame, b: DataFrame, m: int, k: int, n: int, complex_: bool = False, tile: int = TILE, chunk: int = CHUNK) -> DataFrame:
    """(i, j, re[, im]) of the product of (i, j, re[, im]) frames of m x k and k x n."""
    up = lambda total: max(1, -(-total // tile))
    blk = lambda c, size: F.floor(F.col(c) / size).cast("long")
    left = a.withColumn("bi", blk("i", tile)).withColumn("bk", blk("j", chunk)).withColumn("bj", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(up(n) - 1).cast("long"))))
    right = b.withColumn("bj", blk("j", tile)).withColumn("bk", blk("i", chunk)).withColumn("bi", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(up(m) - 1).cast("long"))))
    schema = "i long, j long, re double" + (", im double" if complex_ else "")
    parts = left.groupBy("bi", "bj", "bk").cogroup(right.groupBy("bi", "bj", "bk")).applyInArrow(tile_product(complex_, tile, chunk), schema)
    if k <= chunk:
        return parts
    return parts.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in (("re", "im") if complex_ else ("re",))))


def matmul(a: Array, b: Array, c: Array | None = None, *, alpha=1, beta=0, trans: tuple[bool, bool] = (False, False), boxes: tuple[Box, Box, Box] | None = None, tile: int = TILE, chunk: int = CHUNK) -> Array:
    """alpha * op(A) op(B) + beta * C on boxes of rank-2 arrays; without C, a new array. boxes refer to A and B before op."""
    for x in (a, b, *([c] if c else [])):
        require(x.dtype, "matmul")
        if x.dtype != a.dtype:
            raise ValueError("types differ")
    if a.ndim != 2 or b.ndim != 2:
        raise ValueError("matmul takes rank 2")
    own = [check_box(boxes[0], a.dims), check_box(boxes[1], b.dims)] if boxes else [full(a.dims), full(b.dims)]
    m, k = shape_of(own[0])[::-1] if trans[0] else shape_of(own[0])
    k2, n = shape_of(own[1])[::-1] if trans[1] else shape_of(own[1])
    target = check_box(boxes[2], c.dims) if boxes and c else full((m, n))
    if k != k2 or shape_of(target) != [m, n] or (c and not boxes and c.dims != (m, n)):
        raise ValueError(f"shapes {m} x {k}, {k2} x {n}")
    d, complex_ = a.dtype, a.dtype.kind == "complex"
    out = product(triples(a, own[0], trans[0]), triples(b, own[1], trans[1]), m, k, n, complex_, tile, chunk)
    value = N.pair(F.col("re"), F.col("im"), d) if complex_ else F.col("re").cast(d.spark)
    cells = out.select((F.col("i") + target[0][0]).alias("i0"), (F.col("j") + target[0][1]).alias("i1"), N.mul(value, N.constant(alpha, d), d).alias("v"))
    if c is None:
        return a.engine.from_df(cells, (m, n), d)
    if beta == 0 and target == full(c.dims):
        return c.with_df(cells)
    combined = (lambda old, x: N.add(N.mul(old, N.constant(beta, d), d), x, d)) if beta != 0 else None
    return upsert(c, cells, combined)


matmul_basic = matmul_mirrored = matmul


def matmul_patch(a: Array, b: Array, c: Array, *, boxes: tuple[Box, Box, Box], alpha=1, beta=0, trans: tuple[bool, bool] = (False, False)) -> Array:
    """Boxes of arrays of any rank whose other dimensions have one element; indices are those after op."""
    def flat(box: Box) -> tuple[list[int], list[int]]:
        wide = [d for d in range(len(box[0])) if box[0][d] != box[1][d]][-2:]
        if sum(low != high for low, high in zip(*box, strict=True)) > 2:
            raise ValueError("more than two dimensions")
        keep = sorted({*wide, *[d for d in range(len(box[0])) if d not in wide][-(2 - len(wide)):]} if len(wide) < 2 else wide)
        return keep, [box[1][d] - box[0][d] + 1 for d in keep]

    def plane(x: Array, box: Box) -> Array:
        box = check_box(box, x.dims)
        keep, shape = flat(box)
        df = x.df
        for d, (low, high) in enumerate(zip(*box, strict=True)):
            df = df.where(F.col(f"i{d}").between(low, high))
        df = df.select(*((F.col(f"i{d}") - box[0][d]).alias(f"_{k}") for k, d in enumerate(keep)), "v")
        return x.engine.from_df(df, shape, x.dtype, index=["_0", "_1"])

    out = matmul(plane(a, boxes[0]), plane(b, boxes[1]), alpha=alpha, trans=trans)
    box = check_box(boxes[2], c.dims)
    keep, shape = flat(box)
    if list(out.dims) != shape:
        raise ValueError(f"a product of {list(out.dims)} in a box of {shape}")
    at = {d: F.col(f"i{k}") + box[0][d] for k, d in enumerate(keep)}
    cells = out.df.select(*(at.get(d, F.lit(box[0][d]).cast("long")).alias(f"i{d}") for d in range(c.ndim)), "v")
    d = c.dtype
    return upsert(c, cells, (lambda old, x: N.add(N.mul(old, N.constant(beta, d), d), x, d)) if beta != 0 else None)


matmul_patch_alt = matmul_patch


def check_square(a: Array) -> int:
    if a.ndim != 2 or a.dims[0] != a.dims[1]:
        raise ValueError("a square matrix is needed")
    return a.dims[0]


def transpose(a: Array) -> Array:
    if a.ndim != 2:
        raise ValueError("transpose takes rank 2")
    return a.engine.from_df(a.df.select(F.col("i1").alias("i0"), F.col("i0").alias("i1"), "v"), a.dims[::-1], a.dtype)


def symmetrize(a: Array) -> Array:
    """(A + A^T) / 2 over the first two dimensions."""
    require(a.dtype, "solve")
    if a.ndim < 2 or a.dims[0] != a.dims[1]:
        raise ValueError("the first two dimensions differ")
    other = a.df.select(F.col("i1").alias("i0"), F.col("i0").alias("i1"), *(f"i{d}" for d in range(2, a.ndim)), F.col("v").alias("_t"))
    return a.with_df(a.df.join(other, a.index).withColumn("v", (F.col("v") + F.col("_t")) / 2))


def check_vector(a: Array, v: Array, n: int) -> None:
    if a.ndim != 2 or v.ndim != 1 or v.dims[0] != n or v.dtype != a.dtype:
        raise ValueError(f"a vector of {n} elements of the matrix' type is needed")


def get_diag(a: Array) -> Array:
    if a.ndim != 2:
        raise ValueError("a matrix is needed")
    return a.engine.from_df(a.df.where(F.col("i0") == F.col("i1")).select("i0", "v"), [min(a.dims)], a.dtype)


def with_vector(a: Array, v: Array, on: Column, value: Callable[[Column, Column], Column], only_diagonal: bool) -> Array:
    w = v.df.select(F.col("i0").alias("_at"), F.col("v").alias("_w"))
    if only_diagonal:  # the rest of the matrix needs no join
        diagonal = a.df.where(F.col("i0") == F.col("i1")).join(w, on == F.col("_at")).select("i0", "i1", value(F.col("v"), F.col("_w")).alias("v"))
        return a.with_df(a.df.where(F.col("i0") != F.col("i1")).unionByName(diagonal))
    return a.with_df(a.df.join(w, on == F.col("_at")).withColumn("v", value(F.col("v"), F.col("_w"))))


def set_diagonal(a: Array, v: Array) -> Array:
    check_vector(a, v, min(a.dims))
    return with_vector(a, v, F.col("i0"), lambda old, x: x, True)


def add_diagonal(a: Array, v: Array) -> Array:
    check_vector(a, v, min(a.dims))
    return with_vector(a, v, F.col("i0"), lambda old, x: N.add(old, x, a.dtype), True)


def shift_diagonal(a: Array, c) -> Array:
    return a.with_df(a.df.withColumn("v", F.when(F.col("i0") == F.col("i1"), N.add(F.col("v"), N.constant(c, a.dtype), a.dtype)).otherwise(F.col("v"))))


def zero_diagonal(a: Array) -> Array:
    return a.with_df(a.df.withColumn("v", F.when(F.col("i0") == F.col("i1"), N.constant(0, a.dtype)).otherwise(F.col("v"))))


def scale_rows(a: Array, v: Array) -> Array:
    """A[i, j] *= v[i]."""
    check_vector(a, v, a.dims[0])
    return with_vector(a, v, F.col("i0"), lambda old, x: N.mul(old, x, a.dtype), False)


def scale_cols(a: Array, v: Array) -> Array:
    """A[i, j] *= v[j]."""
    check_vector(a, v, a.dims[1])
    return with_vector(a, v, F.col("i1"), lambda old, x: N.mul(old, x, a.dtype), False)


def zero_triangle(a: Array, upper: bool) -> Array:
    out = F.col("i0") < F.col("i1") if upper else F.col("i0") > F.col("i1")
    return a.with_df(a.df.withColumn("v", F.when(out, N.constant(0, a.dtype)).otherwise(F.col("v"))))


def mirror_triangle(a: Array, upper: bool) -> Array:
    """The other triangle becomes the transposed one."""
    check_square(a)
    kept = a.df.where(F.col("i0") <= F.col("i1") if upper else F.col("i0") >= F.col("i1"))
    return a.with_df(kept.unionByName(kept.where(F.col("i0") != F.col("i1")).select(F.col("i1").alias("i0"), F.col("i0").alias("i1"), "v")))


# global kernels: one group
def tagged(arrays: list[Array]) -> DataFrame:
    out = None
    for k, a in enumerate(arrays):
        if max(a.dims) > MOST_GLOBAL:
            raise ValueError(f"at most {MOST_GLOBAL} rows")
        j = F.col("i1") if a.ndim == 2 else F.lit(0).cast("long")
        re, im = (F.col("v")["re"], F.col("v")["im"]) if a.dtype.kind == "complex" else (F.col("v"), F.lit(0.0))
        one = a.df.select(F.lit(0).alias("all"), F.lit(k).alias("which"), F.col("i0").alias("i"), j.alias("j"), re.cast("double").alias("re"), im.cast("double").alias("im"))
        out = one if out is None else out.unionByName(one)
    return out


def in_one_group(arrays: list[Array], fn: Callable[..., list[np.ndarray]]) -> DataFrame:
    """fn(matrices..) -> matrices; gives (which, i, j, re, im) of its results."""
    shapes = [(a.dims[0], a.dims[1] if a.ndim == 2 else 1) for a in arrays]
    complex_ = any(a.dtype.kind == "complex" for a in arrays)

    def run(pdf):
        import pandas as pd

        given = []
        for k, shape in enumerate(shapes):
            own = pdf[pdf["which"] == k]
            x = np.zeros(shape, complex if complex_ else float)
            x[own["i"], own["j"]] = own["re"] + 1j * own["im"] if complex_ else own["re"]
            given.append(x)
        frames = []
        for k, x in enumerate(fn(*given)):
            x = np.asarray(x)
            x = x[:, None] if x.ndim == 1 else x
            i, j = np.indices(x.shape).reshape(2, -1)
            frames.append(pd.DataFrame({"which": k, "i": i, "j": j, "re": x.real.ravel(), "im": x.imag.ravel()}))
        return pd.concat(frames)

    return tagged(arrays).groupBy("all").applyInPandas(run, "which int, i long, j long, re double, im double")


def result(out: DataFrame, which: int, dims: tuple[int, ...], like: Array) -> Array:
    d = like.dtype
    value = N.pair(F.col("re"), F.col("im"), d) if d.kind == "complex" else F.col("re").cast(d.spark)
    at = [F.col("i").alias("i0"), F.col("j").alias("i1")][: len(dims)]
    return like.engine.from_df(out.where(F.col("which") == which).select(*at, value.alias("v")), dims, d)


def lu_solve(a: Array, b: Array, trans: bool = False) -> Array:
    require(a.dtype, "solve")
    if check_square(a) > MOST_GLOBAL:
        return factor.solved(a, b, True, trans)
    return result(in_one_group([a, b], lambda x, y: [np.linalg.solve(x.T if trans else x, y)]), 0, b.dims, b)


lu_solve_alt = lu_solve_seq = lu_solve


def _llt(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    low = np.linalg.cholesky(x)
    return np.linalg.solve(low.conj().T, np.linalg.solve(low, y))


def cholesky(a: Array) -> Array:
    """The lower factor."""
    if check_square(a) > MOST_GLOBAL:
        return factor.cholesky(a)
    return result(in_one_group([a], lambda x: [np.linalg.cholesky(x)]), 0, a.dims, a)


def llt_solve(a: Array, b: Array) -> Array:
    if check_square(a) > MOST_GLOBAL:
        return factor.solved(a, b, False)
    return result(in_one_group([a, b], lambda x, y: [_llt(x, y)]), 0, b.dims, b)


def solve(a: Array, b: Array) -> Array:
    """Cholesky, and LU where the matrix isn't symmetric and positive; LU alone for a matrix that no group holds."""
    if check_square(a) > MOST_GLOBAL:
        return factor.solved(a, b, True)

    def run(x, y):
        if np.array_equal(x, x.T):
            try:
                return [_llt(x, y)]
            except np.linalg.LinAlgError:
                pass
        return [np.linalg.solve(x, y)]

    return result(in_one_group([a, b], run), 0, b.dims, b)


def spd_invert(a: Array) -> Array:
    n = check_square(a)
    if n > MOST_GLOBAL:
        return factor.inverse(a)
    return result(in_one_group([a], lambda x: [_llt(x, np.eye(n))]), 0, a.dims, a)


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Eigenvectors with their largest component positive, so that results agree between runs."""
    top = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return vectors * (np.abs(top) / top)[None, :]


def diag_std(a: Array) -> tuple[Array, Array]:
    """Eigenvectors (columns) and eigenvalues, ascending, of a symmetric or Hermitian matrix."""
    n = check_square(a)

    def run(x):
        values, vectors = np.linalg.eigh(x)
        return [_signed(vectors), values]

    out = in_one_group([a], run)
    return result(out, 0, a.dims, a), result(out, 1, (n,), a)


def diag(a: Array, s: Array) -> tuple[Array, Array]:
    """The generalised problem A x = l S x: eigenvectors and eigenvalues."""
    n = check_square(a)

    def run(x, y):
        low = np.linalg.cholesky(y)
        half = np.linalg.solve(low, x)
        values, vectors = np.linalg.eigh(np.linalg.solve(low, half.conj().T).conj().T)
        return [_signed(np.linalg.solve(low.conj().T, vectors)), values]

    out = in_one_group([a, s], run)
    return result(out, 0, a.dims, a), result(out, 1, (n,), a)


diag_reuse = diag_seq = diag
diag_std_seq = diag_std
