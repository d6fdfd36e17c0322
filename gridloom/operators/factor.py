"""LU and Cholesky factors of matrices that no single task holds, and the solutions of systems by them.

A matrix is cut into column panels of bounded size (PANEL_BYTES), a row of a table each. Panels are factored from left to
right: one task factors the next panel, with partial pivoting for LU, and all panels to its right, those of the right
sides among them, are updated in parallel from that one panel. Every step ends in a written table. Then the right sides'
panels are solved backwards through the factored panels. A task holds two panels, whatever the matrix' size; the factored
panel of a step, of bounded size, is what is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import numbers as N
from gridloom.plans.engine import Array
from gridloom.plans.lineage import cut

#: Bytes of a panel at most; a panel has one column at least.
PANEL_BYTES = 16 << 20
PANELS = "p long, data binary"


def width_of(n: int, item: int) -> int:
    return max(1, min(n, PANEL_BYTES // (n * item)))


def unpacked(data: bytes, n: int, kind: type) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(n, -1).copy()


def panels(a: Array, width: int, kind: type, first: int = 0, trans: bool = False) -> DataFrame:
    """p and data: the columns of a matrix or a vector, width of them in a row, row-major; numbered from first."""
    n, m = (a.dims[0], a.dims[1] if a.ndim == 2 else 1)
    i, j = F.col("i0"), F.col("i1") if a.ndim == 2 else F.lit(0).cast("long")
    if trans:
        n, m, i, j = m, n, j, i
    re, im = (F.col("v")["re"], F.col("v")["im"]) if a.dtype.kind == "complex" else (F.col("v"), F.lit(0.0))
    cells = a.df.select(F.floor(j / width).alias("p"), i.alias("i"), j.alias("j"), re.cast("double").alias("re"), im.cast("double").alias("im"))

    def packed(key, t):
        import pyarrow as pa

        p = key[0].as_py()
        out = np.zeros((n, min(width, m - p * width)), kind)
        value = t.column("re").to_numpy()
        out[t.column("i").to_numpy(), t.column("j").to_numpy() - p * width] = value + 1j * t.column("im").to_numpy() if kind is complex else value
        return pa.table({"p": [p + first], "data": pa.array([out.tobytes()], pa.binary())})

    return cells.groupBy("p").applyInArrow(packed, PANELS)


def cells(rows: DataFrame, n: int, width: int, kind: type, first: int, like: Array, dims: tuple[int, ...]) -> Array:
    """The array of panels numbered from first."""
    d = like.dtype

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for p, data in zip(batch.column(0), batch.column(1), strict=True):
                x = unpacked(data.as_py(), n, kind)
                at = np.indices(x.shape).reshape(2, -1)
                columns = [at[0], at[1] + (p.as_py() - first) * width, x.real.ravel().astype(float), x.imag.ravel().astype(float)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["i", "j", "re", "im"])

    out = rows.mapInArrow(run, "i long, j long, re double, im double")
    v = N.pair(F.col("re"), F.col("im"), d) if d.kind == "complex" else F.col("re").cast(d.spark)
    at = [F.col("i").alias("i0"), F.col("j").alias("i1")][: len(dims)]
    return like.engine.from_df(out.select(*at, v.alias("v")), dims, d)


def each(rows: DataFrame, fn: Callable[[int, bytes], bytes | tuple], schema: str = PANELS) -> DataFrame:
    """fn on the panels (p, data), one by one."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for p, data in zip(batch.column(0), batch.column(1), strict=True):
                out = fn(p.as_py(), data.as_py())
                parts = out if isinstance(out, tuple) else (out,)
                yield pa.RecordBatch.from_arrays([pa.array([p.as_py()]), *(pa.array([x], pa.binary()) for x in parts)], ["p", "data", "swaps"][: len(parts) + 1])

    return rows.select("p", "data").mapInArrow(run, schema)


def with_panel(rows: DataFrame, panel: DataFrame, fn: Callable[[int, bytes, bytes, bytes], bytes]) -> DataFrame:
    """fn(p, data, the panel's data, its swaps) on the rows; panel: one row."""
    one = panel.select(F.lit(1).alias("_one"), F.col("data").alias("lead"), "swaps")
    both = rows.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one").select("p", "data", "lead", "swaps")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for p, data, lead, swaps in zip(*batch.columns, strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([p.as_py()]), pa.array([fn(p.as_py(), data.as_py(), lead.as_py(), swaps.as_py())], pa.binary())], ["p", "data"])

    return both.mapInArrow(run, PANELS)


def lu_panel(x: np.ndarray, top: int) -> np.ndarray:
    """Factor the panel's rows from top on in place, L below the diagonal; gives the order of the rows."""
    order = np.arange(len(x))
    for c in range(x.shape[1]):
        r = top + c
        best = r + int(np.abs(x[r:, c]).argmax())
        if x[best, c] == 0:
            raise np.linalg.LinAlgError("singular matrix")
        if best != r:
            x[[r, best]] = x[[best, r]]
            order[[r, best]] = order[[best, r]]
        x[r + 1 :, c] /= x[r, c]
        x[r + 1 :, c + 1 :] -= x[r + 1 :, c : c + 1] * x[r, c + 1 :]
    return order


def factored(rest: DataFrame, n: int, width: int, kind: type, pivot: bool) -> tuple[list[DataFrame], DataFrame]:
    """The factored panels (p, data, swaps), and what became of the right sides' panels, whose numbers follow."""
    count, done = -(-n // width), []

    for k in range(count):
        top, wide = k * width, min(width, n - k * width)

        def factor(_, data, top=top, wide=wide):
            x = unpacked(data, n, kind)
            if pivot:
                order = lu_panel(x, top).astype(np.int64)
                return x.tobytes(), order.tobytes()
            low = np.linalg.cholesky(x[top : top + wide])
            x[top : top + wide] = low
            x[top + wide :] = np.linalg.solve(low, x[top + wide :].conj().T).conj().T
            return x.tobytes(), b""

        def update(p, data, lead, swaps, top=top, wide=wide):
            x, low = unpacked(data, n, kind), unpacked(lead, n, kind)
            if pivot:
                x = x[np.frombuffer(swaps, np.int64)]
                x[top : top + wide] = np.linalg.solve(np.tril(low[top : top + wide], -1) + np.eye(wide), x[top : top + wide])
            elif p < count:  # the matrix' own panel: minus L times the part of L that meets its columns
                own = low[p * width : p * width + x.shape[1]]
                x[top + wide :] -= low[top + wide :] @ own.conj().T
                return x.tobytes()
            else:
                x[top : top + wide] = np.linalg.solve(np.tril(low[top : top + wide]), x[top : top + wide])
            x[top + wide :] -= low[top + wide :] @ x[top : top + wide]
            return x.tobytes()

        lead = cut(each(rest.where(F.col("p") == k), factor, f"{PANELS}, swaps binary"), "panel")
        done.append(lead)
        rest = cut(with_panel(rest.where(F.col("p") > k), lead, update), "panels")
    return done, rest


def backward(done: list[DataFrame], sides: DataFrame, n: int, width: int, kind: type, pivot: bool) -> DataFrame:
    for k in range(len(done) - 1, -1, -1):
        top, wide = k * width, min(width, n - k * width)

        def back(_, data, lead, __, top=top, wide=wide):
            y, f = unpacked(data, n, kind), unpacked(lead, n, kind)
            mine = f[top : top + wide]
            if pivot:
                y[top : top + wide] = np.linalg.solve(np.triu(mine), y[top : top + wide])
                y[:top] -= f[:top] @ y[top : top + wide]
            else:
                y[top : top + wide] -= f[top + wide :].conj().T @ y[top + wide :]
                y[top : top + wide] = np.linalg.solve(np.tril(mine).conj().T, y[top : top + wide])
            return y.tobytes()

        sides = cut(with_panel(sides, done[k], back), "sides")
    return sides


def solved(a: Array, b: Array, pivot: bool, trans: bool = False, width: int | None = None) -> Array:
    """x with A x = b (A^T x = b), by LU with partial pivoting or, pivot False, by Cholesky; width: columns of a panel."""
    n = a.dims[0]
    kind = complex if "complex" in (a.dtype.kind, b.dtype.kind) else float
    width = width or width_of(n, np.dtype(kind).itemsize)
    count = -(-n // width)
    rest = cut(panels(a, width, kind, trans=trans).unionByName(panels(b, width, kind, first=count)), "panels")
    done, sides = factored(rest, n, width, kind, pivot)
    return cells(backward(done, sides, n, width, kind, pivot), n, width, kind, count, b, b.dims)


def cholesky(a: Array) -> Array:
    """The lower factor."""
    n = a.dims[0]
    kind = complex if a.dtype.kind == "complex" else float
    width = width_of(n, np.dtype(kind).itemsize)
    done, _ = factored(cut(panels(a, width, kind), "panels"), n, width, kind, False)
    out = None
    for k, one in enumerate(done):
        low = each(one, lambda _, data, k=k: np.tril(unpacked(data, n, kind), -k * width).tobytes())
        out = low if out is None else out.unionByName(low)
    return cells(out, n, width, kind, 0, a, a.dims)


def inverse(a: Array) -> Array:
    """Of a symmetric (Hermitian) positive matrix."""
    e = a.engine
    eye = e.create(a.dims, a.dtype)
    eye = eye.with_df(eye.df.withColumn("v", F.when(F.col("i0") == F.col("i1"), N.constant(1, a.dtype)).otherwise(F.col("v"))))
    return solved(a, eye, False)
