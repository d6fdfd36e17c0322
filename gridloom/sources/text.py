"""Arrays as text: boxes as rows or as a table, block maps, catalog listings."""

from __future__ import annotations

from collections.abc import Sequence
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.dtypes import DType
from gridloom.functions.index import inside, linear, shape_of
from gridloom.plans.engine import Array, Engine

#: Columns of a printed table at most.
MOST_COLUMNS = 1000


def shown(v: Column, d: DType) -> Column:
    if d.kind == "complex":
        return F.format_string("(%.6f, %.6f)", v["re"].cast("double"), v["im"].cast("double"))
    return F.format_string("%12.6f", v.cast("double")) if d.kind == "real" else F.format_string("%8d", v.cast("long"))


def lines(a: Array, lo: Sequence[int] | None = None, hi: Sequence[int] | None = None) -> DataFrame:
    """lin and value: a line for each cell of the box, in linear order."""
    box = a.box(lo, hi)
    at = F.concat_ws(",", *(F.col(n).cast("string") for n in a.index))
    return a.df.where(inside(box)).select(linear(a.dims).alias("lin"), F.concat(F.lit("["), at, F.lit("] "), shown(F.col("v"), a.dtype)).alias("value"))


def table(a: Array, lo: Sequence[int] | None = None, hi: Sequence[int] | None = None) -> DataFrame:
    """A box of rank 2 as a table: a row for each i0, a column for each i1."""
    if a.ndim != 2:
        raise ValueError("a table takes rank 2")
    box = a.box(lo, hi)
    columns = list(range(box[0][1], box[1][1] + 1))
    if len(columns) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} columns")
    out = a.df.where(inside(box)).withColumn("v", shown(F.col("v"), a.dtype))
    return out.groupBy("i0").pivot("i1", columns).agg(F.first("v")).orderBy("i0")


def print_patch(a: Array, lo: Sequence[int] | None = None, hi: Sequence[int] | None = None, pretty: bool = True, most: int = 1000) -> str:
    """The box as text, at most so many rows, and how many were left out; it is printed and returned. print_file writes them all."""
    box = a.box(lo, hi)
    if pretty and a.ndim == 2:
        rows = table(a, lo, hi).limit(most).collect()
        out, n = [" ".join(map(str, r)) for r in rows], box[1][0] - box[0][0] + 1
    else:
        out, n = [r["value"] for r in lines(a, lo, hi).orderBy("lin").limit(most).collect()], prod(shape_of(box))
    if n > len(out):
        out.append(f"... {n - len(out)} more rows")
    text = "\n".join([f"array {a.name or '-'} {a.dtype.name} {list(a.dims)}", *out])
    print(text)
    return text


def print_file(a: Array, path: str, lo: Sequence[int] | None = None, hi: Sequence[int] | None = None) -> None:
    lines(a, lo, hi).orderBy("lin").select("value").write.mode("overwrite").text(path)


def distribution(a: Array) -> DataFrame:
    """A row for each block: its owner and bounds."""
    rows = [(owner, list(map(int, box[0])), list(map(int, box[1]))) for _, box, owner in a.layout.blocks()]
    return a.engine.spark.createDataFrame(rows, "process int, lo array<long>, hi array<long>")


def stats(engine: Engine) -> dict[str, int]:
    return dict(engine.counters) | {"arrays": len(engine.arrays), "bytes": engine.memory_used()}
