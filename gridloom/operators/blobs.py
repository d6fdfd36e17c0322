"""Arrays whose elements are byte strings of any size: rows (i0.., data, size)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from math import prod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.index import Box, check_box, inside, names
from gridloom.plans.engine import Engine
from gridloom.plans.layout import Layout


@dataclass(frozen=True)
class Blobs:
    """Elements that were never assigned have no row."""

    df: DataFrame
    dims: tuple[int, ...]
    engine: Engine
    layout: Layout

    @property
    def ndim(self) -> int:
        return len(self.dims)

    @property
    def index(self) -> list[str]:
        return names(self.ndim)

    def with_df(self, df: DataFrame) -> Blobs:
        return replace(self, df=df.select(*self.index, "data", F.length("data").alias("size")))


def create(engine: Engine, dims: Sequence[int], chunk: Sequence[int] | None = None, starts: Sequence[Sequence[int]] | None = None) -> Blobs:
    if not dims or min(dims) < 1 or len(dims) > 7:
        raise ValueError(f"dimensions {list(dims)}")
    layout = Layout.irregular(dims, starts, engine.n_processes) if starts else Layout.regular(dims, engine.n_processes, chunk)
    fields = ", ".join(f"{n} long" for n in names(len(dims)))
    return Blobs(engine.spark.createDataFrame([], f"{fields}, data binary, size int"), tuple(dims), engine, layout)


def from_frame(engine: Engine, df: DataFrame, dims: Sequence[int]) -> Blobs:
    """df: subscripts and data."""
    return create(engine, dims).with_df(df)


def distribution(b: Blobs, process: int) -> Box | None:
    return b.layout.process_box(process)


def merged(b: Blobs, new: DataFrame) -> Blobs:
    """Rows of new in place of those of b; full outer, since b has no row for unassigned elements."""
    new = new.select(*(F.col(n).cast("long").alias(n) for n in b.index), F.col("data").alias("_new"))
    return b.with_df(b.df.join(new, b.index, "full").withColumn("data", F.coalesce("_new", "data")))


def assign(b: Blobs, at: Sequence[int], data: bytes) -> Blobs:
    check_box((at, at), b.dims)
    return merged(b, b.engine.spark.createDataFrame([(*at, bytearray(data))], b.df.drop("size").schema))


def free(b: Blobs, lo: Sequence[int], hi: Sequence[int]) -> Blobs:
    return replace(b, df=b.df.where(~inside(check_box((lo, hi), b.dims))))


def destroy(b: Blobs) -> None:
    """Nothing of it is kept any longer."""
    b.df.unpersist()


def zeroed(b: Blobs) -> Blobs:
    """All bytes of all elements 0; sizes stay."""
    return b.with_df(b.df.withColumn("data", F.unhex(F.repeat(F.lit("00"), F.length("data")))))


def get(b: Blobs, lo: Sequence[int], hi: Sequence[int]) -> DataFrame:
    box = check_box((lo, hi), b.dims)
    return b.df.where(inside(box)).select(*((F.col(n) - low).alias(n) for n, low in zip(b.index, box[0], strict=True)), "data", "size")


def get_size(b: Blobs, lo: Sequence[int], hi: Sequence[int]) -> int:
    return b.df.where(inside(check_box((lo, hi), b.dims))).agg(F.coalesce(F.sum(F.col("size").cast("long")), F.lit(0))).first()[0]


def same_sizes(b: Blobs, new: DataFrame) -> DataFrame:
    old = b.df.select(*b.index, F.col("size").alias("_size"))
    wrong = F.raise_error(F.lit("the size of an element differs")).cast("binary")
    return new.join(old, b.index, "left").withColumn("data", F.when(F.col("_size").isNull() | (F.col("_size") == F.length("data")), F.col("data")).otherwise(wrong)).drop("_size")


def put(b: Blobs, lo: Sequence[int], hi: Sequence[int], values: DataFrame, check_size: bool = False) -> Blobs:
    """values: subscripts from 0 in the box, and data; check_size: an element may not change its size."""
    box = check_box((lo, hi), b.dims)
    new = values.select(*((F.col(n) + low).alias(n) for n, low in zip(b.index, box[0], strict=True)), "data").where(inside(box))
    return merged(b, same_sizes(b, new) if check_size else new)


def gather(b: Blobs, subs: DataFrame) -> DataFrame:
    """subs: pos and subscripts; unassigned elements give null data of size 0."""
    found = subs.join(b.df, b.index, "left")
    return found.select("pos", *b.index, "data", F.coalesce("size", F.lit(0)).alias("size"))


def gather_size(b: Blobs, subs: DataFrame) -> int:
    return gather(b, subs).agg(F.coalesce(F.sum(F.col("size").cast("long")), F.lit(0))).first()[0]


def scatter(b: Blobs, subs: DataFrame, check_size: bool = False) -> Blobs:
    """subs: pos, subscripts and data; of repeated subscripts the greatest pos stays."""
    last = subs.groupBy(*b.index).agg(F.max_by("data", "pos").alias("data"))
    return merged(b, same_sizes(b, last) if check_size else last)


def element(b: Blobs, at: Sequence[int]) -> bytes | None:
    row = b.df.where(inside(check_box((at, at), b.dims))).select("data").first()
    return bytes(row[0]) if row and row[0] is not None else None


def summary(b: Blobs) -> DataFrame:
    return b.df.agg(F.count(F.lit(1)).alias("assigned"), F.lit(prod(b.dims)).alias("elements"), F.coalesce(F.sum(F.col("size").cast("long")), F.lit(0)).alias("bytes"))
