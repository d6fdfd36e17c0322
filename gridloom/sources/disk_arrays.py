"""Arrays on disk: Parquet, one folder for each block, with a small description beside it.

Blocks follow the shape of a typical request, so that reading a section prunes folders and writing one replaces only the
folders of the blocks that it touches.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.dtypes import DType, as_dtype
from gridloom.functions.index import Box, check_box, full, inside, names
from gridloom.operators.elementwise import placed, upsert
from gridloom.plans.engine import Array, Engine
from gridloom.plans.lineage import cut
from gridloom.sources import storage

BLOCK_CELLS = 1 << 20
#: Files that a write makes at most for each block's folder set (None: one for each block), and whether writes and reads
#: are reported; set_default_config and set_debug change them.
DEFAULTS: dict = {"files": None, "debug": False}


@dataclass(frozen=True)
class DiskArray:
    engine: Engine
    path: str
    name: str
    dims: tuple[int, ...]
    dtype: DType
    chunk: tuple[int, ...]
    files: int | None = None

    @property
    def data(self) -> str:
        return f"{self.path}/data"

    def block_columns(self) -> list[Column]:
        return [F.floor(F.col(f"i{d}") / c).cast("long").alias(f"b{d}") for d, c in enumerate(self.chunk)]

    def schema(self) -> str:
        n = len(self.dims)
        return ", ".join([*(f"i{d} long" for d in range(n)), f"v {self.dtype.spark.simpleString()}", *(f"b{d} long" for d in range(n))])


def typical_chunk(dims: Sequence[int], request: Sequence[int] | None) -> tuple[int, ...]:
    """The request's shape, or the whole array, halved along its longest side until a block is small enough."""
    chunk = [min(d, r) if r and r > 0 else d for d, r in zip(dims, request or [0] * len(dims), strict=True)]
    while prod(chunk) > BLOCK_CELLS:
        d = max(range(len(chunk)), key=lambda k: chunk[k])
        chunk[d] = -(-chunk[d] // 2)
    return tuple(chunk)


def create(engine: Engine, path: str, dims: Sequence[int], dtype: str | DType, name: str = "", request: Sequence[int] | None = None, files: int | None = None) -> DiskArray:
    """An array of zeros that takes no room until it is written. files: the number of tasks, and so of files at once, that
    a write of the whole array is dealt to; by default each block has its own."""
    d = as_dtype(dtype)
    files = DEFAULTS["files"] if files is None else files
    if files is not None and files < 1:
        raise ValueError(f"{files} files")
    out = DiskArray(engine, path.rstrip("/"), name, tuple(dims), d, typical_chunk(dims, request), files)
    storage.write_json(engine.spark, f"{out.path}/array.json", {"name": name, "dims": list(dims), "dtype": d.name, "chunk": list(out.chunk), "files": files})
    return out


def set_default_config(files: int | None) -> None:
    """What create takes where it is told nothing."""
    DEFAULTS["files"] = files


def set_debug(on: bool) -> None:
    DEFAULTS["debug"] = bool(on)


def internals(d: DiskArray) -> dict:
    """The description, and what is stored: blocks, files and bytes."""
    spark = d.engine.spark
    there = storage.exists(spark, d.data)
    blocks = stored(d).select(*(f"b{k}" for k in range(len(d.dims)))).distinct().count() if there else 0
    files = stored(d).select(F.input_file_name()).distinct().count() if there else 0
    return inquire(d) | {"chunk": d.chunk, "files": d.files, "blocks": blocks, "stored_files": files, "bytes": storage.length(spark, d.path)}


def told(d: DiskArray, what: str) -> None:
    if DEFAULTS["debug"]:
        print(f"disk array {d.name or d.path}: {what}")


def open_array(engine: Engine, path: str) -> DiskArray:
    path = path.rstrip("/")
    if not storage.exists(engine.spark, f"{path}/array.json"):
        raise ValueError(f"no array at {path}")
    said = storage.read_json(engine.spark, f"{path}/array.json")
    return DiskArray(engine, path, said["name"], tuple(said["dims"]), as_dtype(said["dtype"]), tuple(said["chunk"]), said.get("files"))


def inquire(d: DiskArray) -> dict:
    return {"dtype": d.dtype.name, "ndim": len(d.dims), "dims": d.dims, "name": d.name, "path": d.path}


def delete(d: DiskArray) -> None:
    storage.delete(d.engine.spark, d.path)


def stored(d: DiskArray, box: Box | None = None) -> DataFrame:
    """Cells that were written, of the blocks that a box meets."""
    spark = d.engine.spark
    if not storage.exists(spark, d.data):
        return spark.createDataFrame([], d.schema())
    df = spark.read.schema(d.schema()).parquet(d.data)
    if box:
        for k, (lo, hi, c) in enumerate(zip(*box, d.chunk, strict=True)):
            df = df.where(F.col(f"b{k}").between(lo // c, hi // c))  # prunes folders
        df = df.where(inside(box))
    return df


def dealt(d: DiskArray, cells: DataFrame) -> DataFrame:
    at = d.block_columns()
    keys = [f"b{k}" for k in range(len(d.dims))]
    return cells.select(*names(len(d.dims)), "v", *at).repartition(*([d.files] if d.files else []), *keys).sortWithinPartitions(*keys, *names(len(d.dims)))


def write(a: Array, d: DiskArray) -> DiskArray:
    """The whole array."""
    check_same(a, d)
    if a.dims != d.dims:
        raise ValueError(f"dimensions {a.dims} and {d.dims}")
    told(d, "write")
    dealt(d, a.df).write.mode("overwrite").partitionBy(*(f"b{k}" for k in range(a.ndim))).parquet(d.data)
    return d


def check_same(a: Array, d: DiskArray) -> None:
    if a.dtype != d.dtype or a.ndim != len(d.dims):
        raise ValueError("types or ranks differ")


def read(d: DiskArray) -> Array:
    return densified(d, full(d.dims))


def densified(d: DiskArray, box: Box) -> Array:
    """The box as an array; cells that were never written are 0."""
    shape = [h - lo + 1 for lo, h in zip(*box, strict=True)]
    zeros = d.engine.create(shape, d.dtype)
    found = stored(d, box).select(*((F.col(n) - lo).alias(n) for n, lo in zip(names(len(shape)), box[0], strict=True)), "v")
    return upsert(zeros, found)


def read_section(d: DiskArray, box: Box, into: Array | None = None, target: Box | None = None, trans: bool = False) -> Array:
    """A section as an array, or placed in a box of another one."""
    box = check_box(box, d.dims)
    section = densified(d, box)
    if into is None:
        return section
    check_same(into, d)
    target = check_box(target, into.dims) if target else full(into.dims)
    return upsert(into, placed(section, full(section.dims), target, trans))


def write_section(a: Array, source: Box, d: DiskArray, target: Box, trans: bool = False) -> DiskArray:
    """A box of a in a box of d of the same capacity; only the blocks that it meets are written again."""
    check_same(a, d)
    source, target = check_box(source, a.dims), check_box(target, d.dims)
    new = placed(a, source, target, trans)
    touched = [(lo // c * c, min(n - 1, hi // c * c + c - 1)) for lo, hi, c, n in zip(*target, d.chunk, d.dims, strict=True)]
    old = stored(d, ([t[0] for t in touched], [t[1] for t in touched])).select(*names(a.ndim), "v")
    kept = old.where(~inside(target))
    cells = cut(dealt(d, kept.unionByName(new)), "section")  # the blocks are read before they are replaced
    keys = [f"b{k}" for k in range(a.ndim)]
    cells.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(d.data)
    return d


# requests end with the write or read that made them
def probe(_=None) -> bool:
    return True


def wait(_=None) -> None: ...


close = wait
