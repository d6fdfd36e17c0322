"""The engine: a Spark session with a catalog of arrays, process groups and settings.

Arrays are immutable: an operator returns a new array, and a handle can be bound to it. Barriers, fences and locks have
no counterpart, since nothing is written in place; their methods exist and do nothing.
"""

from __future__ import annotations

import random
import threading
import time
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from math import prod

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions import numbers as N
from gridloom.functions.dtypes import DType, as_dtype
from gridloom.functions.index import Box, check_box, full, inside, names, subscripts
from gridloom.plans import versions
from gridloom.plans.layout import Layout

VERSION = (1, 0, 0)
MOST_DIMS = 7


@dataclass(frozen=True)
class Group:
    members: tuple[int, ...]
    id: int


@dataclass(frozen=True)
class Array:
    """A dense array: one row (i0, .., v) for each cell."""

    df: DataFrame
    dims: tuple[int, ...]
    dtype: DType
    engine: Engine
    layout: Layout
    name: str = ""
    ghosts: tuple[int, ...] = ()
    corners: bool = True
    group: int = 0
    hint: str = ""

    @property
    def ndim(self) -> int:
        return len(self.dims)

    @property
    def size(self) -> int:
        return prod(self.dims)

    @property
    def index(self) -> list[str]:
        return names(self.ndim)

    @property
    def has_ghosts(self) -> bool:
        return any(self.ghosts)

    @property
    def schema(self) -> tuple[str, int, tuple[int, ...]]:
        return self.dtype.name, self.ndim, self.dims

    def box(self, lo: Sequence[int] | None = None, hi: Sequence[int] | None = None) -> Box:
        return full(self.dims) if lo is None else check_box((lo, hi), self.dims)

    def with_df(self, df: DataFrame, **changes) -> Array:
        return replace(self, df=df.select(*names(len(changes.get("dims", self.dims))), "v"), **changes)

    def with_value(self, value: Column, box: Box | None = None) -> Array:
        """A new version whose cells in the box hold value."""
        new = value if box is None or box == full(self.dims) else F.when(inside(box), value).otherwise(F.col("v"))
        return replace(self, df=self.df.withColumn("v", new))

    def like(self, name: str = "") -> Array:
        """Same type, dimensions and layout, all zero."""
        return self.engine.create(self.dims, self.dtype, name=name, layout=self.layout, ghosts=self.ghosts)

    def cached(self) -> Array:
        return replace(self, df=self.df.persist(StorageLevel.MEMORY_AND_DISK), hint="read_only")

    def uncached(self) -> Array:
        self.df.unpersist()
        return replace(self, hint="")

    def collect(self, lo: Sequence[int] | None = None, hi: Sequence[int] | None = None):
        """A box as a numpy array: the one way in which cells reach the driver."""
        import numpy as np

        box = self.box(lo, hi)
        rows = self.df.where(inside(box)).select(*self.index, "v").toPandas()
        out = np.zeros([h - low + 1 for low, h in zip(*box, strict=True)], complex if self.dtype.kind == "complex" else float if self.dtype.kind == "real" else np.int64)
        at = tuple(rows[c].to_numpy() - low for c, low in zip(self.index, box[0], strict=True))
        out[at] = [complex(x["re"], x["im"]) for x in rows["v"]] if self.dtype.kind == "complex" else rows["v"].to_numpy()
        return out


@dataclass
class Builder:
    """Two-phase creation: set what is known, then allocate."""

    engine: Engine
    dims: tuple[int, ...] | None = None
    dtype: DType | None = None
    label: str = ""
    chunk: tuple[int, ...] | None = None
    ghosts: tuple[int, ...] = ()
    corners: bool = True
    group: int = 0
    layout_of: object = None
    processes: tuple[int, ...] | None = None

    def set_data(self, dims: Sequence[int], dtype: str | DType) -> Builder:
        if not 1 <= len(dims) <= MOST_DIMS or min(dims) < 1:
            raise ValueError(f"dimensions {list(dims)}")
        return replace(self, dims=tuple(dims), dtype=as_dtype(dtype))

    def set_name(self, name: str) -> Builder:
        return replace(self, label=name)

    def set_chunk(self, chunk: Sequence[int]) -> Builder:
        return replace(self, chunk=tuple(chunk))

    def set_ghosts(self, width: Sequence[int], corners: bool = True) -> Builder:
        return replace(self, ghosts=tuple(width), corners=corners)

    def set_group(self, group: int) -> Builder:
        return replace(self, group=group)

    def set_irregular(self, starts: Sequence[Sequence[int]]) -> Builder:
        return replace(self, layout_of=lambda dims, n: Layout.irregular(dims, starts, n))

    def set_block_cyclic(self, size: Sequence[int], grid: Sequence[int] | None = None, tiled: bool = False) -> Builder:
        kind = "tiled" if tiled else "scalapack" if grid else "block_cyclic"
        return replace(self, layout_of=lambda dims, n: Layout.blocks_of_size(kind, dims, size, n, grid))

    def set_tiled_irregular(self, starts: Sequence[Sequence[int]], grid: Sequence[int]) -> Builder:
        return replace(self, layout_of=lambda dims, n: Layout("tiled_irreg", tuple(map(tuple, starts)), tuple(dims), n, tuple(grid)))

    def set_restricted(self, processes: Sequence[int]) -> Builder:
        return replace(self, processes=tuple(processes))

    def allocate(self) -> Array:
        if self.dims is None or self.dtype is None:
            raise ValueError("dimensions and type are not set")
        if self.ghosts and len(self.ghosts) != len(self.dims):
            raise ValueError("a ghost width for each dimension is needed")
        n = len(self.processes) if self.processes else len(self.engine.groups[self.group].members)
        layout = self.layout_of(self.dims, n) if self.layout_of else Layout.regular(self.dims, n, self.chunk)
        return self.engine.create(self.dims, self.dtype, name=self.label, layout=layout, ghosts=self.ghosts, corners=self.corners, group=self.group)


@dataclass
class Engine:
    spark: SparkSession
    n_processes: int = 4
    per_node: int = 4
    memory_limit: int | None = None
    debug: bool = False
    arrays: dict[str, Array] = field(default_factory=dict)
    types: dict[str, T.StructType] = field(default_factory=dict)
    groups: dict[int, Group] = field(default_factory=dict)
    default_group: int = 0
    mutexes: list[threading.Lock] = field(default_factory=list)
    counters: dict[str, int] = field(default_factory=dict)
    events: list[tuple] = field(default_factory=list)
    _random: random.Random = field(default_factory=lambda: random.Random(20_261_126))

    def __post_init__(self) -> None:
        self.groups.setdefault(0, Group(tuple(range(self.n_processes)), 0))

    # creation and catalog
    def builder(self) -> Builder:
        return Builder(self, group=self.default_group)

    def create(self, dims: Sequence[int], dtype: str | DType, *, name: str = "", layout: Layout | None = None, chunk: Sequence[int] | None = None, ghosts: Sequence[int] = (), corners: bool = True, group: int | None = None, fill=0) -> Array:
        """A new array of zeros: rows are generated where they are used."""
        dims, dtype = tuple(dims), as_dtype(dtype)
        if not 1 <= len(dims) <= MOST_DIMS or min(dims) < 1:
            raise ValueError(f"dimensions {list(dims)}")
        group = self.default_group if group is None else group
        layout = layout or Layout.regular(dims, len(self.groups[group].members), chunk)
        cells = self.spark.range(prod(dims))
        df = cells.select(*(c.alias(n) for c, n in zip(subscripts(F.col("id"), dims), names(len(dims)), strict=True)), N.constant(fill, dtype).alias("v"))
        return self.register(Array(df, dims, dtype, self, layout, name, tuple(ghosts), corners, group))

    def from_df(self, df: DataFrame, dims: Sequence[int], dtype: str | DType, *, name: str = "", index: Sequence[str] | None = None, value: str = "v") -> Array:
        """An array over a DataFrame that has a row for each cell."""
        dims, dtype = tuple(dims), as_dtype(dtype)
        index = index or names(len(dims))
        v = F.col(value) if dtype.kind == "complex" else F.col(value).cast(dtype.spark)
        df = df.select(*(F.col(c).cast("long").alias(n) for c, n in zip(index, names(len(dims)), strict=True)), v.alias("v"))
        return self.register(Array(df, dims, dtype, self, Layout.regular(dims, self.n_processes), name))

    def from_numpy(self, values, dtype: str | DType | None = None, name: str = "") -> Array:
        import numpy as np
        import pandas as pd

        values = np.asarray(values)
        dtype = as_dtype(dtype or {"i": "long", "f": "double", "c": "cdouble"}[values.dtype.kind])
        at = np.indices(values.shape).reshape(values.ndim, -1)
        table = pd.DataFrame({n: at[d] for d, n in enumerate(names(values.ndim))})
        flat = values.ravel()
        if dtype.kind == "complex":
            table["re"], table["im"] = flat.real, flat.imag
            df = self.spark.createDataFrame(table).withColumn("v", N.pair(F.col("re"), F.col("im"), dtype))
        else:
            table["v"] = flat
            df = self.spark.createDataFrame(table)
        return self.from_df(df, values.shape, dtype, name=name)

    def register(self, a: Array) -> Array:
        if a.name:
            self.arrays[a.name] = a
        self.counters["create"] = self.counters.get("create", 0) + 1
        return a

    def destroy(self, a: Array) -> None:
        a.df.unpersist()
        self.arrays.pop(a.name, None)

    def valid(self, a: Array) -> bool:
        return isinstance(a, Array) and a.engine is self

    def check(self, a: Array, what: str = "array") -> None:
        if not self.valid(a):
            raise ValueError(f"invalid {what}")

    def overlay(self, dims: Sequence[int], on: Array, name: str = "") -> Array:
        """An array over the first cells, in linear order, of another one."""
        from gridloom.functions.index import linear

        if prod(dims) > on.size:
            raise ValueError("the overlay is larger than its parent")
        lin = on.df.select(linear(on.dims).alias("lin"), "v").where(F.col("lin") < prod(dims))
        df = lin.select(*(c.alias(n) for c, n in zip(subscripts(F.col("lin"), dims), names(len(dims)), strict=True)), "v")
        return self.from_df(df, dims, on.dtype, name=name)

    def register_type(self, name: str, fields: T.StructType) -> T.StructType:
        self.types[name] = fields
        return fields

    def deregister_type(self, name: str) -> None:
        del self.types[name]

    # groups
    def create_group(self, members: Sequence[int]) -> int:
        if not set(members) <= set(range(self.n_processes)):
            raise ValueError(f"members {list(members)}")
        new = max(self.groups) + 1
        self.groups[new] = Group(tuple(members), new)
        return new

    def duplicate_group(self, group: int) -> int:
        return self.create_group(self.groups[group].members)

    def destroy_group(self, group: int) -> None:
        del self.groups[group]

    def self_group(self, process: int = 0) -> int:
        return self.create_group([process])

    def split_group(self, group: int, n: int) -> list[int]:
        """n groups of consecutive members, as equal as a common size allows."""
        members = self.groups[group].members
        each = -(-len(members) // n)
        return [self.create_group(members[s : s + each]) for s in range(0, len(members), each)]

    def split_group_by(self, group: int, colors: Sequence[int]) -> dict[int, int]:
        members = self.groups[group].members
        return {c: self.create_group([m for m, x in zip(members, colors, strict=True) if x == c]) for c in sorted(set(colors))}

    def mirror_group(self, process: int = 0) -> int:
        node = process // self.per_node
        return self.create_group([p for p in range(self.n_processes) if p // self.per_node == node])

    def world_group(self) -> int:
        return 0

    def set_default_group(self, group: int) -> None:
        self.default_group = self.groups[group].id

    def group_size(self, group: int = 0) -> int:
        return len(self.groups[group].members)

    def absolute_id(self, group: int, rank: int) -> int:
        return self.groups[group].members[rank]

    def rank_in(self, group: int, process: int) -> int:
        return self.groups[group].members.index(process)

    def cluster(self) -> dict[int, list[int]]:
        """Processes by node."""
        out: dict[int, list[int]] = {}
        for p in range(self.n_processes):
            out.setdefault(p // self.per_node, []).append(p)
        return out

    # control: plans are lazy and data are immutable, so there is nothing to wait for
    def sync(self, *_) -> None: ...

    fence = init_fence = mask_sync = group_sync = ghost_barrier = release = wait = alloc_gather_buffer = free_gather_buffer = sync

    def test(self, *_) -> bool:
        return True

    def create_mutexes(self, n: int) -> None:
        self.mutexes = [threading.Lock() for _ in range(n)]

    def destroy_mutexes(self) -> None:
        self.mutexes = []

    def lock(self, k: int) -> None:
        self.mutexes[k].acquire()

    def unlock(self, k: int) -> None:
        self.mutexes[k].release()

    # environment
    @property
    def memory_limited(self) -> bool:
        return self.memory_limit is not None

    def memory_used(self) -> int:
        wide = {"int": 4, "float": 4, "cdouble": 16}
        return sum(a.size * wide.get(a.dtype.name, 8) for a in self.arrays.values())

    def memory_available(self) -> int | None:
        return None if self.memory_limit is None else self.memory_limit - self.memory_used()

    def wall_time(self) -> float:
        return time.perf_counter()

    def rand(self, seed: int | None = None) -> float:
        if seed:
            self._random.seed(seed)
        return self._random.random()

    def version(self) -> tuple[int, int, int]:
        return VERSION

    def error(self, text: str, code: int = 1) -> None:
        raise RuntimeError(f"{text}: {code}")

    def terminate(self) -> None:
        for a in list(self.arrays.values()):
            self.destroy(a)

    def traced(self, a: Array, lo: Sequence[int], hi: Sequence[int], operation: str, began: float, ended: float) -> None:
        """Note an operation on a box, with the seconds at which it began and ended."""
        self.events.append((len(self.events), a.name, operation, list(map(int, lo)), list(map(int, hi)), float(began), float(ended)))

    def trace(self) -> DataFrame:
        """What was noted, in order."""
        return self.spark.createDataFrame(self.events, "event long, array string, operation string, lo array<long>, hi array<long>, began double, ended double")

    def summary(self) -> DataFrame:
        rows = [(a.name, a.dtype.name, list(a.dims), a.layout.kind) for a in self.arrays.values()]
        return self.spark.createDataFrame(rows, "name string, dtype string, dims array<long>, layout string")

    def checkpointed(self, a: Array) -> Array:
        """The same cells, without lineage, in the folder that spark.checkpoint.dir names."""
        return replace(a, df=a.df.checkpoint())

    def save(self, path: str, *arrays: Array) -> None:
        """Named arrays in a folder that outlives the session; each is a new version, recorded once all its cells are there."""
        for a in arrays:
            if not a.name:
                raise ValueError("only named arrays can be recovered")
            versions.commit(self.spark, f"{path.rstrip('/')}/{a.name}", a.df, {"dtype": a.dtype.name, "dims": list(a.dims), "ghosts": list(a.ghosts)})

    def recover(self, path: str, name: str) -> Array:
        """The last recorded version of an array, in this or another session."""
        df, said = versions.latest(self.spark, f"{path.rstrip('/')}/{name}")
        dims, d = tuple(said["dims"]), as_dtype(said["dtype"])
        return self.register(replace(self.from_df(df, dims, d, name=name), ghosts=tuple(said["ghosts"])))
