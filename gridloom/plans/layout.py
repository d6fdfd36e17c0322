"""Block layouts: how an array's index space is cut into blocks and dealt to processes. They never change results."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import product
from math import prod

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.index import Box, intersect


def process_grid(dims: Sequence[int], n: int, chunk: Sequence[int] | None = None) -> list[int]:
    """Factors of n per dimension such that blocks are as even as possible and no smaller than chunk."""
    grid = [1] * len(dims)
    factors, rest, p = [], n, 2
    while rest > 1:
        while rest % p == 0:
            factors.append(p)
            rest //= p
        p += 1
    for f in sorted(factors, reverse=True):
        least = [max(1, c or 1) for c in chunk] if chunk else [1] * len(dims)
        able = [d for d in range(len(dims)) if dims[d] // (grid[d] * f) >= least[d]]
        if able:
            d = max(able, key=lambda k: dims[k] / grid[k])
            grid[d] *= f
    return grid


@dataclass(frozen=True)
class Layout:
    kind: str  # regular, block_cyclic, scalapack, tiled, tiled_irreg
    starts: tuple[tuple[int, ...], ...]  # first index of each block, by dimension
    dims: tuple[int, ...]
    n_processes: int
    grid: tuple[int, ...]

    @staticmethod
    def regular(dims: Sequence[int], n: int, chunk: Sequence[int] | None = None) -> Layout:
        grid = process_grid(dims, n, chunk)
        starts = tuple(tuple(sorted({k * d // g for k in range(g)})) for d, g in zip(dims, grid, strict=True))
        return Layout("regular", starts, tuple(dims), n, tuple(len(s) for s in starts))

    @staticmethod
    def irregular(dims: Sequence[int], starts: Sequence[Sequence[int]], n: int) -> Layout:
        for own, d in zip(starts, dims, strict=True):
            if list(own) != sorted(set(own)) or own[0] != 0 or own[-1] >= d:
                raise ValueError(f"block starts {own} don't cut 0..{d - 1}")
        return Layout("regular", tuple(tuple(s) for s in starts), tuple(dims), n, tuple(len(s) for s in starts))

    @staticmethod
    def blocks_of_size(kind: str, dims: Sequence[int], size: Sequence[int], n: int, grid: Sequence[int] | None = None) -> Layout:
        starts = tuple(tuple(range(0, d, s)) for d, s in zip(dims, size, strict=True))
        grid = tuple(grid) if grid else (n,)
        if prod(grid) > n:
            raise ValueError(f"grid {grid} needs more than {n} processes")
        return Layout(kind, starts, tuple(dims), n, grid)

    @property
    def n_blocks(self) -> list[int]:
        return [len(s) for s in self.starts]

    @property
    def total_blocks(self) -> int:
        return -1 if self.kind == "regular" else prod(self.n_blocks)

    def owner(self, block: Sequence[int]) -> int:
        flat = 0
        if self.kind in ("regular", "block_cyclic"):
            for b, n in zip(block, self.n_blocks, strict=True):
                flat = flat * n + b
            return flat if self.kind == "regular" else flat % self.n_processes
        for b, g in zip(block, self.grid, strict=True):
            flat = flat * g + b % g
        return flat

    def box(self, block: Sequence[int]) -> Box:
        lo = [s[b] for s, b in zip(self.starts, block, strict=True)]
        hi = [(s[b + 1] if b + 1 < len(s) else d) - 1 for s, b, d in zip(self.starts, block, self.dims, strict=True)]
        return lo, hi

    def blocks(self) -> Iterator[tuple[tuple[int, ...], Box, int]]:
        for block in product(*(range(len(s)) for s in self.starts)):
            yield block, self.box(block), self.owner(block)

    def locate(self, at: Sequence[int]) -> int:
        if any(not 0 <= x < d for x, d in zip(at, self.dims, strict=True)):
            raise ValueError(f"subscript {list(at)} is outside {list(self.dims)}")
        return self.owner([bisect_right(s, x) - 1 for s, x in zip(self.starts, at, strict=True)])

    def region(self, box: Box) -> list[tuple[Box, int]]:
        """The parts of a box by block, with their owners."""
        return [(part, owner) for _, own, owner in self.blocks() if (part := intersect(own, box))]

    def process_box(self, process: int) -> Box | None:
        return next((box for _, box, owner in self.blocks() if owner == process), None)

    def coordinates(self, process: int) -> list[int]:
        out = []
        for g in reversed(self.grid):
            out.append(process % g)
            process //= g
        return out[::-1]

    def rule(self, d: int) -> str:
        """How a block is found along a dimension: even cuts, blocks of one size, or a search in the starts."""
        starts, n = self.starts[d], self.dims[d]
        g = len(starts)
        if all(s == k * n // g for k, s in enumerate(starts)):
            return "even"
        size = starts[1]
        return "size" if all(s == k * size for k, s in enumerate(starts)) and n - starts[-1] <= size else "search"

    def block_column(self, d: int, x: Column) -> Column:
        """The number of the block that holds x, along a dimension; the plan's size doesn't depend on the number of blocks,
        but for one array of starts where they follow no rule."""
        starts, rule = self.starts[d], self.rule(d)
        if len(starts) == 1:
            return F.lit(0).cast("long")
        if rule == "even":
            return F.floor(((x + 1) * len(starts) - 1) / F.lit(self.dims[d])).cast("long") if self.dims[d] * len(starts) < 1 << 52 else F.call_function("div", (x + 1) * len(starts) - 1, F.lit(self.dims[d]))
        if rule == "size":
            return F.floor(x / starts[1]).cast("long")
        steps = F.array(*(F.lit(1 << k) for k in range(len(starts).bit_length() - 1, -1, -1)))
        known = F.array(*map(F.lit, starts))
        step = lambda at, k: F.when((at + k < len(starts)) & (F.try_element_at(known, (at + k + 1).cast("int")) <= x), at + k).otherwise(at)
        return F.aggregate(steps, F.lit(0), step).cast("long")

    def start_column(self, d: int, block: Column) -> Column:
        """The first index of a block; of the number after the last one, the size."""
        starts, rule = self.starts[d], self.rule(d)
        if rule == "even":
            return F.floor(block * self.dims[d] / F.lit(len(starts))).cast("long")
        if rule == "size":
            return F.least(block * starts[1], F.lit(self.dims[d])).cast("long")
        return F.element_at(F.array(*map(F.lit, (*starts, self.dims[d]))), (block + 1).cast("int")).cast("long")

    def least_size(self, d: int) -> int:
        ends = (*self.starts[d][1:], self.dims[d])
        return min(e - s for s, e in zip(self.starts[d], ends, strict=True))

    def block_columns(self) -> list[Column]:
        """The block's number along each dimension, from the index columns."""
        return [self.block_column(d, F.col(f"i{d}")) for d in range(len(self.dims))]

    def owner_column(self) -> Column:
        block, out = self.block_columns(), F.lit(0).cast("long")
        if self.kind in ("regular", "block_cyclic"):
            for b, n in zip(block, self.n_blocks, strict=True):
                out = out * n + b
            return out if self.kind == "regular" else F.pmod(out, F.lit(self.n_processes))
        for b, g in zip(block, self.grid, strict=True):
            out = out * g + F.pmod(b, F.lit(g))
        return out
