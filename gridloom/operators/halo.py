"""Ghost cells and stencils. Halos are never stored: they are computed from the cells, periodically, when they are read."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace
from itertools import product
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import numbers as N
from gridloom.operators.access import periodic_get
from gridloom.plans.engine import Array
from gridloom.plans.layout import Layout


def images(a: Array, d: int, width: int) -> Column:
    """array<struct<block, at, out>>: the blocks along dimension d whose halo or inside a cell lies in, and where.

    A cell is held against its own block and the blocks that a halo can reach from it, one on each side unless blocks are
    narrower than the halo: work and plan don't grow with the number of blocks.
    """
    layout, n, x = a.layout, a.dims[d], F.col(f"i{d}")
    blocks = len(layout.starts[d])
    own = layout.block_column(d, x)
    found = [F.struct(own.alias("block"), x.alias("at"), F.lit(False).alias("out"))]
    reach = -(-width // layout.least_size(d))
    for o in [*range(-reach, 0), *range(1, reach + 1)]:
        turns = F.floor((own + o) / blocks).cast("long")
        block, at = own + o - turns * blocks, x - turns * n
        inside = at.between(layout.start_column(d, block) - width, layout.start_column(d, block + 1) - 1 + width)
        found.append(F.when(inside, F.struct(block.alias("block"), at.alias("at"), F.lit(True).alias("out"))))
    return F.array_compact(F.array(*found))


def update_ghosts(a: Array) -> DataFrame:
    """Cells of every block with its halo: b0.., subscripts (outside the array where they wrapped) and v; no join.

    Without corners, cells that are outside a block in more than one dimension are left out.
    """
    if not a.has_ghosts:
        raise ValueError("the array has no ghost cells")
    if any(w > n for w, n in zip(a.ghosts, a.dims, strict=True)):
        raise ValueError("a halo is wider than the array")
    df, outs = a.df, F.lit(0)
    for d, w in enumerate(a.ghosts):
        df = df.withColumn(f"_g{d}", F.explode(images(a, d, w)))
        outs = outs + F.col(f"_g{d}.out").cast("int")
    if not a.corners:
        df = df.where(outs <= 1)
    blocks = [F.col(f"_g{d}.block").alias(f"b{d}") for d in range(a.ndim)]
    return df.select(*blocks, *(F.col(f"_g{d}.at").alias(f"i{d}") for d in range(a.ndim)), "v")


update1_ghosts = update2_ghosts = update3_ghosts = update4_ghosts = update44_ghosts = update5_ghosts = update55_ghosts = update6_ghosts = update7_ghosts = update_ghosts_nb = update_ghosts


def update_ghost_dir(a: Array, dimension: int, direction: int) -> DataFrame:
    """Only the halo on one side (-1 or 1) of one dimension."""
    if not 0 <= dimension < a.ndim or direction not in (-1, 1):
        raise ValueError(f"dimension {dimension}, direction {direction}")
    low, high = bounds(a, dimension)
    at = F.col(f"i{dimension}")
    return update_ghosts(a).where(at < low if direction < 0 else at > high)


def bounds(a: Array, d: int) -> tuple[Column, Column]:
    """First and last index of the block b<d>."""
    return a.layout.start_column(d, F.col(f"b{d}")), a.layout.start_column(d, F.col(f"b{d}") + 1) - 1


def nb_get_ghost_dir(a: Array, mask: Sequence[int]) -> DataFrame:
    """The halo whose direction has the mask's sign in every dimension."""
    cells = update_ghosts(a)
    for d, m in enumerate(mask):
        low, high = bounds(a, d)
        at = F.col(f"i{d}")
        cells = cells.where(at < low if m < 0 else at > high if m > 0 else at.between(low, high))
    return cells


def get_ghost_block(a: Array, lo: Sequence[int], hi: Sequence[int]) -> DataFrame:
    """A box that may reach into the halo, always read afresh."""
    return periodic_get(a, lo, hi)


def ghost_block(a: Array, block: Sequence[int]) -> DataFrame:
    """One block with its halo, subscripts from 0 at the halo's corner."""
    cells = update_ghosts(a)
    for d, b in enumerate(block):
        cells = cells.where(F.col(f"b{d}") == b)
    return cells.select(*((F.col(f"i{d}") - (a.layout.starts[d][b] - w)).alias(f"i{d}") for d, (b, w) in enumerate(zip(block, a.ghosts, strict=True))), "v")


def ghost_element(a: Array, block: Sequence[int], subscript: Sequence[int]):
    here = F.lit(True)
    for d, x in enumerate(subscript):
        here = here & (F.col(f"i{d}") == x)
    row = ghost_block(a, block).where(here).select("v").first()
    return None if row is None else row[0]


#: Cells of a stencil's tile at most.
TILE_CELLS = 1 << 16


def tile_edges(dims: Sequence[int], reach: Sequence[int]) -> list[int]:
    """Edges of tiles of at most TILE_CELLS cells, the longest sides halved first, no edge shorter than the reach."""
    edge = list(dims)
    while prod(edge) > TILE_CELLS:
        able = [d for d in range(len(edge)) if edge[d] > max(1, reach[d])]
        if not able:
            break
        d = max(able, key=lambda k: edge[k])
        edge[d] = max(reach[d], 1, -(-edge[d] // 2))
    return edge


def stencil(a: Array, weights: Mapping[Sequence[int], float], periodic: bool = True) -> Array:
    """v'[i] = sum of weights[offset] * v[i + offset].

    Tiles with their halos are built by one shuffle of the cells, each of which goes to its own tile and to those whose
    halo it lies in, and slices of a tile are added up in numpy. Not periodic: neighbours outside the array count as 0.
    """
    if not weights or any(len(o) != a.ndim for o in weights):
        raise ValueError("an offset for each dimension is needed")
    if a.dtype.kind == "complex":
        raise ValueError("stencils take real types")
    reach = [max(abs(o[d]) for o in weights) for d in range(a.ndim)]
    if any(r > n for r, n in zip(reach, a.dims, strict=True)):
        raise ValueError("an offset reaches beyond the array")
    edge = tile_edges(a.dims, reach)
    tiled = replace(a, layout=Layout.blocks_of_size("tiled", a.dims, edge, 1, [1] * a.ndim), ghosts=tuple(reach), corners=True)
    cells = tiled.df.select(*a.index, F.col("v").cast("double").alias("v"))
    for d, r in enumerate(reach):
        cells = cells.withColumn(f"_g{d}", F.explode(images(tiled, d, r)))
        if not periodic:
            cells = cells.where(F.col(f"_g{d}.at") == F.col(f"i{d}"))
    keys = [f"b{d}" for d in range(a.ndim)]
    cells = cells.select(*(F.col(f"_g{d}.block").alias(f"b{d}") for d in range(a.ndim)), *(F.col(f"_g{d}.at").alias(n) for d, n in enumerate(a.index)), "v")
    index, dims = a.index, a.dims
    rules = [(tuple(o), float(w)) for o, w in weights.items()]

    def slid(key, t):
        import numpy as np
        import pyarrow as pa

        corner = [k.as_py() * e for k, e in zip(key, edge, strict=True)]
        inner = [min(e, n - c) for e, n, c in zip(edge, dims, corner, strict=True)]
        own = np.zeros([n + 2 * r for n, r in zip(inner, reach, strict=True)])
        at = [t.column(n).to_numpy() - c + r for n, c, r in zip(index, corner, reach, strict=True)]
        own[tuple(at)] = t.column("v").to_numpy()
        out = np.zeros(inner)
        for o, w in rules:
            out += w * own[tuple(slice(r + x, r + x + n) for r, x, n in zip(reach, o, inner, strict=True))]
        places = np.indices(inner).reshape(len(inner), -1)
        return pa.table({n: places[d] + corner[d] for d, n in enumerate(index)} | {"v": out.ravel()})

    total = cells.groupBy(*keys).applyInArrow(slid, ", ".join([*(f"{n} long" for n in index), "v double"]))
    return a.with_df(total.withColumn("v", N.narrowed(F.col("v"), a.dtype)))


def cross(ndim: int, center: float, side: float) -> dict[tuple[int, ...], float]:
    """Weights of the 2n + 1 point stencil."""
    out = {tuple([0] * ndim): center}
    for d, s in product(range(ndim), (-1, 1)):
        out[tuple(s if k == d else 0 for k in range(ndim))] = side
    return out
