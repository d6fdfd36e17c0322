"""Index arithmetic: boxes are inclusive lo..hi, 0-based; linear order is row-major."""

from __future__ import annotations

from collections.abc import Sequence
from math import prod

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Sequence[int], Sequence[int]]


def names(ndim: int) -> list[str]:
    return [f"i{d}" for d in range(ndim)]


def shape_of(box: Box) -> list[int]:
    return [h - lo + 1 for lo, h in zip(*box, strict=True)]


def check_box(box: Box, dims: Sequence[int]) -> Box:
    lo, hi = list(box[0]), list(box[1])
    if len(lo) != len(dims) or len(hi) != len(dims):
        raise ValueError(f"box of rank {len(lo)} for an array of rank {len(dims)}")
    for low, high, n in zip(lo, hi, dims, strict=True):
        if not 0 <= low <= high < n:
            raise ValueError(f"box {lo}..{hi} is outside dimensions {list(dims)}")
    return lo, hi


def full(dims: Sequence[int]) -> Box:
    return [0] * len(dims), [n - 1 for n in dims]


def inside(box: Box) -> Column:
    out = F.lit(True)
    for d, (lo, hi) in enumerate(zip(*box, strict=True)):
        out = out & F.col(f"i{d}").between(F.lit(lo), F.lit(hi))
    return out


def linear(dims: Sequence[int], at: Sequence[Column] | None = None) -> Column:
    at = at or [F.col(n) for n in names(len(dims))]
    out = F.lit(0).cast("long")
    for x, n in zip(at, dims, strict=True):
        out = out * n + x
    return out


def subscripts(lin: Column, dims: Sequence[int]) -> list[Column]:
    out = []
    for d in range(len(dims)):
        below = prod(dims[d + 1 :])
        out.append(F.pmod(F.floor(lin / F.lit(below)) if below > 1 else lin, F.lit(dims[d])).cast("long"))
    return out


def moved(source: Box, target: Box) -> list[Column]:
    """Subscripts in the target box of an element of the source box: elements pair up by linear index."""
    a, b = shape_of(source), shape_of(target)
    if prod(a) != prod(b):
        raise ValueError(f"boxes of {prod(a)} and {prod(b)} elements")
    at = [F.col(f"i{d}") - lo for d, lo in enumerate(source[0])]
    if a == b:
        return [x + lo for x, lo in zip(at, target[0], strict=True)]
    return [x + lo for x, lo in zip(subscripts(linear(a, at), b), target[0], strict=True)]


def intersect(a: Box, b: Box) -> Box | None:
    lo = [max(x, y) for x, y in zip(a[0], b[0], strict=True)]
    hi = [min(x, y) for x, y in zip(a[1], b[1], strict=True)]
    return (lo, hi) if all(x <= y for x, y in zip(lo, hi, strict=True)) else None


def same_shape(a: Box, b: Box) -> bool:
    """Equal shapes; trailing dimensions of one element don't count."""
    x, y = shape_of(a), shape_of(b)
    while x and x[-1] == 1:
        x.pop()
    while y and y[-1] == 1:
        y.pop()
    return x == y
