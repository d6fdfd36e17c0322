"""Sparse matrices as rows (i, j, v): joins and grouped sums. Repeated (i, j) add up in every linear operation."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from math import prod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import numbers as N
from gridloom.functions.dtypes import DType, as_dtype
from gridloom.functions.index import full, linear, subscripts
from gridloom.plans.engine import Array, Engine
from gridloom.sources import storage


@dataclass(frozen=True)
class Sparse:
    df: DataFrame
    dims: tuple[int, int]
    dtype: DType
    engine: Engine
    n_blocks: int

    def with_df(self, df: DataFrame, **changes) -> Sparse:
        return replace(self, df=df.select("i", "j", "v"), **changes)

    def transposed(self) -> Sparse:
        return self.with_df(self.df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), dims=self.dims[::-1])


def create(engine: Engine, idim: int, jdim: int, dtype: str | DType, n_blocks: int | None = None) -> Sparse:
    """An empty matrix."""
    if min(idim, jdim) < 1:
        raise ValueError(f"dimensions {idim} x {jdim}")
    d = as_dtype(dtype)
    df = engine.spark.createDataFrame([], f"i long, j long, v {d.spark.simpleString()}")
    return Sparse(df, (idim, jdim), d, engine, n_blocks or engine.n_processes)


def from_frame(engine: Engine, df: DataFrame, idim: int, jdim: int, dtype: str | DType) -> Sparse:
    empty = create(engine, idim, jdim, dtype)
    v = F.col("v") if empty.dtype.kind == "complex" else F.col("v").cast(empty.dtype.spark)
    return empty.with_df(df.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), v.alias("v")))


def add_elements(s: Sparse, elements: DataFrame | Iterable[tuple]) -> Sparse:
    """Elements are appended; repeated ones stay apart."""
    if not isinstance(elements, DataFrame):
        rows = [(i, j, {"re": complex(v).real, "im": complex(v).imag} if s.dtype.kind == "complex" else v) for i, j, v in elements]
        for i, j, _ in rows:
            if not (0 <= i < s.dims[0] and 0 <= j < s.dims[1]):
                raise ValueError(f"element {i}, {j} is outside {s.dims}")
        elements = s.engine.spark.createDataFrame(rows, s.df.schema)
    return s.with_df(s.df.unionByName(elements.select("i", "j", F.col("v").cast(s.dtype.spark).alias("v"))))


def block_of(x: Column, size: int, n: int) -> Column:
    """The block's number of an index: block b starts at the least index x with x * n // size == b."""
    return F.floor(x * n / size).cast("long")


def assemble(s: Sparse) -> Sparse:
    """Rows dealt by row, so that later operations by row find them together; the session says into how many partitions."""
    return s.with_df(s.df.repartition("i"))


def row_distribution(s: Sparse, process: int) -> tuple[int, int]:
    """First and last row of a process; (0, -1) if it has none."""
    return _range(s.dims[0], s.n_blocks, process)


def column_distribution(s: Sparse, block: int) -> tuple[int, int]:
    return _range(s.dims[1], s.n_blocks, block)


def _range(size: int, n: int, b: int) -> tuple[int, int]:
    lo, hi = -(-b * size // n), -(-(b + 1) * size // n) - 1
    return (lo, hi) if lo <= hi else (0, -1)


def column_blocks(s: Sparse, process: int) -> DataFrame:
    """The column blocks that aren't empty in a process' rows."""
    own = s.df.where(block_of(F.col("i"), s.dims[0], s.n_blocks) == process)
    return own.select(block_of(F.col("j"), s.dims[1], s.n_blocks).alias("block")).distinct()


def get_block(s: Sparse, row_block: int, column_block: int) -> DataFrame:
    return s.df.where((block_of(F.col("i"), s.dims[0], s.n_blocks) == row_block) & (block_of(F.col("j"), s.dims[1], s.n_blocks) == column_block))


#: Columns whose elements of a row share one array at most.
SEGMENT_COLUMNS = 1 << 16


def compressed_rows(s: Sparse, row_block: int, column_block: int) -> DataFrame:
    """A block by row: i, columns in order, and their values; a row over more than SEGMENT_COLUMNS columns comes in segments."""
    pairs = F.array_sort(F.collect_list(F.struct("j", "v")))
    return get_block(s, row_block, column_block).groupBy("i", F.floor(F.col("j") / SEGMENT_COLUMNS).alias("_s")).agg(pairs.alias("x")).select("i", F.col("x.j").alias("columns"), F.col("x.v").alias("values"))


def from_dense(a: Array) -> Sparse:
    """Elements that aren't 0, and the whole diagonal."""
    if a.ndim != 2:
        raise ValueError("a matrix is needed")
    kept = a.df.where(N.nonzero(F.col("v"), a.dtype) | (F.col("i0") == F.col("i1")))
    return Sparse(kept.select(F.col("i0").alias("i"), F.col("i1").alias("j"), "v"), a.dims, a.dtype, a.engine, a.engine.n_processes)


def summed(df: DataFrame, keys: list[str], d: DType) -> DataFrame:
    return df.groupBy(*keys).agg(N.wide_sum(F.col("v"), d).alias("v")).withColumn("v", N.narrowed(F.col("v"), d))


#: Bits of the number of cells in a run, which one row starts, and of those in a task of a large array.
RUN_BITS, TASK_BITS, MOST_TASKS = 14, 25, 8192


def densified(df: DataFrame, engine: Engine, dims: tuple[int, ...], d: DType, keys: list[str]) -> Array:
    """Zeros where df has no row. Elements and the starts of runs are shuffled; each is then followed by the zeros up to the next one, made where they are used."""
    inside = [F.col(k).between(F.lit(lo), F.lit(hi)) for k, lo, hi in zip(keys, *full(dims), strict=True)]
    zero, size = N.constant(0, d), prod(dims)
    for within in inside:
        df = df.where(within)
    found = summed(df, keys, d).select(linear(dims, [F.col(k) for k in keys]).alias("_at"), F.lit(True).alias("_own"), F.coalesce("v", zero).alias("v"))
    starts = engine.spark.range(0, size, 1 << RUN_BITS).select(F.col("id").alias("_at"), F.lit(False).alias("_own"), zero.alias("v"))
    marks = found.unionByName(starts).withColumn("_run", F.shiftright("_at", RUN_BITS))
    if size >> TASK_BITS > 1:
        marks = marks.repartition(min(size >> TASK_BITS, MOST_TASKS), "_run")
    end = F.least(F.shiftleft(F.col("_run") + 1, RUN_BITS), F.lit(size).cast("long"))
    following = F.coalesce(F.lead("_at").over(Window.partitionBy("_run").orderBy("_at", "_own")), end)
    spans = marks.withColumn("_next", following).where(F.col("_next") > F.col("_at"))
    cells = spans.select("_at", "v", F.explode(F.sequence("_at", F.col("_next") - 1)).alias("_lin"))
    every = cells.select(*(c.alias(f"i{n}") for n, c in enumerate(subscripts(F.col("_lin"), dims))), F.when(F.col("_lin") == F.col("_at"), F.col("v")).otherwise(zero).alias("v"))
    return engine.from_df(every, dims, d)


def to_dense(s: Sparse) -> Array:
    return densified(s.df, s.engine, s.dims, s.dtype, ["i", "j"])


def duplicate(s: Sparse) -> Sparse:
    return replace(s)


def destroy(s: Sparse) -> None:
    s.df.unpersist()


def get_column(s: Sparse, j: int) -> Array:
    if not 0 <= j < s.dims[1]:
        raise ValueError(f"column {j}")
    return densified(s.df.where(F.col("j") == j), s.engine, (s.dims[0],), s.dtype, ["i"])


def get_diag(s: Sparse) -> Array:
    return densified(s.df.where(F.col("i") == F.col("j")), s.engine, (min(s.dims),), s.dtype, ["i"])


def check_vector(s: Sparse, x: Array, n: int) -> None:
    if x.ndim != 1 or x.dims[0] != n or x.dtype != s.dtype:
        raise ValueError(f"a vector of {n} elements of the matrix' type is needed")


def diag_left_multiply(s: Sparse, d: Array) -> Sparse:
    """v[i, j] *= d[i]."""
    check_vector(s, d, s.dims[0])
    w = d.df.select(F.col("i0").alias("i"), F.col("v").alias("_w"))
    return s.with_df(s.df.join(w, "i").withColumn("v", N.mul(F.col("v"), F.col("_w"), s.dtype)))


def diag_right_multiply(s: Sparse, d: Array) -> Sparse:
    """v[i, j] *= d[j]."""
    check_vector(s, d, s.dims[1])
    w = d.df.select(F.col("i0").alias("j"), F.col("v").alias("_w"))
    return s.with_df(s.df.join(w, "j").withColumn("v", N.mul(F.col("v"), F.col("_w"), s.dtype)))


def shift_diag(s: Sparse, c) -> Sparse:
    """Stored diagonal elements grow by c."""
    return s.with_df(s.df.withColumn("v", F.when(F.col("i") == F.col("j"), N.add(F.col("v"), N.constant(c, s.dtype), s.dtype)).otherwise(F.col("v"))))


def scale(s: Sparse, c) -> Sparse:
    return s.with_df(s.df.withColumn("v", N.mul(F.col("v"), N.constant(c, s.dtype), s.dtype)))


def wide_mul(a: Column, b: Column, d: DType) -> Column:
    from gridloom.functions.dtypes import CDOUBLE, DOUBLE, LONG

    wide = {"complex": CDOUBLE, "real": DOUBLE, "int": LONG}[d.kind]
    if d.kind == "complex":
        return N.mul(a, b, wide)
    return a.cast(wide.spark) * b.cast(wide.spark)


#: Bits of a block's edge in products: elements of an inner index travel once for each block of the other side that it meets.
BLOCK_BITS = 11


def packed(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """_k, _block, _x, _v: an inner index' elements in a block of outer indices, as arrays of values and of places counted from the block's start."""
    block = F.shiftright(outer, BLOCK_BITS)
    rows = df.where(F.col(inner).isNotNull()).select(F.col(inner).alias("_k"), block.alias("_block"), (F.col(outer) - F.shiftleft(block, BLOCK_BITS)).cast("int").alias("_x"), F.col("v").alias("_v"))
    packs = rows.repartition("_k").groupBy("_k", "_block").agg(F.collect_list(F.struct("_x", "_v")).alias("_p"))
    return packs.select("_k", "_block", F.col("_p._x").alias("_x"), F.col("_p._v").alias("_v"))


def multiplied(a: DataFrame, b: DataFrame, d: DType) -> DataFrame:
    """(i, j, v) of the product of two (i, j, v) frames; sums that cancel stay as zeros.

    Packs of both sides meet by inner index and are put in order of the product's blocks, in ranges of equal numbers: a
    range spans few blocks, so that its products add up before they are shuffled, and a hot block spans many ranges.
    """
    left, right = (packed(df, outer, inner).select("_k", *(F.col(f"_{c}").alias(f"_{c}{side}") for c in ("block", "x", "v"))) for df, outer, inner, side in ((a, "i", "j", 0), (b, "j", "i", 1)))
    rows = left.join(right, "_k").repartitionByRange("_block0", "_block1", "_k")
    rows = rows.select("_block0", "_block1", "_v0", "_x1", "_v1", F.posexplode("_x0").alias("_p", "_i")).withColumn("_a", F.get("_v0", "_p"))
    rows = rows.select("_block0", "_block1", "_i", "_a", "_v1", F.posexplode("_x1").alias("_p", "_j")).withColumn("_b", F.get("_v1", "_p"))
    i, j = F.shiftleft("_block0", BLOCK_BITS) + F.col("_i"), F.shiftleft("_block1", BLOCK_BITS) + F.col("_j")
    return summed(rows.select(i.alias("i"), j.alias("j"), wide_mul(F.col("_a"), F.col("_b"), d).alias("v")), ["i", "j"], d)


def matvec_multiply(s: Sparse, x: Array) -> Array:
    """y = A x; rows without elements give 0."""
    check_vector(s, x, s.dims[1])
    w = x.df.select(F.col("i0").alias("j"), F.col("v").alias("_w"))
    pairs = s.df.join(w, "j").select("i", wide_mul(F.col("v"), F.col("_w"), s.dtype).alias("v"))
    return densified(pairs, s.engine, (s.dims[0],), s.dtype, ["i"])


def check_product(a: tuple[int, ...], b: tuple[int, ...], x: DType, y: DType) -> None:
    if a[1] != b[0] or x != y:
        raise ValueError(f"product of {a} {x.name} and {b} {y.name}")


def matmat_multiply(a: Sparse, b: Sparse) -> Sparse:
    check_product(a.dims, b.dims, a.dtype, b.dtype)
    return a.with_df(multiplied(a.df, b.df, a.dtype), dims=(a.dims[0], b.dims[1]))


def plain(a: Array, trans: bool) -> tuple[DataFrame, tuple[int, int]]:
    i, j = ("i1", "i0") if trans else ("i0", "i1")
    return a.df.select(F.col(i).alias("i"), F.col(j).alias("j"), "v"), a.dims[::-1] if trans else a.dims


def sparse_dense_multiply(a: Sparse, b: Array, trans: bool = False) -> Array:
    """A B (or A B^T) as a dense array."""
    right, dims = plain(b, trans)
    check_product(a.dims, dims, a.dtype, b.dtype)
    return densified(multiplied(a.df, right, a.dtype), a.engine, (a.dims[0], dims[1]), a.dtype, ["i", "j"])


def dense_sparse_multiply(a: Array, b: Sparse, trans: bool = False) -> Array:
    """A B (or A^T B) as a dense array."""
    left, dims = plain(a, trans)
    check_product(dims, b.dims, a.dtype, b.dtype)
    return densified(multiplied(left, b.df, b.dtype), b.engine, (dims[0], b.dims[1]), b.dtype, ["i", "j"])


def num_nonzeros(s: Sparse) -> int:
    return s.df.where(N.nonzero(F.col("v"), s.dtype)).count()


def count_sketch(s: Sparse, k: int, seed: int = 1, trans: bool = False) -> tuple[Array, DataFrame]:
    """A k x jdim sketch: every row is added to one of k rows with a sign, both by hash; and the rows' (i, label, sign)."""
    if k < 1:
        raise ValueError("a sketch has a row at least")
    if s.dtype.kind == "complex":
        raise ValueError("sketches take real types")
    s = s.transposed() if trans else s
    label, sign = sketch_hash(F.col("i"), k, seed)
    rows = s.df.select(label.alias("i"), "j", (F.col("v") * sign).alias("v"))
    rules = s.engine.spark.range(s.dims[0]).select(F.col("id").alias("i"))
    return densified(rows, s.engine, (k, s.dims[1]), s.dtype, ["i", "j"]), rules.select("i", label.alias("label"), sign.alias("sign"))


def sketch_hash(i: Column, k: int, seed: int) -> tuple[Column, Column]:
    said = F.concat_ws(":", F.lit(str(seed)), i.cast("string"))
    return F.pmod(N.hashed_bits(said), F.lit(k)), F.when(N.hashed_bits(said, 14, 8) % 2 == 0, 1).otherwise(-1)


def export_lines(s: Sparse) -> DataFrame:
    """Lines of a MatrixMarket coordinate file, with `n`, their place: the header and then elements by row and column."""
    d = s.dtype
    number = lambda c: F.format_string("%14.6e", c.cast("double"))
    value = F.concat_ws(" ", number(F.col("v")["re"]), number(F.col("v")["im"])) if d.kind == "complex" else F.col("v").cast("string") if d.kind == "int" else number(F.col("v"))
    body = s.df.select(F.col("i").alias("_i"), F.col("j").alias("_j"), F.concat_ws(" ", (F.col("i") + 1).cast("string"), (F.col("j") + 1).cast("string"), value).alias("value"))
    first = s.df.agg(F.count(F.lit(1)).alias("c")).select(F.lit(-1).cast("long").alias("_i"), F.lit(0).cast("long").alias("_j"), F.concat(F.lit(f"%%MatrixMarket matrix coordinate {'complex' if d.kind == 'complex' else 'real'} general\n{s.dims[0]} {s.dims[1]} "), F.col("c").cast("string")).alias("value"))
    return first.unionByName(body)


def export(s: Sparse, path: str, one_file: bool = True) -> None:
    """Write the matrix as text, sorted in ranges, a part each; one_file: the parts are joined by copying streams, as other tools want it."""
    lines = export_lines(s).orderBy("_i", "_j").select("value")
    if not one_file:
        lines.write.mode("overwrite").text(path)
        return
    spark, parts = s.engine.spark, f"{path.rstrip('/')}.parts"
    lines.write.mode("overwrite").text(parts)
    storage.joined(spark, parts, f"{path.rstrip('/')}/part-00000.txt")
    storage.delete(spark, parts)


def load(engine: Engine, path: str, dtype: str | DType = "double") -> Sparse:
    """Read a MatrixMarket coordinate file."""
    d = as_dtype(dtype)
    text = engine.spark.read.text(path).where(~F.col("value").startswith("%"))
    parts = F.split(F.trim("value"), r"\s+")
    need = 4 if d.kind == "complex" else 3
    size = engine.spark.read.text(path).where(F.col("value").rlike(r"^\s*\d+\s+\d+\s+\d+\s*$")).limit(1).first()
    idim, jdim, _ = map(int, size[0].split())
    header = F.col("value") == size[0]
    if d.kind == "int":
        header = F.col("value").rlike(rf"^\s*{idim}\s+{jdim}\s+{size[0].split()[2]}\s*$")
    rows = text.where(~header).select(parts.alias("p")).where(F.size("p") >= need)
    at = [(F.col("p")[k].cast("long") - 1).alias(n) for k, n in ((0, "i"), (1, "j"))]
    v = N.pair(F.col("p")[2].cast("double"), F.col("p")[3].cast("double"), d) if d.kind == "complex" else F.col("p")[2].cast(d.spark)
    return from_frame(engine, rows.select(*at, v.alias("v")), idim, jdim, d)
