"""Array operators against numpy: element types, ranks, boxes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions.dtypes import DTYPES
from gridloom.operators import access, blobs, dense, halo, iterative, reduce, scans, sparse
from gridloom.operators import elementwise as ew
from gridloom.plans.engine import Engine
from gridloom.plans.layout import Layout
from gridloom.plans.prefix import numbered, segmented_sums

REAL = ["int", "long", "longlong", "float", "double"]
COMPLEX = ["cfloat", "cdouble"]
NP = {"int": np.int32, "long": np.int64, "longlong": np.int64, "float": np.float32, "double": np.float64, "cfloat": np.complex64, "cdouble": np.complex128}


def sample(shape, dtype, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.integers(-9, 10, shape).astype(NP[dtype])
    if dtype in COMPLEX:
        x = x + 1j * rng.integers(-9, 10, shape)
    return x.astype(NP[dtype])


@pytest.mark.parametrize("dtype", [*REAL, *COMPLEX])
@pytest.mark.parametrize("shape", [(7,), (4, 5), (2, 3, 4), (2, 2, 2, 3)])
def test_round_trip(engine, dtype, shape):
    x = sample(shape, dtype)
    a = engine.from_numpy(x, dtype, "x")
    assert np.allclose(a.collect(), x)
    assert a.schema == (dtype, len(shape), shape)


@pytest.mark.parametrize("dtype", [*REAL, *COMPLEX])
def test_unary(engine, dtype):
    x = sample((4, 5), dtype)
    a = engine.from_numpy(x, dtype)
    box = ([1, 1], [2, 3])
    inside = np.zeros((4, 5), bool)
    inside[1:3, 1:4] = True
    assert np.allclose(ew.fill(a, 3, box).collect(), np.where(inside, 3, x))
    assert np.allclose(ew.zero(a).collect(), 0)
    assert np.allclose(ew.scale(a, 2, box).collect(), np.where(inside, 2 * x, x))
    assert np.allclose(ew.add_constant(a, 2).collect(), x + 2)
    assert np.allclose(ew.abs_value(a).collect(), abs(x))
    y = np.where(x == 0, 1, x)
    want = np.trunc(1 / y) if dtype in REAL[:3] else 1 / y
    assert np.allclose(ew.recip(engine.from_numpy(y, dtype)).collect(), want, rtol=1e-5)


def test_recip_of_zero_is_an_error(engine):
    with pytest.raises(Exception, match="division by zero"):
        ew.recip(engine.from_numpy(np.array([1.0, 0.0]))).collect()


@pytest.mark.parametrize("dtype", [*REAL, *COMPLEX])
def test_binary(engine, dtype):
    x, y, z = (sample((3, 4), dtype, s) for s in range(3))
    y = np.where(y == 0, 1, y).astype(NP[dtype])
    a, b, c = (engine.from_numpy(v, dtype) for v in (x, y, z))
    assert np.allclose(ew.add(2, a, 3, b).collect(), 2 * x + 3 * y)
    assert np.allclose(ew.elem_multiply(a, b).collect(), x * y)
    assert np.allclose(ew.elem_divide(a, b).collect(), np.trunc(x / y) if dtype in REAL[:3] else x / y, rtol=1e-5)
    if dtype in REAL:
        assert np.allclose(ew.elem_maximum(a, b).collect(), np.maximum(x, y))
        assert np.allclose(ew.elem_minimum(a, b).collect(), np.minimum(x, y))
        assert np.allclose(ew.median(a, b, c).collect(), np.median([x, y, z], axis=0))
    else:
        assert np.allclose(abs(ew.elem_maximum(a, b).collect()), np.maximum(abs(x), abs(y)))
        assert np.allclose(abs(ew.median(a, b, c).collect()), np.median([abs(x), abs(y), abs(z)], axis=0))


def test_boxes_of_equal_capacity_pair_up_in_linear_order(engine):
    x, y = sample((6, 6), "double"), sample((4, 9), "double", 1)
    a, b = engine.from_numpy(x), engine.from_numpy(y)
    out = ew.copy_patch(a, ([1, 1], [2, 3]), b, ([1, 2], [3, 3])).collect()
    want = y.copy()
    want[1:4, 2:4] = x[1:3, 1:4].reshape(3, 2)
    assert np.array_equal(out, want)
    with pytest.raises(ValueError):
        ew.copy_patch(a, ([0, 0], [1, 1]), a, ([1, 1], [2, 2]))


def test_arguments_are_checked(engine):
    a, b = engine.from_numpy(np.zeros((3, 3))), engine.from_numpy(np.zeros((3, 3), int))
    for wrong in (
        lambda: ew.fill(a, 1, ([0, 0], [3, 0])),
        lambda: ew.elem_multiply(a, b),
        lambda: access.get(a, [2, 0], [1, 0]),
        lambda: access.acc(engine.from_numpy(np.zeros(3, int), "longlong"), [0], [1], [1, 2]),
        lambda: reduce.norm1(engine.from_numpy(np.zeros((2, 2, 2)))),
        lambda: dense.matmul(b, b),
        lambda: dense.symmetrize(engine.from_numpy(np.zeros((2, 3)))),
        lambda: access.periodic_get(a, [0, 0], [6, 0]),
        lambda: engine.create((0,), "int"),
        lambda: engine.create((2,), "decimal"),
    ):
        with pytest.raises(ValueError):
            wrong()


def test_reductions(engine):
    x, y = sample((5, 4), "double"), sample((5, 4), "double", 1)
    a, b = engine.from_numpy(x), engine.from_numpy(y)
    assert reduce.dot(a, b) == (x * y).sum()
    assert reduce.dot(a, b, (([0, 0], [3, 2]), ([1, 0], [3, 3])), (True, False)) == (x[:4, :3].T * y[1:4, :4]).sum()
    assert reduce.norm1(a) == abs(x).sum() and reduce.norm_infinity(a) == abs(x).max()
    assert reduce.select_elem(a, "min") == (x.min(), list(np.unravel_index(x.argmin(), x.shape)))
    assert reduce.select_elem(a, "max") == (x.max(), list(np.unravel_index(x.argmax(), x.shape)))
    z = sample((6,), "cdouble")
    c = engine.from_numpy(z)
    assert reduce.dot(c, c) == (z * z).sum()
    assert np.isclose(reduce.norm1(c), abs(z).sum())
    assert reduce.num_nonzeros(a) == (x != 0).sum()


def test_norms_of_a_negated_index(engine):
    n = 50
    a = engine.from_numpy(-np.arange(n))
    assert reduce.norm1(a) == n * (n - 1) // 2 and reduce.norm_infinity(a) == n - 1


@pytest.mark.parametrize("dtype", ["int", "long", "float", "double"])
def test_steps(engine, dtype):
    a = engine.from_numpy(np.array([4, 9, 0, 5]), dtype)
    b = engine.from_numpy(np.array([-2, -3, 1, 0]), dtype)
    assert reduce.step_max(a, b) == 2
    inf = DTYPES[dtype].infinity
    assert np.isclose(float(reduce.step_max(a, a)), inf)
    assert np.isclose(float(reduce.step_max(a, ew.abs_value(b))), inf)
    with pytest.raises(Exception, match="negative"):
        reduce.step_max(b, a)


def test_step_bounds(engine):
    x, v = engine.from_numpy(np.array([1.0, 2.0, 0.0])), engine.from_numpy(np.array([1.0, -1.0, 0.0]))
    low, high = engine.from_numpy(np.zeros(3)), engine.from_numpy(np.full(3, 4.0))
    assert reduce.step_bound_info(x, v, low, high) == (0.0, 2.0, 3.0)


def test_global_ops(engine, spark):
    rows = [(p, k, (p + 2) * (k - 1)) for p in range(3) for k in range(4)]
    x = spark.createDataFrame(rows, "process int, k int, v long")
    by_k = {k: np.array([v for _, j, v in rows if j == k]) for k in range(4)}
    wants = {"+": np.sum, "*": np.prod, "max": np.max, "min": np.min, "absmax": lambda a: abs(a).max(), "absmin": lambda a: abs(a).min(), "or": np.bitwise_or.reduce, "band": np.bitwise_and.reduce, "land": lambda a: int((a != 0).all()), "lor": lambda a: int((a != 0).any())}
    for op, want in wants.items():
        assert {r.k: r.v for r in reduce.global_op(x, op).collect()} == {k: want(a) for k, a in by_k.items()}, op
    assert reduce.broadcast_from(x, 1, [0, 1, 2]).where("process = 2 and k = 3").first()["v"] == 6


def test_boxes(engine):
    x = sample((6, 7), "double")
    a = engine.from_numpy(x)
    got = engine.from_df(access.get(a, [1, 2], [3, 5]), (3, 4), "double")
    assert np.array_equal(got.collect(), x[1:4, 2:6])
    want = x.copy()
    want[1:4, 2:6] = 5
    assert np.array_equal(access.put(a, [1, 2], [3, 5], 5.0).collect(), want)
    want = x.copy()
    want[1:4, 2:6] += 2 * np.arange(12).reshape(3, 4)
    assert np.array_equal(access.acc(a, [1, 2], [3, 5], np.arange(12.0).reshape(3, 4), 2).collect(), want)
    got = engine.from_df(access.strided_get(a, [0, 1], [5, 6], [2, 3]), (3, 2), "double")
    assert np.array_equal(got.collect(), x[0:6:2, 1:7:3])
    want = x.copy()
    want[0:6:2, 1:7:3] = 9
    assert np.array_equal(access.strided_put(a, [0, 1], [5, 6], [2, 3], 9.0).collect(), want)
    at = [np.arange(-2, 8) % 6, np.arange(3, 9) % 7]
    got = engine.from_df(access.periodic_get(a, [-2, 3], [7, 8]), (10, 6), "double")
    assert np.array_equal(got.collect(), x[np.ix_(*at)])
    want = x.copy()
    np.add.at(want, tuple(np.ix_(*at)), 1.0)
    assert np.array_equal(access.periodic_acc(a, [-2, 3], [7, 8], 1.0).collect(), want)
    new = np.arange(60.0).reshape(10, 6)
    want = x.copy()
    for i in range(10):
        for j in range(6):
            want[at[0][i], at[1][j]] = new[i, j]
    assert np.array_equal(access.periodic_put(a, [-2, 3], [7, 8], new).collect(), want)


def test_lists_of_subscripts(engine, spark):
    x = sample((5, 5), "long")
    a = engine.from_numpy(x)
    rng = np.random.default_rng(1)
    at = rng.integers(0, 5, (40, 2))
    subs = spark.createDataFrame([(k, int(i), int(j), k * 10) for k, (i, j) in enumerate(at)], "pos long, i0 long, i1 long, v long")
    got = access.gather(a, subs).orderBy("pos").collect()
    assert [r.v for r in got] == [x[i, j] for i, j in at]
    want = x.copy()
    for k, (i, j) in enumerate(at):
        want[i, j] = k * 10
    assert np.array_equal(access.scatter(a, subs).collect(), want)
    want = x.copy()
    np.add.at(want, (at[:, 0], at[:, 1]), 3 * 10 * np.arange(40))
    assert np.array_equal(access.scatter_acc(a, subs, 3).collect(), want)
    with pytest.raises(Exception, match="outside"):
        access.gather(a, spark.createDataFrame([(0, 5, 0)], "pos long, i0 long, i1 long")).collect()


def test_counters_and_fields(engine, spark):
    old, a = access.read_inc(engine.from_numpy(np.array([5, 7])), [1], 3)
    assert old == 7 and list(a.collect()) == [5, 10]
    assert sorted(r.ticket for r in access.tickets(spark.range(10), ["id"], 4, 2).collect()) == list(range(4, 24, 2))


@pytest.mark.parametrize("dtype", ["int", "long", "float", "double", "cdouble"])
@pytest.mark.parametrize("block", [3, 16, 10_000])
def test_scans(engine, dtype, block):
    n, lo, hi = 60, 4, 55
    rng = np.random.default_rng(block)
    x, m, old = sample((n,), dtype), (rng.random(n) < 0.15).astype(int), np.full(n, -5)
    src, mask, dst = engine.from_numpy(x, dtype), engine.from_numpy(m), engine.from_numpy(old.astype(NP[dtype]), dtype)
    add, ex, copy = (old.astype(x.dtype) for _ in range(3))
    copy[lo : hi + 1] = 0
    run = before = last = None
    for i in range(lo, hi + 1):
        if m[i]:
            run, before, last = x[i], 0, x[i]
        elif run is not None:
            run, before = run + x[i], before + x[i - 1]
        if run is not None:
            add[i], ex[i], copy[i] = run, before, last
    assert np.allclose(scans.scan_add(src, dst, mask, lo, hi, block=block).collect(), add)
    assert np.allclose(scans.scan_add(src, dst, mask, lo, hi, True, block).collect(), ex)
    assert np.allclose(scans.scan_copy(src, dst, mask, lo, hi, block).collect(), copy)
    at = np.flatnonzero(m[lo : hi + 1]) + lo
    out, count = scans.pack(src, dst, mask, lo, hi, block)
    want = old.astype(x.dtype)
    want[: len(at)] = x[at]
    assert np.allclose(out.collect(), want) and count.first()[0] == len(at)
    out, count = scans.unpack(src, dst, mask, lo, hi, block)
    want = old.astype(x.dtype)
    want[at] = x[: len(at)]
    assert np.allclose(out.collect(), want) and count.first()[0] == len(at)


def test_scan_without_bits_keeps_the_destination(engine):
    src, dst, mask = engine.from_numpy(np.arange(9)), engine.from_numpy(np.full(9, 4)), engine.from_numpy(np.zeros(9, int))
    assert list(scans.scan_add(src, dst, mask, 0, 8, block=2).collect()) == [4] * 9
    with pytest.raises(ValueError):
        scans.scan_add(src, src, mask, 0, 8)


def test_patch_enum(engine):
    assert list(ew.patch_enum(engine.create((6,), "long"), 1, 4, 10, -3).collect()) == [0, 10, 7, 4, 1, 0]


def test_segmented_sums_in_many_levels(spark):
    n = 500
    rows = spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 97 == 5).alias("bit"), F.lit(1).alias("x"))
    got = {r.k: (r.seen, r.sum_x) for r in segmented_sums(rows, n, ["x"], 2).collect()}
    for k in range(n):
        assert got[k] == ((k >= 5), k + 1 if k < 5 else (k - 5) % 97 + 1)


def test_numbering_of_a_hot_key(spark):
    rows = spark.range(1000).select((F.when(F.col("id") < 900, 1).otherwise(F.col("id"))).alias("bin"), F.col("id").alias("pos"))
    assert [r.number for r in numbered(rows, ["bin", "pos"]).orderBy("bin", "pos").collect()] == list(range(1000))


@pytest.mark.parametrize("dtype", ["float", "double", "cfloat", "cdouble"])
@pytest.mark.parametrize("trans", [(False, False), (True, False), (False, True), (True, True)])
def test_matmul(engine, dtype, trans):
    x, y, z = sample((5, 7), dtype), sample((7, 4), dtype, 1), sample((5, 4), dtype, 2)
    a = engine.from_numpy(x.T if trans[0] else x, dtype)
    b = engine.from_numpy(y.T if trans[1] else y, dtype)
    c = engine.from_numpy(z, dtype)
    assert np.allclose(dense.matmul(a, b, trans=trans, tile=3, chunk=2).collect(), x @ y)
    assert np.allclose(dense.matmul(a, b, c, alpha=2, beta=3, trans=trans).collect(), 2 * x @ y + 3 * z)


def test_matmul_of_boxes(engine):
    x, y, z = sample((6, 6), "double"), sample((6, 6), "double", 1), sample((6, 6), "double", 2)
    a, b, c = map(engine.from_numpy, (x, y, z))
    boxes = (([1, 0], [3, 4]), ([0, 2], [4, 3]), ([2, 1], [4, 2]))
    want = z.copy()
    want[2:5, 1:3] = x[1:4, 0:5] @ y[0:5, 2:4]
    assert np.array_equal(dense.matmul(a, b, c, boxes=boxes).collect(), want)
    cube = sample((2, 4, 4), "double")
    planes = (([1, 0, 0], [1, 3, 3]), ([0, 0, 0], [0, 3, 3]), ([0, 0, 0], [0, 3, 3]))
    q = engine.from_numpy(cube)
    want = cube.copy()
    want[0] = cube[1] @ cube[0]
    assert np.array_equal(dense.matmul_patch(q, q, q, boxes=planes).collect(), want)


def test_matrices(engine):
    x, v = sample((5, 5), "double"), sample((5,), "double", 1)
    a, w = engine.from_numpy(x), engine.from_numpy(v)
    i = np.eye(5, dtype=bool)
    assert np.array_equal(dense.transpose(a).collect(), x.T)
    assert np.array_equal(dense.symmetrize(a).collect(), (x + x.T) / 2)
    assert np.array_equal(dense.get_diag(a).collect(), np.diag(x))
    assert np.array_equal(dense.set_diagonal(a, w).collect(), np.where(i, np.diag(v), x))
    assert np.array_equal(dense.add_diagonal(a, w).collect(), x + np.diag(v))
    assert np.array_equal(dense.shift_diagonal(a, 2.0).collect(), x + 2 * i)
    assert np.array_equal(dense.zero_diagonal(a).collect(), np.where(i, 0, x))
    assert np.array_equal(dense.scale_rows(a, w).collect(), x * v[:, None])
    assert np.array_equal(dense.scale_cols(a, w).collect(), x * v[None, :])
    assert np.array_equal(dense.zero_triangle(a, True).collect(), np.tril(x))
    assert np.array_equal(dense.mirror_triangle(a, True).collect(), np.triu(x) + np.triu(x, 1).T)


def test_solvers(engine):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(12, 12)), rng.normal(size=(12, 2))
    spd = x @ x.T + 12 * np.eye(12)
    a, s, b = map(engine.from_numpy, (x, spd, y))
    assert np.allclose(dense.lu_solve(a, b).collect(), np.linalg.solve(x, y))
    assert np.allclose(dense.lu_solve(a, b, trans=True).collect(), np.linalg.solve(x.T, y))
    assert np.allclose(dense.llt_solve(s, b).collect(), np.linalg.solve(spd, y))
    assert np.allclose(dense.solve(a, b).collect(), np.linalg.solve(x, y))
    assert np.allclose(dense.spd_invert(s).collect() @ spd, np.eye(12))
    vectors, values = dense.diag_std(s)
    p, q = vectors.collect(), values.collect()
    assert np.allclose(spd @ p, p * q)
    other = spd + np.diag(np.arange(12))
    vectors, values = dense.diag(s, engine.from_numpy(other))
    p, q = vectors.collect(), values.collect()
    assert np.allclose(spd @ p, other @ p * q)


def tridiagonal(n):
    return 2 * np.eye(n) - np.eye(n, k=1) - np.eye(n, k=-1)


@pytest.mark.parametrize("dtype", ["int", "double", "cdouble"])
def test_sparse(engine, dtype):
    n = 24
    x = tridiagonal(n).astype(NP[dtype])
    a = engine.from_numpy(x, dtype)
    s = sparse.assemble(sparse.from_dense(a))
    v = sample((n,), dtype)
    w = engine.from_numpy(v, dtype)
    assert s.df.count() == (x != 0).sum()
    assert np.allclose(sparse.to_dense(s).collect(), x)
    assert np.allclose(sparse.matvec_multiply(s, w).collect(), x @ v)
    assert np.allclose(sparse.to_dense(sparse.matmat_multiply(s, s)).collect(), x @ x)
    y = sample((n, 3), dtype, 4)
    assert np.allclose(sparse.sparse_dense_multiply(s, engine.from_numpy(y, dtype)).collect(), x @ y)
    assert np.allclose(sparse.dense_sparse_multiply(engine.from_numpy(y, dtype), s, trans=True).collect(), y.T @ x)
    assert np.allclose(sparse.get_diag(s).collect(), 2)
    assert np.allclose(sparse.get_column(s, 5).collect(), x[:, 5])
    assert np.allclose(sparse.to_dense(sparse.diag_left_multiply(s, w)).collect(), v[:, None] * x)
    assert np.allclose(sparse.to_dense(sparse.diag_right_multiply(s, w)).collect(), x * v[None, :])
    assert np.allclose(sparse.to_dense(sparse.shift_diag(s, 3)).collect(), x + 3 * np.eye(n))
    assert np.allclose(sparse.to_dense(sparse.scale(s, 3)).collect(), 3 * x)
    blocks = [sparse.row_distribution(s, p) for p in range(4)]
    assert blocks[0][0] == 0 and blocks[-1][1] == n - 1
    assert sum(sparse.get_block(s, p, q).count() for p in range(4) for q in range(4)) == s.df.count()


def test_sparse_zero_diagonal_and_repeats(engine):
    s = sparse.from_dense(engine.from_numpy(np.zeros((3, 3))))
    assert s.df.count() == 3
    s = sparse.add_elements(sparse.create(engine, 2, 3, "double"), [(0, 1, 2.0), (0, 1, 3.0)])
    assert s.df.count() == 2 and sparse.to_dense(s).collect()[0, 1] == 5
    with pytest.raises(ValueError):
        sparse.add_elements(s, [(2, 0, 1.0)])


@pytest.mark.parametrize("dtype", ["long", "double", "cdouble"])
def test_matrix_text_round_trip(engine, dtype, tmp_path):
    x = tridiagonal(6).astype(NP[dtype])
    s = sparse.from_dense(engine.from_numpy(x, dtype))
    sparse.export(s, f"file://{tmp_path}/m")
    assert np.allclose(sparse.to_dense(sparse.load(engine, f"file://{tmp_path}/m", dtype)).collect(), x)


def test_sketch(engine):
    s = sparse.from_dense(engine.from_numpy(tridiagonal(20)))
    sketch, rules = sparse.count_sketch(s, 4)
    want = np.zeros((4, 20))
    for r in rules.collect():
        want[r.label] += r.sign * tridiagonal(20)[r.i]
    assert np.allclose(sketch.collect(), want)


def test_ghosts(spark):
    engine = Engine(spark, n_processes=4)
    x = np.arange(48.0).reshape(8, 6)
    a = engine.builder().set_data((8, 6), "double").set_ghosts((1, 2)).allocate()
    a = a.with_df(engine.from_numpy(x).df)
    for block, (lo, hi), _ in a.layout.blocks():
        got = np.full((hi[0] - lo[0] + 3, hi[1] - lo[1] + 5), np.nan)
        for r in halo.ghost_block(a, block).collect():
            got[r.i0, r.i1] = r.v
        assert np.array_equal(got, x[np.ix_(np.arange(lo[0] - 1, hi[0] + 2) % 8, np.arange(lo[1] - 2, hi[1] + 3) % 6)])
    from dataclasses import replace

    inner, cornerless = halo.update_ghosts(a).count(), halo.update_ghosts(replace(a, corners=False)).count()
    assert inner - cornerless == a.layout.total_blocks * -1 * 4 * 4 * 2
    assert halo.update_ghost_dir(a, 0, 1).count() == sum(hi[1] - lo[1] + 5 for _, (lo, hi), _ in a.layout.blocks())


def test_stencil(engine):
    x = sample((5, 6), "double")
    a = engine.from_numpy(x)
    want = 4 * x - sum(np.roll(x, s, d) for d in (0, 1) for s in (-1, 1))
    assert np.array_equal(halo.stencil(a, halo.cross(2, 4, -1)).collect(), want)
    padded = np.pad(x, 1)
    want = padded[2:, 1:-1] + padded[:-2, 1:-1]
    assert np.array_equal(halo.stencil(a, {(1, 0): 1, (-1, 0): 1}, periodic=False).collect(), want)


def test_iterative_solvers(engine):
    n = 20
    x = tridiagonal(n) + np.eye(n)
    b = np.arange(n, dtype=float)
    s = sparse.from_dense(engine.from_numpy(x))
    for solver in (iterative.conjugate_gradient, iterative.jacobi):
        got = solver(s, engine.from_numpy(b), 1e-6, 40)
        assert np.allclose(got.x.collect(), np.linalg.solve(x, b), atol=1e-3)


def test_layouts(engine):
    layout = Layout.blocks_of_size("scalapack", (7, 5), (2, 2), 4, (2, 2))
    assert layout.total_blocks == 12 and layout.locate([6, 4]) == layout.owner([3, 2]) == 2
    a = engine.create((7, 5), "int", layout=layout)
    owned = {p: access.segment(a, p).count() for p in range(4)}
    assert sum(owned.values()) == 35
    irregular = engine.builder().set_data((10,), "int").set_irregular([[0, 3, 4]]).allocate()
    assert [irregular.layout.process_box(p) for p in range(3)] == [([0], [2]), ([3], [3]), ([4], [9])]
    assert access.block(irregular, 2).count() == 6
    groups = engine.split_group(0, 2)
    assert [engine.groups[g].members for g in groups] == [(0, 1), (2, 3)]


def test_blobs(engine, spark):
    b = blobs.create(engine, (4, 4))
    b = blobs.assign(b, [1, 2], b"abc")
    rows = spark.createDataFrame([(k, k, 0, bytearray(b"x" * k)) for k in range(4)], "pos long, i0 long, i1 long, data binary")
    b = blobs.scatter(b, rows)
    assert blobs.get_size(b, [0, 0], [3, 3]) == 9 and blobs.element(b, [1, 2]) == b"abc"
    assert blobs.gather_size(b, spark.createDataFrame([(0, 3, 0), (1, 3, 0), (2, 0, 3)], "pos long, i0 long, i1 long")) == 6
    assert blobs.element(blobs.zeroed(b), [3, 0]) == b"\0\0\0"
    assert blobs.element(blobs.free(b, [1, 0], [1, 3]), [1, 2]) is None
    with pytest.raises(Exception, match="size"):
        blobs.put(b, [1, 2], [1, 2], spark.createDataFrame([(0, 0, bytearray(b"long"))], "i0 long, i1 long, data binary"), check_size=True).df.collect()


def test_catalog(engine):
    a = engine.create((3, 4), "double", name="m")
    assert engine.arrays["m"] is a and engine.memory_used() == 96
    assert engine.summary().first()["dtype"] == "double"
    engine.destroy(a)
    assert "m" not in engine.arrays


def padded(values: np.ndarray, w: int) -> np.ndarray:
    return np.pad(values, w, mode="wrap")


@pytest.mark.parametrize("starts", [None, 1000, [0, 3, 4, 9, 11]])
def test_ghosts_of_many_blocks(engine, starts):
    from dataclasses import replace

    from gridloom.operators import halo
    from gridloom.plans.layout import Layout

    n, w = 3000 if starts == 1000 else 14, 2
    x = engine.from_numpy(np.arange(float(n)))
    layout = Layout.irregular([n], [starts], 5) if isinstance(starts, list) else Layout.regular([n], starts or 4)
    a = replace(x, layout=layout, ghosts=(w,))
    rows = sorted(map(tuple, halo.update_ghosts(a).select("b0", "i0", "v").collect()))
    own = layout.starts[0]
    ends = [*own[1:], n]
    assert rows == sorted((b, p, float(p % n)) for b, (s, e) in enumerate(zip(own, ends, strict=True)) for p in range(s - w, e + w))
    few = replace(x, layout=Layout.regular([n], 4), ghosts=(w,))
    plan = lambda y: len(halo.update_ghosts(y)._jdf.queryExecution().optimizedPlan().toString())
    if starts == 1000:
        assert plan(a) < 1.1 * plan(few)
    blocks = {r.i0: r.b for r in x.df.select("i0", layout.block_columns()[0].alias("b")).collect()}
    assert all(own[b] <= i < ends[b] for i, b in blocks.items())


@pytest.mark.parametrize("periodic", [True, False])
@pytest.mark.parametrize("tile", [12, 1 << 16])
def test_tiled_stencil(engine, monkeypatch, periodic, tile):
    from gridloom.operators import halo

    monkeypatch.setattr(halo, "TILE_CELLS", tile)
    values = np.random.default_rng(3).integers(-9, 9, (11, 7)).astype(float)
    weights = {(0, 0): 2.0, (1, 0): -1.0, (0, -2): 3.0, (-2, 1): 0.5, (2, 2): 1.0}
    wide = np.pad(values, 2, mode="wrap" if periodic else "constant")
    want = sum(w * wide[2 + i : 13 + i, 2 + j : 9 + j] for (i, j), w in weights.items())
    assert np.allclose(halo.stencil(engine.from_numpy(values), weights, periodic).collect(), want)


def test_frames_of_blocks_are_bounded(engine, monkeypatch):
    from gridloom.operators import access

    monkeypatch.setattr(access, "FRAME_CELLS", 10)

    def fn(pdf):
        assert len(pdf) <= 10
        return pdf.assign(v=pdf["v"] + len(pdf) * 0)

    assert np.array_equal(access.map_blocks(engine.from_numpy(np.arange(77.0)), fn).collect(), np.arange(77.0))


def test_export_joins_sorted_parts(spark, engine, tmp_path):
    from gridloom.operators import sparse

    rows = [(i, (i * 7) % 13, float(i)) for i in range(40)]
    s = sparse.from_frame(engine, spark.createDataFrame(rows, "i long, j long, v double").repartition(5), 40, 13, "double")
    sparse.export(s, f"file://{tmp_path}/m")
    parts = [p for p in (tmp_path / "m").iterdir() if p.name.startswith("part-")]
    said = parts[0].read_text().split("\n")
    assert len(parts) == 1 and said[0].startswith("%%Matrix") and [x.split()[:2] for x in said[2:-1]] == [[str(i + 1), str(j + 1)] for i, j, _ in rows]
    assert sorted(map(tuple, sparse.load(engine, f"file://{tmp_path}/m").df.collect())) == rows


@pytest.mark.parametrize("kind", [float, complex])
def test_systems_by_panels(engine, monkeypatch, kind):
    from gridloom.operators import dense, factor

    n = 61
    monkeypatch.setattr(dense, "MOST_GLOBAL", 40)
    monkeypatch.setattr(factor, "PANEL_BYTES", 17 * n * np.dtype(kind).itemsize)
    rng = np.random.default_rng(4)
    draw = lambda *shape: rng.normal(size=shape) + (1j * rng.normal(size=shape) if kind is complex else 0)
    a, b = draw(n, n), draw(n, 20)
    spd = a @ a.conj().T + n * np.eye(n)
    arrays = [engine.from_numpy(x) for x in (a, b, spd, b[:, 0])]
    assert np.allclose(factor.solved(arrays[0], arrays[1], True).collect(), np.linalg.solve(a, b))
    assert np.allclose(dense.llt_solve(arrays[2], arrays[3]).collect(), np.linalg.solve(spd, b[:, 0]))
    assert np.allclose(dense.cholesky(arrays[2]).collect(), np.linalg.cholesky(spd))
    if kind is float:
        assert np.allclose(dense.lu_solve(arrays[0], arrays[1], trans=True).collect(), np.linalg.solve(a.T, b))
        assert np.allclose(dense.spd_invert(arrays[2]).collect(), np.linalg.inv(spd))
        with pytest.raises(Exception, match="singular"):
            dense.solve(engine.from_numpy(np.zeros((n, n))), arrays[1]).collect()


@pytest.mark.parametrize("dtype", ["int", "double", "cdouble"])
def test_densified_over_runs(spark, engine, dtype):
    """Cells of several runs: elements at their starts and ends, repeated, null and outside; zeros are no rows of a join."""
    m, n = 150, 333
    last = m * n - 1
    at = [0, 1, 16383, 16384, 16385, 32768, last]
    rows = [(k // n, k % n, complex(k + 1)) for k in at] + [(0, 1, 5 + 0j), (m, 0, 7 + 0j), (0, n, 7 + 0j), (-1, 5, 7 + 0j)]
    want = np.zeros((m, n), complex)
    for i, j, v in rows:
        if 0 <= i < m and 0 <= j < n:
            want[i, j] += v
    made = [(i, j, {"re": v.real, "im": v.imag} if dtype == "cdouble" else int(v.real)) for i, j, v in rows] + [(3, 3, None)] * (dtype != "cdouble")
    kind = {"int": "long", "double": "long", "cdouble": "struct<re: double, im: double>"}[dtype]
    a = sparse.to_dense(sparse.from_frame(engine, spark.createDataFrame(made, f"i long, j long, v {kind}"), m, n, dtype))
    assert "Join" not in a.df._jdf.queryExecution().executedPlan().toString()
    assert a.df.count() == a.df.select("i0", "i1").distinct().count() == m * n and a.df.where("v is null").count() == 0
    assert np.array_equal(a.collect(), want)


def test_dot_beyond_longs(engine):
    """Sums, and single products, that no long holds are exact; others stay longs."""
    x, y = np.array([2**62, 2**62, -5]), np.array([2, 3, 7])
    a, b = engine.from_numpy(x), engine.from_numpy(y)
    assert reduce.dot(a, b) == 5 * 2**62 - 35
    assert reduce.dot(a, a) == 2 * 2**124 + 25
    assert reduce.dot_frame(a, b).dtypes == [("dot", "decimal(38,0)")]
    assert reduce.dot_frame(b, b).dtypes == [("dot", "bigint")] and reduce.dot(b, b) == 62
    assert reduce.dot(ew.scale(a, -1), b) == 35 - 5 * 2**62
    edge = engine.from_numpy(np.array([2**62, 2**62 - 1]))
    ones = engine.from_numpy(np.array([1, 1]))
    assert reduce.dot(edge, ones) == 2**63 - 1 and reduce.dot_frame(edge, ones).dtypes == [("dot", "bigint")]


@pytest.mark.parametrize("dtype", ["long", "double", "cdouble"])
def test_sparse_product_over_blocks(spark, engine, dtype):
    """Elements at the edges of blocks, repeated ones, a hot inner index, sums that cancel; partial sums are made in ranges of blocks before a shuffle."""
    n, at = 5000, [0, 1, 2047, 2048, 2049, 4095, 4096, 4999]
    rng = np.random.default_rng(3)
    left = [(i, k, int(rng.integers(1, 9))) for i in at for k in (0, 7, 2048, 4999)] + [(i, 11, 1) for i in range(0, n, 25)] + [(5, 20, 2), (5, 20, 3), (6, 30, 1), (6, 31, 1)]
    right = [(k, j, int(rng.integers(1, 9))) for j in at for k in (0, 7, 2048, 4998)] + [(11, j, 2) for j in range(3, n, 25)] + [(20, 9, 4), (30, 9, 1), (31, 9, -1)]
    value = (lambda v: {"re": 1.0 * v, "im": -1.0 * v}) if dtype == "cdouble" else (lambda v: v)
    kind = "struct<re: double, im: double>" if dtype == "cdouble" else "long"
    a, b = (sparse.from_frame(engine, spark.createDataFrame([(i, j, value(v)) for i, j, v in rows], f"i long, j long, v {kind}"), n, n, dtype) for rows in (left, right))
    want: dict = {}
    for i, k, x in left:
        for k2, j, y in right:
            if k == k2:
                want[i, j] = want.get((i, j), 0) + x * y * ((1 - 1j) ** 2 if dtype == "cdouble" else 1)
    made = sparse.matmat_multiply(a, b).df
    rows = made.collect()
    assert len(rows) == len(want) and want[6, 9] == 0
    assert {(r.i, r.j): complex(r.v["re"], r.v["im"]) if dtype == "cdouble" else r.v for r in rows} == want
    assert "rangepartitioning" in made._jdf.queryExecution().executedPlan().toString()


def test_solver_steps_take_no_matrix_shuffle(spark, engine):
    """Vectors of several blocks; a step's product joins packs of the matrix with arrays of the vector, both written, and shuffles only its sums."""
    n = 5000
    rows = [(i, i, 4.0) for i in range(n)] + [(i, i + 1, -1.0) for i in range(n - 1)] + [(i + 1, i, -1.0) for i in range(n - 1)]
    s = sparse.from_frame(engine, spark.createDataFrame(rows, "i long, j long, v double"), n, n, "double")
    want = np.arange(n) % 7 + 1.0
    b = 4 * want - np.append(want[1:], 0) - np.append(0, want[:-1])
    packs = iterative.stepped(s)
    assert packs.count() < 2 * n
    x = spark.range(n).select(F.col("id").alias("i"), (F.col("id") % 7 + 1.0).cast("double").alias("x"))
    q = iterative.product(packs, x, "x")
    assert np.allclose([r.q for r in q.orderBy("i").collect()], b)
    assert q._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") == 1
    for solver in (iterative.conjugate_gradient, iterative.jacobi):
        assert np.allclose(solver(s, engine.from_numpy(b)).x.collect(), want)
