"""Queries of the array operators over the supplied tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import access, blobs, dense, factor, halo, iterative, reduce, scans, sparse
from gridloom.operators import elementwise as ew
from gridloom.plans.engine import Array, Engine
from gridloom.plans.lineage import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder as arrays."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.at, self.engine = spark, sf_dir, Engine(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.at}/{name}.parquet")

    def size(self, name: str, key: str) -> int:
        return int(self.table(name).agg(F.max(key)).first()[0]) + 1

    def vector(self, name: str, key: str, value, dtype: str = "double", n: int | None = None) -> Array:
        n = n or self.size(name, key)
        return self.engine.from_df(self.table(name), (n,), dtype, index=[key], value=value) if isinstance(value, str) else self.engine.from_df(self.table(name).withColumn("_value", value), (n,), dtype, index=[key], value="_value")

    def prices(self) -> Array:
        return self.vector("orders", "o_orderkey", "o_totalprice")

    def buyers(self) -> Array:
        return self.vector("orders", "o_orderkey", F.col("o_custkey") % 1000 + 1)

    def balances(self) -> Array:
        return self.vector("customer", "c_custkey", "c_acctbal")

    def events(self, key: str = "value", dtype: str = "double") -> Array:
        return self.vector("events", "event_id", key, dtype)

    def signups(self) -> Array:
        return self.vector("events", "event_id", (F.col("event_type") == "signup").cast("int"), "int")

    def embeddings(self) -> Array:
        df = self.table("embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
        return self.engine.from_df(df, (self.size("embeddings", "vec_id"), 64), "double", index=["vec_id", "pos"], value="x")

    def scores(self) -> Array:
        """Whole numbers of the embeddings, so that sums of any order agree."""
        e = self.embeddings()
        return e.with_df(e.df.withColumn("v", F.floor(F.col("v") * 256).cast("double")))

    def supply(self) -> sparse.Sparse:
        """Part x supplier: quantities."""
        df = self.table("lineitem").groupBy(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j")).agg(F.sum("l_quantity").alias("v"))
        return sparse.from_frame(self.engine, df, self.size("part", "p_partkey"), self.size("supplier", "s_suppkey"), "double")


def query(sql: str | None = None, name: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = run.__qualname__ = name or fn.__name__
        QUERIES[run.__name__] = run
        if sql:
            ORACLE_SQL[run.__name__] = sql.strip()
        return fn

    return register


def cells(a: Array | DataFrame) -> DataFrame:
    return a.df if isinstance(a, Array) else a


def half(a: Array) -> tuple[list[int], list[int]]:
    """The box from a quarter to three quarters of each dimension."""
    return [n // 4 for n in a.dims], [3 * n // 4 for n in a.dims]


N_ORDERS = "(SELECT max(o_orderkey) + 1 FROM orders)"
IN_HALF = f"o_orderkey BETWEEN {N_ORDERS} // 4 AND 3 * {N_ORDERS} // 4"
X = "SELECT o_orderkey AS i0, o_totalprice AS v FROM orders"
E = "(SELECT vec_id AS i0, unnest(range(64)) AS i1, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
W = "(SELECT vec_id AS i0, unnest(range(64)) AS i1, floor(256 * CAST(unnest(embedding) AS DOUBLE)) AS v FROM embeddings)"
NV = "(SELECT max(vec_id) + 1 FROM embeddings)"
S = "(SELECT l_partkey AS i, l_suppkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"
PARTS, SUPPLIERS = "(SELECT max(p_partkey) + 1 FROM part)", "(SELECT max(s_suppkey) + 1 FROM supplier)"


# creation and layout
@query("SELECT range AS i0, CAST(0 AS DOUBLE) AS v FROM range((SELECT max(c_custkey) + 1 FROM customer))")
def create_zeros(t: Tables) -> DataFrame:
    return t.balances().like().df


@query("""SELECT CAST(b AS INTEGER) AS process, [b * n // 4] AS lo, [(b + 1) * n // 4 - 1] AS hi
FROM (SELECT range AS b, max(o_orderkey) + 1 AS n FROM range(4), orders GROUP BY 1)""")
def distribution(t: Tables) -> DataFrame:
    from gridloom.sources.text import distribution as blocks

    return blocks(t.prices())


@query("""WITH b AS (SELECT range AS b, range * n // 4 AS lo, (range + 1) * n // 4 - 1 AS hi, n FROM range(4), (SELECT max(o_orderkey) + 1 AS n FROM orders))
SELECT b AS process, greatest(lo, n // 4) AS lo, least(hi, 3 * n // 4) AS hi FROM b WHERE hi >= n // 4 AND lo <= 3 * n // 4""")
def locate_region(t: Tables) -> DataFrame:
    x = t.prices()
    rows = [(owner, lo[0], hi[0]) for (lo, hi), owner in x.layout.region(half(x))]
    return t.spark.createDataFrame(rows, "process long, lo long, hi long")


@query("SELECT c_custkey // 7 % 4 AS process, count(*) AS n_cells, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1")
def block_cyclic(t: Tables) -> DataFrame:
    from gridloom.plans.layout import Layout

    c = t.balances()
    layout = Layout.blocks_of_size("block_cyclic", c.dims, [7], 4)
    return c.df.groupBy(layout.owner_column().alias("process")).agg(F.count(F.lit(1)).alias("n_cells"), F.round(F.sum("v"), 2).alias("total"))


@query("SELECT o_orderkey // 16 AS i0, o_orderkey % 16 AS i1, o_totalprice AS v FROM orders WHERE o_orderkey < (SELECT (max(o_orderkey) + 1) // 16 * 16 FROM orders)")
def overlay(t: Tables) -> DataFrame:
    x = t.prices()
    return t.engine.overlay((x.dims[0] // 16, 16), x).df


# projections
@query(f"SELECT o_orderkey AS i0, CASE WHEN {IN_HALF} THEN CAST(7 AS DOUBLE) ELSE o_totalprice END AS v FROM orders")
def fill_patch(t: Tables) -> DataFrame:
    x = t.prices()
    return ew.fill(x, 7.0, half(x)).df


@query(f"SELECT o_orderkey AS i0, CASE WHEN {IN_HALF} THEN CAST(0 AS DOUBLE) ELSE o_totalprice END AS v FROM orders")
def zero_patch(t: Tables) -> DataFrame:
    x = t.prices()
    return ew.zero(x, half(x)).df


@query(f"SELECT o_orderkey AS i0, CASE WHEN {IN_HALF} THEN o_totalprice * 0.5 ELSE o_totalprice END AS v FROM orders")
def scale_patch(t: Tables) -> DataFrame:
    x = t.prices()
    return ew.scale(x, 0.5, half(x)).df


@query("SELECT c_custkey AS i0, c_acctbal + 1000 AS v FROM customer")
def add_constant(t: Tables) -> DataFrame:
    return ew.add_constant(t.balances(), 1000.0).df


@query("SELECT c_custkey AS i0, abs(c_acctbal) AS v FROM customer")
def abs_value(t: Tables) -> DataFrame:
    return ew.abs_value(t.balances()).df


@query("SELECT o_orderkey AS i0, CAST(1 AS DOUBLE) / (o_custkey % 1000 + 1) AS v FROM orders")
def recip(t: Tables) -> DataFrame:
    return ew.recip(t.buyers()).df


@query("SELECT range AS i0, CASE WHEN range BETWEEN n // 4 AND 3 * n // 4 THEN 5 + (range - n // 4) * 3 ELSE 0 END AS v FROM (SELECT max(o_orderkey) + 1 AS n FROM orders), range((SELECT max(o_orderkey) + 1 FROM orders))")
def patch_enum(t: Tables) -> DataFrame:
    n = t.size("orders", "o_orderkey")
    return ew.patch_enum(t.engine.create((n,), "long"), n // 4, 3 * n // 4, 5, 3).df


@query(f"""WITH e AS (SELECT * FROM {E}),
moved AS (SELECT i0, i1, (i1 * 16 + i0) // 32 AS t0, 32 + (i1 * 16 + i0) % 32 AS t1, v FROM e WHERE i0 < 16 AND i1 < 32)
SELECT e.i0, e.i1, coalesce(m.v, e.v) AS v FROM e LEFT JOIN moved m ON e.i0 = m.t0 + 32 AND e.i1 = m.t1""")
def copy_patch(t: Tables) -> DataFrame:
    """A 16 x 32 box, transposed, in a box of another shape."""
    e = t.embeddings()
    return ew.copy_patch(e, ([0, 0], [15, 31]), e, ([32, 32], [47, 63]), trans=True).df


@query("SELECT c_custkey AS i0, CAST('0x' || substr(md5('5:' || c_custkey), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) * 10 AS v FROM customer")
def randomize(t: Tables) -> DataFrame:
    return ew.randomize(t.balances(), 10.0, seed=5).df


# binary and ternary operations: prices and buyers by index
def binary(name: str, fn, sql: str) -> None:
    @query(f"SELECT o_orderkey AS i0, {sql} AS v FROM (SELECT o_orderkey, o_totalprice AS a, CAST(o_custkey % 1000 + 1 AS DOUBLE) AS b FROM orders)", name)
    def run(t: Tables) -> DataFrame:
        return fn(t.prices(), t.buyers()).df


binary("add", lambda a, b: ew.add(2.0, a, -3.0, b), "2 * a + -3 * b")
binary("elem_multiply", ew.elem_multiply, "a * b")
binary("elem_divide", ew.elem_divide, "a / b")
binary("elem_maximum", ew.elem_maximum, "greatest(a, b)")
binary("elem_minimum", ew.elem_minimum, "least(a, b)")
binary("median", lambda a, b: ew.median(a, b, ew.fill(a, 900.0)), "greatest(least(a, b), least(greatest(a, b), 900))")
SHIFT = "SELECT a.i0, {} AS v FROM (SELECT c_custkey AS i0, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_acctbal END AS a, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE CAST(c_nationkey - 12 AS DOUBLE) END AS b FROM customer) a"


def stepped(name: str, fn, sql: str) -> None:
    @query(SHIFT.format(sql), name)
    def run(t: Tables) -> DataFrame:
        n = t.size("customer", "c_custkey")
        a = t.vector("customer", "c_custkey", F.when(F.col("c_custkey") % 3 == 0, 0.0).otherwise(F.col("c_acctbal")), n=n)
        b = t.vector("customer", "c_custkey", F.when(F.col("c_custkey") % 5 == 0, 0.0).otherwise((F.col("c_nationkey") - 12).cast("double")), n=n)
        return fn(a, b).df


stepped("elem_step_divide", ew.elem_step_divide, "CASE WHEN a = 0 THEN CASE WHEN b >= 0 THEN 1e307 ELSE 0 END WHEN b = 0 THEN 1e307 ELSE a / b END")
stepped("elem_stepb_divide", ew.elem_stepb_divide, "CASE WHEN a = 0 THEN CASE WHEN b > 0 THEN 0 ELSE 1e307 END WHEN b = 0 THEN 1e307 ELSE a / b END")
stepped("step_mask", ew.step_mask, "CASE WHEN a <> 0 THEN b ELSE 0 END")


@query("""SELECT o.o_orderkey AS i0, CASE WHEN c.v IS NULL THEN o.o_totalprice ELSE c.v END AS v FROM orders o
LEFT JOIN (SELECT a.c_custkey AS k, 2 * o_totalprice + 0.5 * c_acctbal AS v FROM customer a JOIN orders b ON b.o_orderkey = a.c_custkey) c ON c.k = o.o_orderkey""")
def add_patch(t: Tables) -> DataFrame:
    x, c = t.prices(), t.balances()
    box = ([0], [c.dims[0] - 1])
    return ew.add(2.0, x, 0.5, c, boxes=[box, box], into=x, target=box).df


# reductions
@query("SELECT round(sum(abs(c_acctbal)), 2) AS norm1, max(abs(c_acctbal)) AS norm_inf FROM customer")
def norms(t: Tables) -> DataFrame:
    return reduce.norm_frame(t.balances()).withColumn("norm1", F.round("norm1", 2))


@query("SELECT CAST(sum(o_custkey * o_orderkey) AS BIGINT) AS dot FROM orders")
def dot(t: Tables) -> DataFrame:
    n = t.size("orders", "o_orderkey")
    a, b = t.vector("orders", "o_orderkey", "o_custkey", "long", n), t.vector("orders", "o_orderkey", F.col("o_orderkey") + 0, "long", n)
    return reduce.dot_frame(a, b)


@query(f"SELECT sum(v * v) AS dot FROM {W} WHERE i0 BETWEEN {NV} // 4 AND 3 * {NV} // 4 AND i1 BETWEEN 16 AND 48")
def dot_patch(t: Tables) -> DataFrame:
    w = t.scores()
    return reduce.dot_frame(w, ew.copy(w), (half(w), half(w)))


for _op, _order in (("min", "ASC"), ("max", "DESC")):

    @query(f"SELECT c_acctbal AS v, c_custkey AS lin FROM customer ORDER BY c_acctbal {_order}, c_custkey LIMIT 1", f"select_{_op}")
    def _select(t: Tables, op: str = _op) -> DataFrame:
        return reduce.select_frame(t.balances(), op)


@query("""SELECT abs(max(CASE WHEN t > 0 THEN -1e307 ELSE t END)) AS step_max FROM (
SELECT CASE WHEN a = 0 THEN CASE WHEN b >= 0 THEN 1e307 ELSE 0 END WHEN b = 0 THEN 1e307 ELSE a / b END AS t
FROM (SELECT o_totalprice AS a, c_acctbal AS b FROM orders JOIN customer ON c_custkey = o_orderkey))""")
def step_max(t: Tables) -> DataFrame:
    x, c = t.prices(), t.balances()
    box = ([0], [c.dims[0] - 1])
    return reduce.step_max_frame(x, c, [box, box])


@query("""WITH p AS (SELECT c_acctbal AS x, CAST(c_nationkey - 12 AS DOUBLE) AS v, -20000.0 AS lo, 20000.0 AS hi FROM customer),
q AS (SELECT v, hi - x AS up, x - lo AS down, greatest(v, 0) AS vp, abs(least(v, 0)) AS vm FROM p),
r AS (SELECT v, up, down, CASE WHEN up = 0 THEN CASE WHEN vp > 0 THEN 0 ELSE 1e307 END WHEN vp = 0 THEN 1e307 ELSE up / vp END AS t1,
  CASE WHEN down = 0 THEN CASE WHEN vm > 0 THEN 0 ELSE 1e307 END WHEN vm = 0 THEN 1e307 ELSE down / vm END AS t2 FROM q),
s AS (SELECT t1, t2, CASE WHEN v <> 0 OR (up <> 0 AND down <> 0) THEN least(t1, t2) ELSE 0 END AS t FROM r)
SELECT min(t) AS boundmin, least(min(t1), min(t2)) AS wolfemin, max(t) AS boundmax FROM s""")
def step_bound_info(t: Tables) -> DataFrame:
    x = t.balances()
    v = t.vector("customer", "c_custkey", (F.col("c_nationkey") - 12).cast("double"), n=x.dims[0])
    return reduce.step_bound_frame(x, v, ew.fill(x, -20000.0), ew.fill(x, 20000.0))


GOPS = {"+": "sum", "max": "max", "min": "min", "or": "bit_or", "band": "bit_and"}
for _op, _sql in GOPS.items():

    @query(f"SELECT k, CAST({_sql}(v) AS BIGINT) AS v FROM (SELECT event_id % 4 AS process, user_id AS k, count(*) AS v FROM events GROUP BY 1, 2) GROUP BY 1", f"global_op_{'sum' if _op == '+' else _op}")
    def _gop(t: Tables, op: str = _op) -> DataFrame:
        x = t.table("events").groupBy((F.col("event_id") % 4).alias("process"), F.col("user_id").alias("k")).agg(F.count(F.lit(1)).alias("v"))
        return reduce.global_op(x, op)


@query("SELECT c_custkey AS i0, c_acctbal + abs(c_acctbal) AS v FROM customer")
def merge_mirrored(t: Tables) -> DataFrame:
    c = t.balances()
    return reduce.merge_mirrored([c, ew.abs_value(c)]).df


# access
@query(f"SELECT o_orderkey - {N_ORDERS} // 4 AS i0, o_totalprice AS v FROM orders WHERE {IN_HALF}")
def get(t: Tables) -> DataFrame:
    x = t.prices()
    return access.get(x, *half(x))


@query("SELECT o_orderkey AS i0, CASE WHEN c_custkey IS NULL THEN o_totalprice ELSE c_acctbal END AS v FROM orders LEFT JOIN customer ON c_custkey + 3 = o_orderkey")
def put(t: Tables) -> DataFrame:
    x, c = t.prices(), t.balances()
    return access.put(x, [3], [c.dims[0] + 2], c).df


@query("SELECT o_orderkey AS i0, CASE WHEN c_custkey IS NULL THEN o_totalprice ELSE o_totalprice + c_acctbal * 0.5 END AS v FROM orders LEFT JOIN customer ON c_custkey + 3 = o_orderkey")
def acc(t: Tables) -> DataFrame:
    x, c = t.prices(), t.balances()
    return access.acc(x, [3], [c.dims[0] + 2], c, 0.5).df


@query(f"SELECT (o_orderkey - 5) // 3 AS i0, o_totalprice AS v FROM orders WHERE o_orderkey >= 5 AND (o_orderkey - 5) % 3 = 0 AND o_orderkey < {N_ORDERS} - 2")
def strided_get(t: Tables) -> DataFrame:
    x = t.prices()
    return access.strided_get(x, [5], [x.dims[0] - 3], [3])


@query("SELECT o_orderkey AS i0, CASE WHEN c_custkey IS NULL THEN o_totalprice ELSE c_acctbal END AS v FROM orders LEFT JOIN customer ON c_custkey * 2 + 1 = o_orderkey")
def strided_put(t: Tables) -> DataFrame:
    x, c = t.prices(), t.balances()
    return access.strided_put(x, [1], [2 * c.dims[0] - 1], [2], c).df


@query("SELECT o_orderkey AS i0, CASE WHEN c_custkey IS NULL THEN o_totalprice ELSE o_totalprice + c_acctbal * 2 END AS v FROM orders LEFT JOIN customer ON c_custkey * 2 + 1 = o_orderkey")
def strided_acc(t: Tables) -> DataFrame:
    x, c = t.prices(), t.balances()
    return access.strided_acc(x, [1], [2 * c.dims[0] - 1], [2], c, 2.0).df


@query(f"SELECT p + 10 AS i0, o_totalprice AS v FROM (SELECT unnest(range(-10, {N_ORDERS} + 10)) AS p) JOIN orders ON o_orderkey = (p + {N_ORDERS}) % {N_ORDERS}")
def periodic_get(t: Tables) -> DataFrame:
    x = t.prices()
    return access.periodic_get(x, [-10], [x.dims[0] + 9])


@query(f"""SELECT o_orderkey AS i0, CASE WHEN c_custkey IS NULL THEN o_totalprice ELSE c_acctbal END AS v FROM orders
LEFT JOIN customer ON o_orderkey = (c_custkey - 10 + {N_ORDERS}) % {N_ORDERS}""")
def periodic_put(t: Tables) -> DataFrame:
    x, c = t.prices(), t.balances()
    return access.periodic_put(x, [-10], [c.dims[0] - 11], c).df


@query(f"""SELECT o_orderkey AS i0, CASE WHEN c_custkey IS NULL THEN o_totalprice ELSE o_totalprice + c_acctbal * 3 END AS v FROM orders
LEFT JOIN customer ON o_orderkey = (c_custkey - 10 + {N_ORDERS}) % {N_ORDERS}""")
def periodic_acc(t: Tables) -> DataFrame:
    x, c = t.prices(), t.balances()
    return access.periodic_acc(x, [-10], [c.dims[0] - 11], c, 3.0).df


@query("SELECT event_id AS pos, user_id % (SELECT max(c_custkey) + 1 FROM customer) AS i0, c_acctbal AS v FROM events JOIN customer ON c_custkey = user_id % (SELECT max(c_custkey) + 1 FROM customer)")
def gather(t: Tables) -> DataFrame:
    c = t.balances()
    return access.gather(c, t.table("events").select(F.col("event_id").alias("pos"), (F.col("user_id") % c.dims[0]).alias("i0")))


@query("""WITH s AS (SELECT user_id % (SELECT max(c_custkey) + 1 FROM customer) AS i0, arg_max(value, event_id) AS v FROM events GROUP BY 1)
SELECT c_custkey AS i0, CASE WHEN s.i0 IS NULL THEN c_acctbal ELSE s.v END AS v FROM customer LEFT JOIN s ON s.i0 = c_custkey""")
def scatter(t: Tables) -> DataFrame:
    c = t.balances()
    return access.scatter(c, t.table("events").select(F.col("event_id").alias("pos"), (F.col("user_id") % c.dims[0]).alias("i0"), F.col("value").alias("v"))).df


@query("""WITH s AS (SELECT l_orderkey AS i0, sum(l_quantity) AS q FROM lineitem GROUP BY 1)
SELECT o_orderkey AS i0, o_custkey + coalesce(2 * CAST(q AS BIGINT), 0) AS v FROM orders LEFT JOIN s ON i0 = o_orderkey""")
def scatter_acc(t: Tables) -> DataFrame:
    x = t.vector("orders", "o_orderkey", "o_custkey", "long")
    return access.scatter_acc(x, t.table("lineitem").select(F.col("l_orderkey").alias("i0"), F.col("l_quantity").cast("long").alias("v")), 2).df


@query("SELECT o_orderkey, 100 + 5 * (row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) AS ticket FROM orders")
def read_inc_tickets(t: Tables) -> DataFrame:
    return access.tickets(t.table("orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 100, 5).select("o_orderkey", "ticket")


@query("SELECT c_custkey AS i0, CASE WHEN c_custkey < (SELECT (max(c_custkey) + 1) // 4 FROM customer) THEN c_acctbal * 2 ELSE c_acctbal + 1 END AS v FROM customer")
def map_blocks(t: Tables) -> DataFrame:
    def fn(pdf):
        first = pdf["i0"].min() == 0
        return pdf.assign(v=pdf["v"] * 2 if first else pdf["v"] + 1)

    return access.map_blocks(t.balances(), fn).df


# scans, compaction, bins
EV = "SELECT event_id AS i, CAST(floor(value) AS BIGINT) AS s, event_type = 'signup' AS bit FROM events"
SEG = f"SELECT *, sum(bit::INT) OVER (ORDER BY i) AS seg FROM ({EV})"


def whole_events(t: Tables) -> tuple[Array, Array, Array]:
    src = t.vector("events", "event_id", F.floor("value"), "long")
    return src, ew.fill(src, -1), t.vector("events", "event_id", (F.col("event_type") == "signup").cast("int"), "int", src.dims[0])


@query(f"SELECT i AS i0, CASE WHEN seg = 0 THEN -1 ELSE CAST(sum(s) OVER (PARTITION BY seg ORDER BY i) AS BIGINT) END AS v FROM ({SEG})")
def scan_add(t: Tables) -> DataFrame:
    src, dst, mask = whole_events(t)
    return scans.scan_add(src, dst, mask, 0, src.dims[0] - 1).df


@query(f"SELECT i AS i0, CASE WHEN seg = 0 THEN -1 ELSE CAST(sum(s) OVER (PARTITION BY seg ORDER BY i) - s AS BIGINT) END AS v FROM ({SEG})")
def scan_add_exclusive(t: Tables) -> DataFrame:
    src, dst, mask = whole_events(t)
    return scans.scan_add(src, dst, mask, 0, src.dims[0] - 1, exclusive=True).df


@query(f"SELECT i AS i0, coalesce(last_value(CASE WHEN bit THEN s END IGNORE NULLS) OVER (ORDER BY i), 0) AS v FROM ({EV})")
def scan_copy(t: Tables) -> DataFrame:
    src, dst, mask = whole_events(t)
    return scans.scan_copy(src, dst, mask, 0, src.dims[0] - 1).df


@query(f"""WITH p AS (SELECT row_number() OVER (ORDER BY i) - 1 AS k, s FROM ({EV}) WHERE bit)
SELECT i AS i0, coalesce(p.s, -1) AS v FROM ({EV}) e LEFT JOIN p ON p.k = e.i""")
def pack(t: Tables) -> DataFrame:
    src, dst, mask = whole_events(t)
    return scans.pack(src, dst, mask, 0, src.dims[0] - 1)[0].df


@query("SELECT count(*) AS count FROM events WHERE event_type = 'signup'")
def pack_count(t: Tables) -> DataFrame:
    src, dst, mask = whole_events(t)
    return scans.pack(src, dst, mask, 0, src.dims[0] - 1)[1]


@query(f"""WITH p AS (SELECT i, row_number() OVER (ORDER BY i) - 1 AS k FROM ({EV}) WHERE bit)
SELECT e.i AS i0, coalesce(f.s, -1) AS v FROM ({EV}) e LEFT JOIN p ON p.i = e.i LEFT JOIN ({EV}) f ON f.i = p.k""")
def unpack(t: Tables) -> DataFrame:
    src, dst, mask = whole_events(t)
    return scans.unpack(src, dst, mask, 0, src.dims[0] - 1)[0].df


def bin_rows(t: Tables) -> tuple[DataFrame, int]:
    rows = t.table("lineitem").select((F.col("l_suppkey") + 1).alias("bin"), F.col("l_partkey").alias("value"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"))
    return rows, t.size("supplier", "s_suppkey")


LINES = "SELECT l_suppkey + 1 AS bin, l_partkey AS value, l_orderkey * 8 + l_linenumber AS pos FROM lineitem"


@query(f"SELECT bin, value, row_number() OVER (ORDER BY bin, pos, value) - 1 AS place FROM ({LINES})")
def bin_index(t: Tables) -> DataFrame:
    return scans.bin_index(*bin_rows(t))


@query(f"SELECT bin, value, row_number() OVER (ORDER BY bin, value, pos) - 1 AS place FROM ({LINES})")
def bin_sorter(t: Tables) -> DataFrame:
    return scans.bin_sorter(*bin_rows(t))


@query(f"""SELECT bin, cnt, CAST(sum(cnt) OVER (ORDER BY bin) - cnt AS BIGINT) AS off FROM (
SELECT range AS bin, count(value) AS cnt FROM range(1, {SUPPLIERS} + 1) LEFT JOIN ({LINES}) ON bin = range GROUP BY 1)""")
def bin_counts(t: Tables) -> DataFrame:
    return scans.bin_counts(*bin_rows(t))


@query(f"""SELECT place // ((SELECT count(*) + 3 FROM lineitem) // 4) AS process, min(bin) AS first_bin, max(bin) AS last_bin
FROM (SELECT bin, row_number() OVER (ORDER BY bin, pos, value) - 1 AS place FROM ({LINES})) GROUP BY 1""")
def bin_range(t: Tables) -> DataFrame:
    rows, n = bin_rows(t)
    return scans.bin_range(scans.bin_index(rows, n), 4, rows.count())


# dense algebra
GRAM = f"SELECT a.i1 AS i0, b.i1 AS i1, sum(a.v * b.v) AS v FROM {W} a JOIN {W} b ON a.i0 = b.i0 GROUP BY 1, 2"


@query(GRAM)
def gemm_gram(t: Tables) -> DataFrame:
    """W^T W over blocks."""
    w = t.scores()
    return dense.matmul(w, w, trans=(True, False)).df


@query(f"""WITH g AS ({GRAM}) SELECT c.i0, c.i1, CASE WHEN g.i0 IS NULL THEN c.v ELSE 2 * g.v + 3 * c.v END AS v FROM {W} c
LEFT JOIN g ON c.i0 = g.i0 + 100 AND c.i1 = g.i1""")
def matmul_patch(t: Tables) -> DataFrame:
    """C[100.., :] = 2 W^T W + 3 C."""
    w = t.scores()
    n = w.dims[0]
    return dense.matmul(w, w, w, alpha=2.0, beta=3.0, trans=(True, False), boxes=(([0, 0], [n - 1, 63]), ([0, 0], [n - 1, 63]), ([100, 0], [163, 63]))).df


@query(f"SELECT i1 AS i0, i0 AS i1, v FROM {E}")
def transpose(t: Tables) -> DataFrame:
    return dense.transpose(t.embeddings()).df


def gram(t: Tables) -> Array:
    """W^T W: a square matrix that all vectors enter."""
    w = t.scores()
    return dense.matmul(w, w, trans=(True, False))


SQ = f"({GRAM})"
COL = f"(SELECT i1 AS k, v AS w FROM {SQ} WHERE i0 = 3)"
for _name, _fn, _sql in (
    ("symmetrize", lambda a, v: dense.symmetrize(dense.scale_rows(a, v)), f"SELECT a.i0, a.i1, (a.v * x.w + a.v * y.w) / 2 AS v FROM {SQ} a JOIN {COL} x ON x.k = a.i0 JOIN {COL} y ON y.k = a.i1"),
    ("get_diag", lambda a, v: dense.get_diag(a), f"SELECT i0, v FROM {SQ} WHERE i0 = i1"),
    ("set_diagonal", dense.set_diagonal, f"SELECT i0, i1, CASE WHEN i0 = i1 THEN w ELSE v END AS v FROM {SQ} JOIN {COL} ON k = i0"),
    ("add_diagonal", dense.add_diagonal, f"SELECT i0, i1, CASE WHEN i0 = i1 THEN v + w ELSE v END AS v FROM {SQ} JOIN {COL} ON k = i0"),
    ("shift_diagonal", lambda a, v: dense.shift_diagonal(a, 2.5), f"SELECT i0, i1, CASE WHEN i0 = i1 THEN v + 2.5 ELSE v END AS v FROM {SQ}"),
    ("zero_diagonal", lambda a, v: dense.zero_diagonal(a), f"SELECT i0, i1, CASE WHEN i0 = i1 THEN 0 ELSE v END AS v FROM {SQ}"),
):

    @query(_sql, _name)
    def _diagonal(t: Tables, fn=_fn) -> DataFrame:
        a = gram(t)
        return fn(a, t.engine.from_df(a.df.where("i0 = 3").select(F.col("i1").alias("i0"), "v"), (64,), "double")).df


@query(f"SELECT i0, i1, v * (i0 % 7 - 3) AS v FROM {W}")
def scale_rows(t: Tables) -> DataFrame:
    w = t.scores()
    return dense.scale_rows(w, t.engine.from_df(t.table("embeddings").withColumn("x", F.col("vec_id") % 7 - 3), (w.dims[0],), "double", index=["vec_id"], value="x")).df


@query(f"SELECT i0, i1, v * w AS v FROM {W} JOIN {COL} ON k = i1")
def scale_cols(t: Tables) -> DataFrame:
    w, g = t.scores(), gram(t)
    return dense.scale_cols(w, t.engine.from_df(g.df.where("i0 = 3").select(F.col("i1").alias("i0"), "v"), (64,), "double")).df


def gram_plus(t: Tables) -> Array:
    """A symmetric positive matrix."""
    w = t.scores()
    return dense.shift_diagonal(dense.matmul(w, w, trans=(True, False)), 1.0)


#: Four right sides' solutions: sums of the vectors' components by vec_id mod 4.
SOLUTION = f"SELECT i1 AS i0, i0 % 4 AS i1, sum(v) AS v FROM {W} GROUP BY 1, 2"


def solution(t: Tables) -> Array:
    cells_ = t.scores().df.groupBy(F.col("i1").alias("a"), (F.col("i0") % 4).alias("b")).agg(F.sum("v").alias("v"))
    return t.engine.from_df(cells_, (64, 4), "double", index=["a", "b"])


def solver(name: str, fn, matrix=gram_plus) -> None:
    """A solver gives back the solution from which its right side was made."""

    @query(SOLUTION, name)
    def run(t: Tables) -> DataFrame:
        a = matrix(t)
        return fn(a, dense.matmul(a, solution(t))).df.withColumn("v", F.round("v", 3) + F.lit(0.0))


def lopsided(t: Tables) -> Array:
    """No symmetric matrix: the Gram matrix with a scaled row for each column."""
    a = gram_plus(t)
    return a.with_df(a.df.withColumn("v", F.col("v") * (F.col("i0") % 5 + 1)))


solver("lu_solve", dense.lu_solve, lopsided)
solver("lu_solve_alt", dense.lu_solve_alt, lopsided)
solver("lu_solve_seq", dense.lu_solve_seq, lopsided)
solver("lu_solve_transposed", lambda a, b: dense.lu_solve(dense.transpose(a), b, trans=True), lopsided)
solver("lu_solve_panels", lambda a, b: factor.solved(a, b, True, width=24), lopsided)
solver("llt_solve", dense.llt_solve)
solver("llt_solve_panels", lambda a, b: factor.solved(a, b, False, width=24))
solver("solve", dense.solve)
solver("spd_invert", lambda a, b: dense.matmul(dense.spd_invert(a), b))


@query(f"SELECT round(sum(v), 2) AS trace FROM ({GRAM}) WHERE i0 = i1")
def diag_std(t: Tables) -> DataFrame:
    """The sum of the eigenvalues is the trace."""
    w = t.scores()
    _, values = dense.diag_std(dense.matmul(w, w, trans=(True, False)))
    return values.df.agg(F.round(F.sum("v"), 2).alias("trace"))


# halos
@query(f"""SELECT b AS b0, p AS i0, o_totalprice AS v FROM (SELECT range AS b, unnest(range(range * n // 4 - 2, (range + 1) * n // 4 + 2)) AS p, n FROM range(4), (SELECT {N_ORDERS} AS n))
JOIN orders ON o_orderkey = (p + n) % n""")
def update_ghosts(t: Tables) -> DataFrame:
    from dataclasses import replace

    return halo.update_ghosts(replace(t.prices(), ghosts=(2,)))


@query(f"""SELECT a.i0, a.i1, 4 * a.v - u.v - d.v - l.v - r.v AS v FROM {W} a
JOIN {W} u ON u.i0 = (a.i0 + 1) % {NV} AND u.i1 = a.i1 JOIN {W} d ON d.i0 = (a.i0 - 1 + {NV}) % {NV} AND d.i1 = a.i1
JOIN {W} l ON l.i0 = a.i0 AND l.i1 = (a.i1 + 1) % 64 JOIN {W} r ON r.i0 = a.i0 AND r.i1 = (a.i1 + 63) % 64""")
def stencil(t: Tables) -> DataFrame:
    return halo.stencil(t.scores(), halo.cross(2, 4.0, -1.0)).df


# sparse matrices
@query(f"SELECT i, j, v FROM {S}")
def sparse_assemble(t: Tables) -> DataFrame:
    return sparse.assemble(t.supply()).df


@query(f"SELECT i0 AS i, i1 AS j, greatest(v, 0) AS v FROM {W} WHERE v > 0 OR i0 = i1")
def sparse_from_dense(t: Tables) -> DataFrame:
    w = t.scores()
    return sparse.from_dense(w.with_df(w.df.withColumn("v", F.greatest("v", F.lit(0.0))))).df


@query(f"SELECT a.range AS i0, b.range AS i1, coalesce(v, 0) AS v FROM range({PARTS}) a CROSS JOIN range({SUPPLIERS}) b LEFT JOIN {S} ON i = a.range AND j = b.range")
def sparse_to_dense(t: Tables) -> DataFrame:
    return sparse.to_dense(t.supply()).df


def supplier_vector(t: Tables, n: int) -> Array:
    return t.vector("supplier", "s_suppkey", (F.col("s_nationkey") + 1).cast("double"), n=n)


@query(f"SELECT range AS i0, coalesce(sum(v * (s_nationkey + 1)), 0) AS v FROM range({PARTS}) LEFT JOIN {S} ON i = range LEFT JOIN supplier ON s_suppkey = j GROUP BY 1")
def spmv(t: Tables) -> DataFrame:
    s = t.supply()
    return sparse.matvec_multiply(s, supplier_vector(t, s.dims[1])).df


@query(f"SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM {S} a JOIN {S} b ON a.i = b.i GROUP BY 1, 2")
def spmm(t: Tables) -> DataFrame:
    s = t.supply()
    return sparse.matmat_multiply(s.transposed(), s).df


@query(f"SELECT range AS i0, d AS i1, coalesce(sum(v * (j + d)), 0) AS v FROM range({PARTS}) CROSS JOIN (SELECT unnest(range(3)) AS d) LEFT JOIN {S} ON i = range GROUP BY 1, 2")
def sparse_dense(t: Tables) -> DataFrame:
    s = t.supply()
    b = t.engine.from_df(t.engine.create((s.dims[1], 3), "double").df.withColumn("v", (F.col("i0") + F.col("i1")).cast("double")), (s.dims[1], 3), "double")
    return sparse.sparse_dense_multiply(s, b).df


@query(f"SELECT d AS i0, range AS i1, coalesce(sum(v * (i + d)), 0) AS v FROM range({SUPPLIERS}) CROSS JOIN (SELECT unnest(range(3)) AS d) LEFT JOIN {S} ON j = range GROUP BY 1, 2")
def dense_sparse(t: Tables) -> DataFrame:
    s = t.supply()
    a = t.engine.from_df(t.engine.create((3, s.dims[0]), "double").df.withColumn("v", (F.col("i0") + F.col("i1")).cast("double")), (3, s.dims[0]), "double")
    return sparse.dense_sparse_multiply(a, s).df


@query(f"SELECT i, j, v * (p_size + 1) AS v FROM {S} JOIN part ON p_partkey = i")
def diag_left_multiply(t: Tables) -> DataFrame:
    s = t.supply()
    return sparse.diag_left_multiply(s, t.vector("part", "p_partkey", (F.col("p_size") + 1).cast("double"), n=s.dims[0])).df


@query(f"SELECT i, j, v * (s_nationkey + 1) AS v FROM {S} JOIN supplier ON s_suppkey = j")
def diag_right_multiply(t: Tables) -> DataFrame:
    s = t.supply()
    return sparse.diag_right_multiply(s, supplier_vector(t, s.dims[1])).df


@query(f"SELECT i, j, CASE WHEN i = j THEN v + 10 ELSE v END AS v FROM {S}")
def sparse_shift_diag(t: Tables) -> DataFrame:
    return sparse.shift_diag(t.supply(), 10.0).df


@query(f"SELECT i, j, v * 0.5 AS v FROM {S}")
def sparse_scale(t: Tables) -> DataFrame:
    return sparse.scale(t.supply(), 0.5).df


@query(f"SELECT range AS i0, coalesce(v, 0) AS v FROM range(least({PARTS}, {SUPPLIERS})) LEFT JOIN {S} ON i = range AND j = range")
def sparse_get_diag(t: Tables) -> DataFrame:
    return sparse.get_diag(t.supply()).df


@query(f"SELECT range AS i0, coalesce(v, 0) AS v FROM range({PARTS}) LEFT JOIN {S} ON i = range AND j = 2")
def sparse_get_column(t: Tables) -> DataFrame:
    return sparse.get_column(t.supply(), 2).df


@query(f"SELECT i, list(j ORDER BY j) AS columns, list(v ORDER BY j) AS values FROM {S} WHERE i * 4 // {PARTS} = 1 AND j * 4 // {SUPPLIERS} = 2 GROUP BY 1")
def sparse_csr_block(t: Tables) -> DataFrame:
    return sparse.compressed_rows(t.supply(), 1, 2)


@query(f"""SELECT '%%MatrixMarket matrix coordinate real general' || chr(10) || {PARTS} || ' ' || {SUPPLIERS} || ' ' || count(*) AS value FROM {S}
UNION ALL SELECT (i + 1) || ' ' || (j + 1) || ' ' || printf('%14.6e', v) FROM {S}""")
def sparse_export(t: Tables) -> DataFrame:
    return sparse.export_lines(t.supply()).select("value")


@query(f"""WITH h AS (SELECT range AS i, md5('1:' || range) AS h FROM range({PARTS})),
r AS (SELECT i, CAST('0x' || substr(h, 1, 13) AS BIGINT) % 16 AS label, CASE WHEN CAST('0x' || substr(h, 14, 8) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END AS sign FROM h)
SELECT a.range AS i0, b.range AS i1, coalesce(x.v, 0) AS v FROM range(16) a CROSS JOIN range({SUPPLIERS}) b
LEFT JOIN (SELECT label, j, sum(v * sign) AS v FROM {S} JOIN r USING (i) GROUP BY 1, 2) x ON x.label = a.range AND x.j = b.range""")
def count_sketch(t: Tables) -> DataFrame:
    return sparse.count_sketch(t.supply(), 16)[0].df


# blobs
def texts(t: Tables) -> blobs.Blobs:
    docs = t.table("documents")
    n = t.size("documents", "doc_id")
    return blobs.from_frame(t.engine, docs.select(F.col("doc_id").alias("i0"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("data")), (n,))


@query("SELECT doc_id - (SELECT (max(doc_id) + 1) // 4 FROM documents) AS i0, CAST(octet_length(encode(coalesce(text, ''))) AS INTEGER) AS size FROM documents WHERE doc_id BETWEEN (SELECT (max(doc_id) + 1) // 4 FROM documents) AND (SELECT 3 * (max(doc_id) + 1) // 4 FROM documents)")
def blob_get(t: Tables) -> DataFrame:
    b = texts(t)
    n = b.dims[0]
    return blobs.get(b, [n // 4], [3 * n // 4]).select("i0", "size")


@query("SELECT event_id AS pos, doc_id AS i0, md5(coalesce(text, '')) AS md5, CAST(octet_length(encode(coalesce(text, ''))) AS INTEGER) AS size FROM events JOIN documents ON doc_id = event_id % (SELECT max(doc_id) + 1 FROM documents)")
def blob_gather(t: Tables) -> DataFrame:
    b = texts(t)
    subs = t.table("events").select(F.col("event_id").alias("pos"), (F.col("event_id") % b.dims[0]).alias("i0"))
    return blobs.gather(b, subs).select("pos", "i0", F.md5("data").alias("md5"), "size")


@query("SELECT doc_id AS i0, CASE WHEN c_name IS NULL THEN md5(coalesce(text, '')) ELSE md5(c_name) END AS md5 FROM documents LEFT JOIN customer ON c_custkey * 2 = doc_id")
def blob_scatter(t: Tables) -> DataFrame:
    b = texts(t)
    subs = t.table("customer").select(F.col("c_custkey").alias("pos"), (F.col("c_custkey") * 2).alias("i0"), F.col("c_name").cast("binary").alias("data")).where(F.col("i0") < b.dims[0])
    return blobs.scatter(b, subs).df.select("i0", F.md5("data").alias("md5"))


# storage
@query(f"SELECT o_orderkey AS i0, CASE WHEN {IN_HALF} THEN o_custkey % 1000 + 1 ELSE o_totalprice END AS v FROM orders")
def disk_array(t: Tables) -> DataFrame:
    """Written, one section overwritten, read again."""
    import uuid

    from gridloom.sources import disk_arrays as disk

    x = t.prices()
    d = disk.create(t.engine, f"{shared_dir(t.spark)}/gridloom/disk-{uuid.uuid4().hex}", x.dims, "double", request=[4000])
    disk.write(x, d)
    disk.write_section(t.buyers(), half(x), d, half(x))
    return disk.read(disk.open_array(t.engine, d.path)).df


# applications
@query("SELECT s_suppkey AS i0, CAST(s_nationkey + 1 AS DOUBLE) AS v FROM supplier")
def conjugate_gradient(t: Tables) -> DataFrame:
    """(S^T S / 1000 + 100 I) x = b, whose right side was made from the suppliers' nations."""
    s = t.supply()
    a = sparse.matmat_multiply(s.transposed(), sparse.scale(s, 1e-3))
    eye = t.spark.range(a.dims[0]).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(100.0).alias("v"))
    from gridloom.plans.lineage import cut

    a = a.with_df(cut(sparse.add_elements(a, eye).df, "matrix"))
    b = sparse.matvec_multiply(a, supplier_vector(t, a.dims[0]))
    return iterative.conjugate_gradient(a, b, 1e-12).x.df.withColumn("v", F.round("v", 4))


from gridloom import catalog_queries  # noqa: E402, F401  they register themselves as the ones above do
