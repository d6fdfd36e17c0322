"""Queries of what surrounds the cells: metadata, layouts, groups, ghost sections, fields, files, disk sections, blobs.

Where an operation answers with a value and not with rows, a query calls many of them by name and gives a row
(operation, answer) each; the SQL works the answers out from the tables.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.api import OPERATIONS
from gridloom.functions.dtypes import DType
from gridloom.operators import access, blobs, dense, halo, reduce, sparse
from gridloom.operators import elementwise as ew
from gridloom.plans.engine import Array, Engine
from gridloom.plans.lineage import shared_dir
from gridloom.queries import GRAM, N_ORDERS, NV, PARTS, SUPPLIERS, S, Tables, W, gram_plus, half, query, texts

ANSWERS = "operation string, answer string"


def answers(t: Tables, pairs: list[tuple[str, object]]) -> DataFrame:
    return t.spark.createDataFrame([(name, str(x)) for name, x in pairs], ANSWERS)


def sql_answers(source: str, pairs: dict[str, str]) -> str:
    """A row for each operation; the answers are SQL texts over the one row of source."""
    return "\nUNION ALL ".join(f"SELECT '{name}' AS operation, CAST({x} AS VARCHAR) AS answer FROM {source}" for name, x in pairs.items())


def fresh(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/gridloom/{name}-{uuid.uuid4().hex}"


ONE = f"(SELECT {N_ORDERS} AS n)"
STARTS = "'[0, ' || n // 4 || ', ' || 2 * n // 4 || ', ' || 3 * n // 4 || ']'"


def grid_array(t: Tables, **more) -> Array:
    """An array over the orders' index space, made in two phases."""
    call = OPERATIONS
    b = call["set_data"](call["create_handle"](t.engine), (t.size("orders", "o_orderkey"),), "double")
    b = call["set_ghost_corner_flag"](call["set_ghosts"](call["set_chunk"](call["set_array_name"](b, "grid"), (1,)), (2,)), (2,), True)
    return call["allocate"](call["set_pgroup"](b, 0))


METADATA = {
    "inquire": "'(''double'', 1, (' || n || ',))'", "inquire_type": "'double'", "inquire_name": "'grid'", "get_array_name": "'grid'", "ndim": "1", "get_dimension": "1",
    "has_ghosts": "'True'", "is_mirrored": "'False'", "valid_handle": "'True'", "verify_handle": "'True'", "check_handle": "'None'", "get_pgroup": "0",
    "uses_proc_grid": "'False'", "uses_irreg_proc_grid": "'False'", "get_distribution_type": "'regular'", "get_block_info": f"'([4], [' || {STARTS} || '])'",
    "total_blocks": "-1", "nblock": "'[4]'", "get_proc_grid": "'[4]'", "get_proc_index": "'[3]'", "proc_topology": "'[2]'", "get_map_info": f"'[' || {STARTS} || ']'",
    "distribution": "'([' || n // 4 || '], [' || 2 * n // 4 - 1 || '])'", "compare_distr": "'True'", "locate": "CASE WHEN n // 3 < n // 4 THEN 0 WHEN n // 3 < 2 * n // 4 THEN 1 ELSE 2 END",
    "locate_nnodes": "1 + (3 * n // 4 >= 2 * n // 4)::INT + (3 * n // 4 >= 3 * n // 4)::INT", "locate_num_blocks": "1 + (3 * n // 4 >= 2 * n // 4)::INT + (3 * n // 4 >= 3 * n // 4)::INT",
    "get_pgroup_size": "4", "set_property": "'True'", "unset_property": "'False'", "deallocate": "'False'", "duplicate": "n", "destroy": "'False'", "register_type": "'True'", "deregister_type": "'False'",
    "type_f2c": "'float'", "type_c2f": "'double precision'", "set_memory_limit": "8 * n", "memory_limited": "'True'", "memory_avail": "0", "memory_avail_type": "0", "inquire_memory": "8 * n",
    "summarize": "'grid double ' || n || ' regular'", "print_stats": "8 * n",
}


@query(sql_answers(ONE, METADATA))
def array_metadata(t: Tables) -> DataFrame:
    a = grid_array(t)
    n, e, call = a.dims[0], t.engine, OPERATIONS
    on_array = ["inquire", "inquire_type", "inquire_name", "get_array_name", "ndim", "get_dimension", "has_ghosts", "is_mirrored", "get_pgroup", "uses_proc_grid", "uses_irreg_proc_grid", "get_distribution_type", "get_block_info", "total_blocks", "nblock", "get_proc_grid", "get_map_info"]
    out = [(name, call[name](a)) for name in on_array]
    out += [(name, call[name](e, a)) for name in ("valid_handle", "verify_handle", "check_handle")]
    out += [("get_proc_index", call["get_proc_index"](a, 3)), ("proc_topology", call["proc_topology"](a, 2)), ("distribution", call["distribution"](a, 1)), ("compare_distr", call["compare_distr"](a, a.like()))]
    lo, hi = half(a)
    out += [("locate", call["locate"](a, [n // 3])), ("locate_nnodes", call["locate_nnodes"](a, lo, hi)), ("locate_num_blocks", call["locate_num_blocks"](a, lo, hi)), ("get_pgroup_size", call["get_pgroup_size"](e, 0))]
    kept = call["set_property"](a, "read_only")
    out += [("set_property", call["is_mirrored"](kept)), ("unset_property", call["is_mirrored"](call["unset_property"](kept))), ("deallocate", call["deallocate"](kept).hint == "read_only"), ("duplicate", call["duplicate"](a).dims[0])]
    pair = T.StructType([T.StructField("price", T.DoubleType()), T.StructField("buyer", T.LongType())])
    call["register_type"](e, "pair", pair)
    out.append(("register_type", e.types.get("pair") == pair))
    call["deregister_type"](e, "pair")
    out += [("deregister_type", "pair" in e.types), ("type_f2c", call["type_f2c"]("real").name), ("type_c2f", call["type_c2f"]("double"))]
    call["set_memory_limit"](e, 8 * n)
    out += [("set_memory_limit", e.memory_limit), *((name, call[name](e)) for name in ("memory_limited", "memory_avail", "memory_avail_type", "inquire_memory"))]
    row = call["summarize"](e).first()
    out += [("summarize", f"{row.name} {row.dtype} {row.dims[0]} {row.layout}"), ("print_stats", call["print_stats"](e)["bytes"])]
    call["destroy"](e, a)
    out.append(("destroy", "grid" in e.arrays))
    return answers(t, out)


VARIANTS = {
    "create": "'(' || n || ',) False regular 4'", "create_config": "'(' || n || ',) False regular 4'", "create_ghosts": "'(' || n || ',) True regular 4'", "create_ghosts_config": "'(' || n || ',) True regular 4'",
    "create_irreg": "'(' || n || ',) False regular 3'", "create_irreg_config": "'(' || n || ',) False regular 3'", "create_ghosts_irreg": "'(' || n || ',) True regular 3'", "create_ghosts_irreg_config": "'(' || n || ',) True regular 3'",
    "set_irreg_distr": "'(' || n || ',) False regular 3'", "set_restricted": "'(' || n || ',) False regular 2'",
}


@query(sql_answers(ONE, VARIANTS) + f" UNION ALL SELECT 'cells', CAST(n AS VARCHAR) FROM {ONE}")
def created_variants(t: Tables) -> DataFrame:
    """Every way of creating an array: dimensions, ghosts, kind of layout and blocks; and the cells that one of them has."""
    call, e, n = OPERATIONS, t.engine, t.size("orders", "o_orderkey")
    b = call["set_data"](call["create_handle"](e), (n,), "long")
    said = lambda a: f"{a.dims} {a.has_ghosts} {a.layout.kind} {a.layout.n_blocks[0]}"
    made = {name: call[name](e, (n,), "long", ghosts=(1,) if "ghosts" in name else ()) for name in ("create", "create_config", "create_ghosts", "create_ghosts_config")}
    for name in ("create_irreg", "create_irreg_config", "create_ghosts_irreg", "create_ghosts_irreg_config", "set_irreg_distr"):
        builder = call[name](b, [[0, n // 5, n // 2]])
        made[name] = call["allocate"](call["set_ghosts"](builder, (1,)) if "ghosts" in name else builder)
    made["set_restricted"] = call["allocate"](call["set_restricted"](b, [1, 3]))
    return answers(t, [*((name, said(a)) for name, a in made.items()), ("cells", made["create_irreg"].df.count())])


# how the cells of a layout are dealt: the vectors' whole numbers, summed by owner
FLAT = "(b0 * {} + b1) % {}"
LAYOUTS = {
    "irregular": ("(i0 >= 10)::INT + (i0 >= 50)::INT", "(i1 >= 16)::INT", FLAT.format(2, 6)),
    "block_cyclic": ("i0 // 7", "i1 // 9", FLAT.format(8, 4)),
    "scalapack": ("i0 // 7", "i1 // 9", "b0 % 2 * 2 + b1 % 2"),
    "tiled": ("i0 // 5", "i1 // 20", "b0 % 2 * 2 + b1 % 2"),
    "tiled_irregular": ("(i0 >= 3)::INT + (i0 >= 30)::INT", "(i1 >= 40)::INT", "b0 % 2 * 2 + b1 % 2"),
    "restricted": (f"((i0 + 1) * 3 - 1) // {NV}", "0", "b0"),
    "chunked": (f"((i0 + 1) * 4 - 1) // {NV}", "0", "b0"),
}


@query("\nUNION ALL ".join(f"SELECT '{k}' AS layout, CAST({owner} AS BIGINT) AS process, count(*) AS n_cells, sum(v) AS total FROM (SELECT {b0} AS b0, {b1} AS b1, v FROM {W}) GROUP BY 2" for k, (b0, b1, owner) in LAYOUTS.items()))
def layout_shares(t: Tables) -> DataFrame:
    w, call = t.scores(), OPERATIONS
    b = call["set_data"](call["create_handle"](t.engine), w.dims, "double")
    six = Engine(t.spark, n_processes=6)
    b6 = call["set_data"](call["create_handle"](six), w.dims, "double")
    made = {
        "irregular": call["create_irreg"](b6, [[0, 10, 50], [0, 16]]),
        "block_cyclic": call["set_block_cyclic"](b, [7, 9]),
        "scalapack": call["set_block_cyclic_proc_grid"](b, [7, 9], [2, 2]),
        "tiled": call["set_tiled_proc_grid"](b, [5, 20], [2, 2], True),
        "tiled_irregular": call["set_tiled_irreg_proc_grid"](b, [[0, 3, 30], [0, 40]], [2, 2]),
        "restricted": call["set_restricted_range"](b, 1, 3),
        "chunked": call["set_chunk"](b, (1, 64)),
    }
    out = None
    for kind, builder in made.items():
        layout = call["allocate"](builder).layout
        one = w.df.groupBy(layout.owner_column().cast("long").alias("process")).agg(F.count(F.lit(1)).alias("n_cells"), F.sum("v").alias("total")).select(F.lit(kind).alias("layout"), "process", "n_cells", "total")
        out = one if out is None else out.unionByName(one)
    return out


GROUPS = {
    "pgroup_create": "'(1, 3)'", "pgroup_nnodes": "2", "pgroup_nodeid": "1", "pgroup_absolute_id": "3", "pgroup_duplicate": "'(1, 3)'", "pgroup_self": "'(2,)'", "pgroup_split": "'[(0, 1), (2, 3)]'",
    "pgroup_split_irreg": "'[(0, 3), (1, 2)]'", "pgroup_set_default": "1", "pgroup_get_default": "1", "pgroup_get_mirror": "'(0, 1, 2, 3)'", "pgroup_get_world": "0", "pgroup_destroy": "'False'",
    "nodeid": "0", "nnodes": "4", "list_nodeid": "'[0, 1, 2, 3]'", "cluster_nnodes": "1", "cluster_nodeid": "0", "cluster_nprocs": "4", "cluster_procid": "2", "cluster_proc_nodeid": "0", "uses_ma": "'False'",
    "initialize": "'True'", "initialize_comm": "'True'", "initialized": "'True'", "initialize_ltd": "n", "set_debug": "'True'", "get_debug": "'True'", "create_mutexes": "3", "lock": "'True'", "unlock": "'False'", "destroy_mutexes": "0",
    "version": "'(1, 0, 0)'", "error": "'stopped: 7'", "malloc": "n", "comp_patch": "'True'", "patch_intersect": "'([' || n // 4 || '], [' || n // 2 || '])'", "timer": "'True'", "wtime": "'True'", "rand": "'True'", "terminate": "0",
}


@query(sql_answers(ONE, GROUPS))
def process_groups(t: Tables) -> DataFrame:
    call, e = OPERATIONS, call_engine(t)
    n = t.size("orders", "o_orderkey")
    g = call["pgroup_create"](e, [1, 3])
    members = lambda k: e.groups[k].members
    out = [("pgroup_create", members(g)), ("pgroup_nnodes", call["pgroup_nnodes"](e, g)), ("pgroup_nodeid", call["pgroup_nodeid"](e, g, 3)), ("pgroup_absolute_id", call["pgroup_absolute_id"](e, g, 1))]
    d = call["pgroup_duplicate"](e, g)
    out += [("pgroup_duplicate", members(d)), ("pgroup_self", members(call["pgroup_self"](e, 2))), ("pgroup_split", [members(k) for k in call["pgroup_split"](e, 0, 2)])]
    out.append(("pgroup_split_irreg", [members(k) for _, k in sorted(call["pgroup_split_irreg"](e, 0, [0, 1, 1, 0]).items())]))
    call["pgroup_set_default"](e, g)
    out += [("pgroup_set_default", e.default_group), ("pgroup_get_default", call["pgroup_get_default"](e)), ("pgroup_get_mirror", members(call["pgroup_get_mirror"](e, 1))), ("pgroup_get_world", call["pgroup_get_world"](e))]
    call["pgroup_destroy"](e, d)
    out.append(("pgroup_destroy", d in e.groups))
    out += [(name, call[name](e)) for name in ("nodeid", "nnodes", "list_nodeid", "cluster_nnodes", "cluster_nodeid", "uses_ma", "initialized", "version")]
    out += [("cluster_nprocs", call["cluster_nprocs"](e, 0)), ("cluster_procid", call["cluster_procid"](e, 0, 2)), ("cluster_proc_nodeid", call["cluster_proc_nodeid"](e, 3))]
    out += [(name, isinstance(call[name](t.spark), Engine)) for name in ("initialize", "initialize_comm")] + [("initialize_ltd", call["initialize_ltd"](t.spark, n).memory_limit)]
    call["set_debug"](e, 1)
    out += [("set_debug", e.debug), ("get_debug", call["get_debug"](e))]
    call["create_mutexes"](e, 3)
    out.append(("create_mutexes", len(e.mutexes)))
    call["lock"](e, 1)
    out.append(("lock", e.mutexes[1].locked()))
    call["unlock"](e, 1)
    out.append(("unlock", e.mutexes[1].locked()))
    call["destroy_mutexes"](e)
    out.append(("destroy_mutexes", len(e.mutexes)))
    try:
        call["error"](e, "stopped", 7)
    except RuntimeError as stop:
        out.append(("error", stop))
    out += [("malloc", len(call["malloc"](n))), ("comp_patch", call["comp_patch"](([0, 0], [3, 0]), ([1], [4]))), ("patch_intersect", call["patch_intersect"](([0], [n // 2]), ([n // 4], [n - 1])))]
    out += [("timer", call["timer"]() > 0), ("wtime", call["wtime"](e) > 0), ("rand", 0 <= call["rand"](e, 5) < 1)]
    e.create((3,), "int", name="small")
    call["terminate"](e)
    return answers(t, [*out, ("terminate", len(e.arrays))])


def call_engine(t: Tables) -> Engine:
    return OPERATIONS["initialize"](t.spark)


# ghost sections
def ghosted(t: Tables) -> Array:
    return replace(t.prices(), ghosts=(2,))


def halo_of(where: str) -> str:
    """b0, i0, v of the four blocks with halos of 2; where: over s and e, a block's first index and the one after its last."""
    return f"""SELECT b AS b0, p AS i0, o_totalprice AS v FROM (SELECT range AS b, range * n // 4 AS s, (range + 1) * n // 4 AS e, n, unnest(range(range * n // 4 - 2, (range + 1) * n // 4 + 2)) AS p
FROM range(4), (SELECT {N_ORDERS} AS n)) JOIN orders ON o_orderkey = (p + n) % n WHERE {where}"""


@query(halo_of("p < s"))
def update_ghost_dir(t: Tables) -> DataFrame:
    return OPERATIONS["update_ghost_dir"](ghosted(t), 0, -1)


@query(halo_of("p >= e"))
def nbget_ghost_dir(t: Tables) -> DataFrame:
    return OPERATIONS["nbget_ghost_dir"](ghosted(t), [1])


@query(f"SELECT i0 - s + 2 AS i0, v FROM (SELECT x.*, 2 * {N_ORDERS} // 4 AS s FROM ({halo_of('b = 2')}) x)")
def access_ghosts(t: Tables) -> DataFrame:
    """Block 2 with its halo, from the halo's corner."""
    return OPERATIONS["access_ghosts"](ghosted(t), [2])


@query(f"SELECT p + 5 AS i0, o_totalprice AS v FROM (SELECT unnest(range(-5, 4)) AS p) JOIN orders ON o_orderkey = (p + {N_ORDERS}) % {N_ORDERS}")
def get_ghost_block(t: Tables) -> DataFrame:
    return OPERATIONS["get_ghost_block"](ghosted(t), [-5], [3])


@query(f"SELECT 'access_ghost_element' AS operation, round(o_totalprice, 2) AS v FROM orders WHERE o_orderkey = {N_ORDERS} - 1")
def access_ghost_element(t: Tables) -> DataFrame:
    """Of block 0 the element left of its first one: the array's last."""
    return t.spark.createDataFrame([("access_ghost_element", round(OPERATIONS["access_ghost_element"](ghosted(t), [0], [1]), 2))], "operation string, v double")


@query(f"""SELECT a.i0, a.i1, u.v - 2 * coalesce(r.v, 0) + 3 * coalesce(d.v, 0) AS v FROM {W} a JOIN {W} u ON u.i0 = a.i0 AND u.i1 = a.i1
LEFT JOIN {W} r ON r.i0 = a.i0 + 1 AND r.i1 = a.i1 LEFT JOIN {W} d ON d.i0 = a.i0 - 2 AND d.i1 = a.i1 + 1""")
def stencil_bounded(t: Tables) -> DataFrame:
    """Not periodic: what is beyond the array counts as 0."""
    return halo.stencil(t.scores(), {(0, 0): 1.0, (1, 0): -2.0, (-2, 1): 3.0}, periodic=False).df


@query(halo_of("true"))
def update_ghosts_by_shift(t: Tables) -> DataFrame:
    """All the older forms of the update give the same sections."""
    a, out = ghosted(t), None
    for name in (f"update{k}_ghosts" for k in (1, 2, 3, 4, 44, 5, 55, 6, 7)):
        one = OPERATIONS[name](a)
        out = one if out is None else out.intersect(one)
    return out


# blocks as tables, elements, fields
@query(f"SELECT 'block' AS part, o_orderkey AS i0, o_totalprice AS v FROM orders, {ONE} WHERE o_orderkey BETWEEN n // 4 AND 2 * n // 4 - 1 "
       f"UNION ALL SELECT 'block_at', o_orderkey, o_totalprice FROM orders, {ONE} WHERE o_orderkey >= 3 * n // 4 UNION ALL SELECT 'segment', o_orderkey, o_totalprice FROM orders, {ONE} WHERE o_orderkey < n // 4")  # fmt: skip
def access_block(t: Tables) -> DataFrame:
    x = t.prices()
    parts = [("block", OPERATIONS["access_block_ptr"](x, 1)), ("block_at", OPERATIONS["access_block_grid_ptr"](x, [3])), ("segment", OPERATIONS["access_block_segment_ptr"](x, 0))]
    out = None
    for name, df in parts:
        one = df.select(F.lit(name).alias("part"), "i0", "v")
        out = one if out is None else out.unionByName(one)
    return out


PAIR = DType("pair", T.StructType([T.StructField("price", T.DoubleType()), T.StructField("buyer", T.LongType())]), "struct", 0)


def pairs(t: Tables) -> Array:
    v = F.struct(F.col("o_totalprice").alias("price"), F.col("o_custkey").cast("long").alias("buyer"))
    return t.engine.from_df(t.table("orders").withColumn("_v", v), (t.size("orders", "o_orderkey"),), PAIR, index=["o_orderkey"], value="_v")


@query(f"SELECT o_orderkey - {N_ORDERS} // 4 AS i0, CAST(o_custkey AS BIGINT) AS v FROM orders WHERE o_orderkey BETWEEN {N_ORDERS} // 4 AND 3 * {N_ORDERS} // 4")
def get_field(t: Tables) -> DataFrame:
    a = pairs(t)
    return OPERATIONS["get_field"](a, *half(a), "buyer")


@query("SELECT o_orderkey AS i0, o_totalprice AS price, CAST(CASE WHEN c_custkey IS NULL THEN o_custkey ELSE c_nationkey END AS BIGINT) AS buyer FROM orders LEFT JOIN customer ON c_custkey + 3 = o_orderkey")
def put_field(t: Tables) -> DataFrame:
    a, c = pairs(t), t.vector("customer", "c_custkey", "c_nationkey", "long")
    return OPERATIONS["put_field"](a, [3], [c.dims[0] + 2], "buyer", c.df).df.select("i0", "v.price", "v.buyer")


@query("SELECT 'data' AS part, o_orderkey AS i0, CASE WHEN c_custkey IS NULL THEN o_totalprice ELSE c_acctbal END AS v FROM orders LEFT JOIN customer ON c_custkey = o_orderkey "
       "UNION ALL SELECT 'flag', range, CASE WHEN range = 1 THEN 9.0 ELSE 0.0 END FROM range(3)")  # fmt: skip
def nbput_notify(t: Tables) -> DataFrame:
    x, c = t.prices(), t.balances()
    data, flag = OPERATIONS["nbput_notify"](x, [0], [c.dims[0] - 1], c, t.engine.create((3,), "double"), [1], [9.0])
    return data.df.select(F.lit("data").alias("part"), "i0", "v").unionByName(flag.df.select(F.lit("flag").alias("part"), "i0", "v"))


@query(f"SELECT o_orderkey AS i0, CAST(o_custkey + CASE WHEN o_orderkey = 5 THEN 7 ELSE 0 END AS BIGINT) AS v, (SELECT CAST(o_custkey AS BIGINT) FROM orders WHERE o_orderkey = 5) AS old FROM orders")
def read_inc(t: Tables) -> DataFrame:
    old, new = OPERATIONS["read_inc"](t.vector("orders", "o_orderkey", "o_custkey", "long"), [5], 7)
    return OPERATIONS["nbwait"](OPERATIONS["copy"](new).df).withColumn("old", F.lit(old).cast("long"))


# reductions between processes
@query("SELECT p AS process, k, v FROM (SELECT unnest([0, 1, 2, 3]) AS p), (SELECT user_id AS k, count(*) AS v FROM events WHERE event_id % 4 = 2 GROUP BY 1)")
def brdcst(t: Tables) -> DataFrame:
    x = t.table("events").groupBy((F.col("event_id") % 4).alias("process"), F.col("user_id").alias("k")).agg(F.count(F.lit(1)).alias("v"))
    return OPERATIONS["brdcst"](x, 2, [0, 1, 2, 3])


@query("SELECT process % 2 AS half, k, max(v) AS v FROM (SELECT event_id % 4 AS process, user_id AS k, count(*) AS v FROM events GROUP BY 1, 2) GROUP BY 1, 2")
def pgroup_gop(t: Tables) -> DataFrame:
    x = t.table("events").groupBy((F.col("event_id") % 4).alias("process"), F.col("user_id").alias("k")).agg(F.count(F.lit(1)).alias("v"))
    return OPERATIONS["pgroup_gop"](x.withColumn("half", F.col("process") % 2), "max", "half")


@query("SELECT o_orderkey AS i0, CASE WHEN c_custkey IS NULL THEN o_totalprice ELSE c_acctbal + abs(c_acctbal) END AS v FROM orders LEFT JOIN customer ON c_custkey + 2 = o_orderkey AND c_custkey BETWEEN 1 AND 9")
def merge_distr_patch(t: Tables) -> DataFrame:
    c = t.balances()
    return OPERATIONS["merge_distr_patch"]([c, ew.abs_value(c)], ([1], [9]), t.prices(), ([3], [11])).df


@query(f"SELECT (SELECT count(*) FROM {W} WHERE v <> 0) AS dense, (SELECT count(*) FROM {S} WHERE v <> 0) AS sparse")
def num_nonzeros(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(OPERATIONS["num_nonzeros"](t.scores()), OPERATIONS["sprs_array_num_nonzeros"](t.supply()))], "dense long, sparse long")


# dense algebra: factors and decompositions are held against the matrix that they give back
G = f"SELECT i0, i1, v + (i0 = i1)::INT AS v FROM ({GRAM})"


def whole(df: DataFrame) -> DataFrame:
    return df.withColumn("v", F.round("v", 0) + F.lit(0.0))


@query(G)
def cholesky(t: Tables) -> DataFrame:
    """The factor times its transpose is the matrix."""
    low = OPERATIONS["cholesky"](gram_plus(t))
    return whole(dense.matmul(low, low, trans=(False, True)).df)


@query(f"SELECT i0, i1, v FROM ({GRAM})")
def diag_std_vectors(t: Tables) -> DataFrame:
    """Eigenvectors, scaled by eigenvalues, times the transposed eigenvectors: the matrix."""
    w = t.scores()
    vectors, values = OPERATIONS["diag_std"](dense.matmul(w, w, trans=(True, False)))
    return whole(dense.matmul(dense.scale_cols(vectors, values), vectors, trans=(False, True)).df)


@query(f"SELECT i0, i1, v FROM ({GRAM})")
def diag_generalised(t: Tables) -> DataFrame:
    """A x = l S x with S = A + I + 2 D, D the matrix' first row on the diagonal: S V L V^T S is A, as V^T S V is I."""
    w = t.scores()
    a = dense.matmul(w, w, trans=(True, False))
    first = t.engine.from_df(a.df.where("i0 = 0").select(F.col("i1").alias("i0"), F.abs("v").alias("v")), (64,), "double")
    s = dense.add_diagonal(gram_plus(t), ew.scale(first, 2.0))
    vectors, values = OPERATIONS["diag"](a, s)
    sv = dense.matmul(s, vectors)
    return whole(dense.matmul(dense.scale_cols(sv, values), sv, trans=(False, True)).df)


@query(f"SELECT k AS form, i0, i1, v FROM ({GRAM}), (SELECT unnest(['diag_std_seq', 'diag_seq', 'diag_reuse']) AS k)")
def diag_forms(t: Tables) -> DataFrame:
    """The other forms of both decompositions; with S = I the generalised one is the plain one."""
    w = t.scores()
    a = dense.matmul(w, w, trans=(True, False))
    eye = dense.shift_diagonal(t.engine.create((64, 64), "double"), 1.0)
    out = None
    for name in ("diag_std_seq", "diag_seq", "diag_reuse"):
        vectors, values = OPERATIONS[name](a) if name == "diag_std_seq" else OPERATIONS[name](a, eye)
        one = whole(dense.matmul(dense.scale_cols(vectors, values), vectors, trans=(False, True)).df).select(F.lit(name).alias("form"), "i0", "i1", "v")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"SELECT i0, i1, CASE WHEN i0 < i1 THEN 0 ELSE v END AS v FROM ({GRAM})")
def zero_triangle(t: Tables) -> DataFrame:
    w = t.scores()
    return OPERATIONS["zero_triangle"](dense.matmul_basic(w, w, trans=(True, False)), True).df


@query(f"SELECT a.i0, a.i1, CASE WHEN a.i0 <= a.i1 THEN a.v + a.i0 ELSE b.v + a.i1 END AS v FROM ({GRAM}) a JOIN ({GRAM}) b ON a.i0 = b.i1 AND a.i1 = b.i0")
def mirror_triangle(t: Tables) -> DataFrame:
    w = t.scores()
    g = OPERATIONS["matmul_mirrored"](w, w, trans=(True, False))
    return OPERATIONS["mirror_triangle"](g.with_df(g.df.withColumn("v", F.col("v") + F.col("i0"))), True).df


@query(f"SELECT i0 - 100 AS i0, i1, 2 * v AS v FROM (SELECT i0 + 100 AS i0, i1, v FROM ({GRAM}))")
def matmul_patch_alt(t: Tables) -> DataFrame:
    w = t.scores()
    n = w.dims[0]
    wt = dense.transpose(w)
    c = t.engine.create((64, 64), "double")
    return OPERATIONS["matmul_patch_alt"](wt, w, c, alpha=2.0, boxes=(([0, 0], [63, n - 1]), ([0, 0], [n - 1, 63]), ([0, 0], [63, 63]))).df


# sparse matrices: what a process holds
BLOCK = f"i * 4 // {PARTS}"


@query(f"SELECT b AS process, min(r) AS first_row, max(r) AS last_row, (SELECT min(range) FROM range({SUPPLIERS}) WHERE range * 4 // {SUPPLIERS} = b) AS first_column, (SELECT max(range) FROM range({SUPPLIERS}) WHERE range * 4 // {SUPPLIERS} = b) AS last_column "
       f"FROM (SELECT range AS r, range * 4 // {PARTS} AS b FROM range({PARTS})) GROUP BY 1")  # fmt: skip
def sparse_distribution(t: Tables) -> DataFrame:
    s = OPERATIONS["sprs_array_duplicate"](t.supply())
    rows = [(p, *OPERATIONS["sprs_array_row_distribution"](s, p), *OPERATIONS["sprs_array_column_distribution"](s, p)) for p in range(4)]
    OPERATIONS["sprs_array_destroy"](s)
    return t.spark.createDataFrame(rows, "process long, first_row long, last_row long, first_column long, last_column long")


@query(f"SELECT DISTINCT j * 4 // {SUPPLIERS} AS block FROM {S} WHERE {BLOCK} = 2")
def sparse_column_blocks(t: Tables) -> DataFrame:
    return OPERATIONS["sprs_array_col_block_list"](t.supply(), 2)


@query(f"SELECT i, j, v FROM {S} WHERE {BLOCK} = 3 AND j * 4 // {SUPPLIERS} = 1")
def sparse_get_block(t: Tables) -> DataFrame:
    return OPERATIONS["sprs_array_get_block"](t.supply(), 3, 1)


@query(f"SELECT i, j, round(v, 6) AS v FROM {S}")
def sparse_export_and_load(t: Tables) -> DataFrame:
    path = fresh(t, "matrix")
    OPERATIONS["sprs_array_export"](t.supply(), path)
    return OPERATIONS["sprs_array_load"](t.engine, path).df.withColumn("v", F.round("v", 6))


# arrays as text
@query(f"SELECT o_orderkey AS lin, '[' || o_orderkey || '] ' || printf('%12.6f', o_totalprice) AS value FROM orders WHERE o_orderkey BETWEEN {N_ORDERS} // 4 AND 3 * {N_ORDERS} // 4")
def print_patch_file(t: Tables) -> DataFrame:
    """The file's lines, with the place that each names."""
    x, path = t.prices(), fresh(t, "text")
    OPERATIONS["print_patch_file"](x, path, *half(x))
    return t.spark.read.text(path).select(F.regexp_extract("value", r"^\[(\d+)\]", 1).cast("long").alias("lin"), "value")


@query("SELECT 'array - double [' || n || ']' AS line, 0 AS place FROM (SELECT max(c_custkey) + 1 AS n FROM customer) UNION ALL "
       "SELECT '[' || c_custkey || '] ' || printf('%12.6f', c_acctbal), c_custkey - 9 FROM customer WHERE c_custkey BETWEEN 10 AND 12 UNION ALL SELECT '... 4 more rows', 4")  # fmt: skip
def print_patch(t: Tables) -> DataFrame:
    said = OPERATIONS["print_patch"](t.balances(), [10], [16], most=3).split("\n")
    return t.spark.createDataFrame([(x, k) for k, x in enumerate(said)], "line string, place long")


@query("""SELECT CAST(b AS INTEGER) AS process, [b * n // 4] AS lo, [(b + 1) * n // 4 - 1] AS hi FROM (SELECT range AS b, max(c_custkey) + 1 AS n FROM range(4), customer GROUP BY 1)""")
def print_distribution(t: Tables) -> DataFrame:
    return OPERATIONS["print_distribution"](t.balances())


# disk arrays, saved arrays
@query(f"SELECT i0, i1, coalesce(v, 0) AS v FROM (SELECT a.range AS i0, b.range AS i1 FROM range(20) a, range(12) b) LEFT JOIN (SELECT i1 - 5 AS i0, i0 - 30 AS i1, v FROM {W} WHERE i0 BETWEEN 30 AND 41 AND i1 BETWEEN 5 AND 24) USING (i0, i1)")
def disk_read_section(t: Tables) -> DataFrame:
    """A section of the stored vectors, transposed into an array of its own."""
    w, call = t.scores(), OPERATIONS
    d = call["disk_create_config"](t.engine, fresh(t, "disk"), w.dims, "double", name="vectors", request=[64, 16], files=3)
    call["disk_write"](w, d)
    d = call["disk_open"](t.engine, d.path)
    return call["disk_read_section"](d, ([30, 5], [41, 24]), t.engine.create((20, 12), "double"), ([0, 0], [19, 11]), True).df


DISK = {"disk_inquire": "'double 2 (' || n || ', 64) vectors'", "disk_probe": "'True'", "disk_wait": "'None'", "disk_close": "'None'", "disk_print_internals": "'(64, 16) 4 ' || (n + 63) // 64 * 4", "disk_set_default_config": "2", "disk_set_debug": "'True'", "disk_delete": "'no array'"}


@query(sql_answers(f"(SELECT {NV} AS n)", DISK))
def disk_description(t: Tables) -> DataFrame:
    from gridloom.sources import disk_arrays

    w, call = t.scores(), OPERATIONS
    before = dict(disk_arrays.DEFAULTS)
    try:
        call["disk_set_default_config"](4)
        call["disk_set_debug"](1)
        d = call["disk_write"](w, call["disk_create"](t.engine, fresh(t, "disk"), w.dims, "double", "vectors", [64, 16]))
        debug = disk_arrays.DEFAULTS["debug"]
        call["disk_set_default_config"](2)
        files = call["disk_create"](t.engine, fresh(t, "disk"), w.dims, "double").files
    finally:
        disk_arrays.DEFAULTS.update(before)
    said, inner = call["disk_inquire"](d), call["disk_print_internals"](d)
    out = [("disk_inquire", f"{said['dtype']} {said['ndim']} {said['dims']} {said['name']}"), ("disk_probe", call["disk_probe"](d)), ("disk_wait", call["disk_wait"](d)), ("disk_close", call["disk_close"](d))]
    out += [("disk_print_internals", f"{inner['chunk']} {inner['files']} {inner['blocks']}"), ("disk_set_default_config", files), ("disk_set_debug", debug)]
    call["disk_delete"](d)
    try:
        call["disk_open"](t.engine, d.path)
    except ValueError as none:
        out.append(("disk_delete", str(none)[:8]))
    return answers(t, out)


@query("SELECT c_custkey AS i0, c_acctbal * 2 AS v FROM customer")
def recover_arrays(t: Tables) -> DataFrame:
    """Saved twice; another engine recovers the last version."""
    path, c = fresh(t, "saved"), replace(t.balances(), name="balances")
    OPERATIONS["checkpoint_arrays"](t.engine, path, c)
    OPERATIONS["checkpoint_arrays"](t.engine, path, ew.scale(c, 2.0))
    return OPERATIONS["recover_arrays"](Engine(t.spark), path, "balances").df


@query("SELECT k AS event, 'balances' AS array, operation, [lo] AS lo, [hi] AS hi FROM (SELECT 0 AS k, 'get' AS operation, 0 AS lo, max(c_custkey) AS hi FROM customer UNION ALL SELECT 1, 'put', 3, 5)")
def trace(t: Tables) -> DataFrame:
    c, call = replace(t.balances(), name="balances"), OPERATIONS
    call["trace_genrec"](t.engine, c, [0], [c.dims[0] - 1], "get", 0.0, 1.0)
    call["trace_genrec"](t.engine, c, [3], [5], "put", 1.0, 2.0)
    return call["trace"](t.engine).drop("began", "ended")


# files of bytes
@query("SELECT o_orderkey * 8 AS \"offset\", lpad(CAST(CASE WHEN o_orderkey = 2 THEN 77 ELSE o_custkey END AS VARCHAR), 8, ' ') AS said FROM orders")
def shared_file(t: Tables) -> DataFrame:
    """A record of eight bytes for each order, one of them written again; the last piece at an offset holds."""
    call = OPERATIONS
    f = call["shared_open"](t.spark, fresh(t, "file"), ".bin")
    f.write_rows(t.table("orders").select((F.col("o_orderkey") * 8).alias("offset"), F.lpad(F.col("o_custkey").cast("string"), 8, " ").cast("binary").alias("bytes")))
    call["shared_write"](f, 16, b"      77")
    last = f.pieces().groupBy("offset").agg(F.max_by("bytes", "seq").alias("bytes"))
    return last.select("offset", F.col("bytes").cast("string").alias("said"))


FILES = {
    "shared_create": "'True'", "shared_read": "lpad(CAST(c AS VARCHAR), 8, ' ')", "shared_read_only": "'False'", "shared_wait": "'True'", "shared_wait_all": "'True'", "shared_fsync": "'True'", "shared_close": "'True'", "shared_destroy": "'False'",
    "private_open": "'True'", "private_write": "8", "private_awrite": "4", "private_read": "lpad(CAST(c AS VARCHAR), 8, ' ')", "private_aread": "'abcd'", "private_length": "12", "private_truncate": "10", "private_eof": "'True'", "private_wait": "'True'",
    "private_probe": "'True'", "private_stat": "'True'", "private_print_stats": "'2 2'", "file_length": "10", "private_close": "'None'", "private_delete": "'False'", "file_delete": "'True'", "file_stat": "'True'",
}


@query(sql_answers("(SELECT o_custkey AS c FROM orders WHERE o_orderkey = 3)", FILES))
def files_of_bytes(t: Tables) -> DataFrame:
    from gridloom.sources import storage

    call = OPERATIONS
    said = f"{t.table('orders').where('o_orderkey = 3').first().o_custkey:>8}".encode()
    f = call["shared_create"](t.spark, fresh(t, "file"))
    call["shared_write"](f, 100, said)
    out = [("shared_create", storage.exists(t.spark, f.path)), ("shared_read", call["shared_read"](f, 100, 8).decode()), ("shared_read_only", call["shared_read_only"](f).writable)]
    out += [(name, call[name](f)) for name in ("shared_wait", "shared_wait_all", "shared_fsync", "shared_close")]
    call["shared_destroy"](f)
    out.append(("shared_destroy", storage.exists(t.spark, f.path)))
    with tempfile.TemporaryDirectory() as folder:  # a private file is one process' own
        path = os.path.join(folder, "private")
        p = call["private_open"](path)
        out += [("private_open", os.path.exists(path)), ("private_write", call["private_write"](p, 0, said)), ("private_awrite", call["private_awrite"](p, 8, b"abcd"))]
        out += [("private_read", call["private_read"](p, 0, 8).decode()), ("private_aread", call["private_aread"](p, 8, 9).decode()), ("private_length", call["private_length"](p))]
        call["private_truncate"](p, 10)
        out.append(("private_truncate", call["private_length"](p)))
        try:
            call["private_read"](p, 50, 1)
        except EOFError as end:
            out.append(("private_eof", call["private_eof"](end)))
        stats = call["private_print_stats"](p)
        out += [("private_wait", call["private_wait"](p)), ("private_probe", call["private_probe"](p)), ("private_stat", call["private_stat"](folder)[0] > 0), ("private_print_stats", f"{stats['writes']} {stats['reads']}")]
        out += [("file_length", call["file_length"](t.spark, f"file://{path}")), ("file_stat", call["file_stat"](t.spark, f"file://{folder}")[0] > 0), ("private_close", call["private_close"](p))]
        open(path + "2", "w").close()
        out.append(("file_delete", call["file_delete"](t.spark, f"file://{path}2")))
        call["private_delete"](p)
        out.append(("private_delete", os.path.exists(path)))
    return answers(t, out)


# blobs
ND = "(SELECT max(doc_id) + 1 FROM documents)"
BLOB = "(SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS size FROM documents)"


@query("""SELECT doc_id AS i0, CASE WHEN doc_id = 4 THEN 5 WHEN c_name IS NOT NULL THEN octet_length(encode(c_name)) ELSE octet_length(encode(coalesce(text, ''))) END AS size,
CASE WHEN doc_id = 4 THEN md5('hello') WHEN c_name IS NOT NULL THEN md5(c_name) ELSE md5(coalesce(text, '')) END AS md5
FROM documents LEFT JOIN customer ON c_custkey + 10 = doc_id AND c_custkey < 20 WHERE doc_id NOT BETWEEN 50 AND 59""")
def blob_put(t: Tables) -> DataFrame:
    """An element assigned, a box put, another freed."""
    call, b = OPERATIONS, texts(t)
    new = t.table("customer").where("c_custkey < 20").select(F.col("c_custkey").alias("i0"), F.col("c_name").cast("binary").alias("data"))
    b = call["blob_put"](call["blob_assign_local_element"](b, [4], b"hello"), [10], [29], new)
    b = call["blob_free_local_element"](b, [50], [59])
    return b.df.select("i0", F.col("size").cast("long").alias("size"), F.md5("data").alias("md5"))


@query("SELECT doc_id AS i0, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size, CAST(0 AS BIGINT) AS n_other FROM documents")
def blob_memzero(t: Tables) -> DataFrame:
    other = F.length(F.replace(F.hex("data"), F.lit("00"), F.lit(""))).cast("long")
    return OPERATIONS["blob_memzero"](texts(t)).df.select("i0", F.col("size").cast("long").alias("size"), other.alias("n_other"))


BLOBS = {
    "blob_create": "n || ' 0'", "blob_distribution": "'([' || n // 4 || '], [' || 2 * n // 4 - 1 || '])'", "blob_get_dimension": "1", "blob_get_size": f"(SELECT sum(size) FROM {BLOB} WHERE doc_id BETWEEN n // 4 AND 3 * n // 4)",
    "blob_gather_size": f"(SELECT sum(size) FROM {BLOB} WHERE doc_id % 7 = 3)", "blob_access_element": f"(SELECT size FROM {BLOB} WHERE doc_id = 9)", "blob_debug": f"(SELECT count(*) || ' ' || n || ' ' || sum(size) FROM {BLOB})", "blob_destroy": "'None'",
}


@query(sql_answers(f"(SELECT {ND} AS n)", BLOBS))
def blob_metadata(t: Tables) -> DataFrame:
    call, b = OPERATIONS, texts(t)
    n = b.dims[0]
    made, total = call["blob_create"](t.engine, (n,)), call["blob_debug"](b).first()
    subs = t.table("documents").where("doc_id % 7 = 3").select(F.col("doc_id").alias("pos"), F.col("doc_id").alias("i0"))
    out = [("blob_create", f"{made.dims[0]} {made.df.count()}"), ("blob_distribution", call["blob_distribution"](b, 1)), ("blob_get_dimension", call["blob_get_dimension"](b)), ("blob_get_size", call["blob_get_size"](b, [n // 4], [3 * n // 4]))]
    out += [("blob_gather_size", call["blob_gather_size"](b, subs)), ("blob_access_element", len(call["blob_access_element"](b, [9]))), ("blob_debug", f"{total.assigned} {total.elements} {total.bytes}"), ("blob_destroy", call["blob_destroy"](b))]
    return answers(t, out)
