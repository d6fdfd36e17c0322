"""Every operation by name: what a caller of a block-distributed array library looks up, and what does it here.

Whole-array and box forms are one function with an optional box. Operations that order or guard writes in place have no
effect here, since arrays are immutable and plans are lazy: they map to `nothing`. Non-blocking forms return a plan.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from gridloom.functions import dtypes, index
from gridloom.operators import access, blobs, dense, halo, reduce, scans, sparse
from gridloom.operators import elementwise as ew
from gridloom.plans import layout
from gridloom.plans.engine import Array, Builder, Engine
from gridloom.plans.lineage import cut
from gridloom.plans.prefix import numbered
from gridloom.sources import disk_arrays, files, storage, text


def nothing(*_, **__) -> None:
    """Nothing to wait for, to release or to guard."""


def done(*_, **__) -> bool:
    return True


def materialised(plan: DataFrame) -> DataFrame:
    """Wait for a plan: its rows are written and read again."""
    return cut(plan, "waited")


def periodic(a: Array, lo, hi, op: str = "get", values=None, alpha=1):
    if op == "get":
        return access.periodic_get(a, lo, hi)
    if op == "put":
        return access.periodic_put(a, lo, hi, values)
    if op == "acc":
        return access.periodic_acc(a, lo, hi, values, alpha)
    raise ValueError(f"periodic takes get, put or acc, not {op!r}")


def property_set(a: Array, name: str) -> Array:
    if name not in ("read_only", "read_cache"):
        raise ValueError(f"property {name!r}")
    return a.cached()


def block_info(a: Array) -> tuple[list[int], list[list[int]]]:
    """Blocks by dimension, and the first index of each."""
    return a.layout.n_blocks, [list(s) for s in a.layout.starts]


def owners(a: Array, lo, hi) -> int:
    return len({owner for _, owner in a.layout.region(a.box(lo, hi))})


def blocks_met(a: Array, lo, hi) -> int:
    return len(a.layout.region(a.box(lo, hi)))




CREATION: dict[str, Callable] = {
    "create": Engine.create, "create_config": Engine.create, "create_irreg": Builder.set_irregular, "create_irreg_config": Builder.set_irregular,
    "create_ghosts": Engine.create, "create_ghosts_config": Engine.create, "create_ghosts_irreg": Builder.set_irregular, "create_ghosts_irreg_config": Builder.set_irregular,
    "create_handle": Engine.builder, "set_data": Builder.set_data, "set_chunk": Builder.set_chunk, "set_array_name": Builder.set_name, "get_array_name": lambda a: a.name,
    "set_pgroup": Builder.set_group, "get_pgroup": lambda a: a.group, "get_pgroup_size": Engine.group_size, "set_ghosts": Builder.set_ghosts,
    "set_ghost_corner_flag": Builder.set_ghosts, "set_irreg_distr": Builder.set_irregular, "set_irreg_flag": nothing, "set_block_cyclic": Builder.set_block_cyclic,
    "set_block_cyclic_proc_grid": Builder.set_block_cyclic, "set_tiled_proc_grid": Builder.set_block_cyclic, "set_tiled_irreg_proc_grid": Builder.set_tiled_irregular,
    "set_restricted": Builder.set_restricted, "set_restricted_range": lambda b, lo, hi: b.set_restricted(range(lo, hi + 1)), "set_property": property_set,
    "unset_property": Array.uncached, "set_memory_dev": nothing, "set_memory_limit": lambda e, n: setattr(e, "memory_limit", n), "allocate": Builder.allocate,
    "deallocate": Array.uncached, "overlay": Engine.overlay, "duplicate": Array.like, "destroy": Engine.destroy, "register_type": Engine.register_type,
    "deregister_type": Engine.deregister_type, "type_f2c": dtypes.as_dtype, "type_c2f": lambda d: {v: k for k, v in reversed(dtypes.ALIASES.items())}.get(dtypes.as_dtype(d).name, dtypes.as_dtype(d).name),
}

METADATA: dict[str, Callable] = {
    "inquire": lambda a: a.schema, "inquire_type": lambda a: a.dtype.name, "inquire_name": lambda a: a.name, "ndim": lambda a: a.ndim, "get_dimension": lambda a: a.ndim,
    "has_ghosts": lambda a: a.has_ghosts, "is_mirrored": lambda a: a.hint == "read_only", "valid_handle": Engine.valid, "verify_handle": Engine.valid, "check_handle": Engine.check,
    "uses_proc_grid": lambda a: a.layout.kind in ("scalapack", "tiled", "tiled_irreg"), "uses_irreg_proc_grid": lambda a: a.layout.kind == "tiled_irreg",
    "get_distribution_type": lambda a: a.layout.kind, "get_block_info": block_info, "total_blocks": lambda a: a.layout.total_blocks, "nblock": lambda a: a.layout.n_blocks,
    "get_proc_grid": lambda a: list(a.layout.grid), "get_proc_index": lambda a, p: a.layout.coordinates(p), "proc_topology": lambda a, p: a.layout.coordinates(p),
    "get_map_info": lambda a: [list(s) for s in a.layout.starts], "distribution": lambda a, p: a.layout.process_box(p), "compare_distr": lambda a, b: a.layout == b.layout,
    "locate": lambda a, at: a.layout.locate(at), "locate_region": lambda a, lo, hi: a.layout.region(a.box(lo, hi)), "locate_nnodes": owners, "locate_num_blocks": blocks_met,
}

ACCESS: dict[str, Callable] = {
    "get": access.get, "put": access.put, "acc": access.acc, "nbget": access.nb_get, "nbput": access.nb_put, "nbacc": access.nb_acc, "nbwait": materialised, "nbtest": done,
    "nbput_notify": access.put_notify, "nbwait_notify": nothing, "get_field": access.get_field, "put_field": access.put_field, "nbget_field": access.nb_get_field,
    "nbput_field": access.nb_put_field, "strided_get": access.strided_get, "strided_put": access.strided_put, "strided_acc": access.strided_acc, "periodic": periodic,
    "gather": access.gather, "scatter": access.scatter, "scatter_acc": access.scatter_acc, "gather2d": access.gather, "scatter2d": access.scatter, "scatter_acc2d": access.scatter_acc,
    "alloc_gatscat_buf": nothing, "free_gatscat_buf": nothing, "read_inc": access.read_inc, "access_ptr": access.map_blocks, "access_idx": access.map_blocks,
    "access_block_ptr": access.block, "access_block_idx": access.block, "access_block_grid_ptr": access.block_at, "access_block_grid_idx": access.block_at,
    "access_block_segment_ptr": access.segment, "access_block_segment_idx": access.segment,
    **dict.fromkeys(("release", "release_update", "release_block", "release_update_block", "release_block_grid", "release_update_block_grid", "release_block_segment", "release_update_block_segment"), nothing),
}

ELEMENTWISE: dict[str, Callable] = {
    "zero": ew.zero, "zero_patch": ew.zero, "fill": ew.fill, "fill_patch": ew.fill, "scale": ew.scale, "scale_patch": ew.scale, "abs_value": ew.abs_value, "abs_value_patch": ew.abs_value,
    "add_constant": ew.add_constant, "add_constant_patch": ew.add_constant, "recip": ew.recip, "recip_patch": ew.recip, "randomize": ew.randomize, "rand": Engine.rand,
    "patch_enum": ew.patch_enum, "copy": ew.copy, "copy_patch": ew.copy_patch, "copy_patch_dp": ew.copy_patch, "add": ew.add, "add_patch": ew.add,
    "elem_multiply": ew.elem_multiply, "elem_multiply_patch": ew.elem_multiply, "elem_divide": ew.elem_divide, "elem_divide_patch": ew.elem_divide,
    "elem_maximum": ew.elem_maximum, "elem_maximum_patch": ew.elem_maximum, "elem_minimum": ew.elem_minimum, "elem_minimum_patch": ew.elem_minimum,
    "elem_step_divide_patch": ew.elem_step_divide, "elem_stepb_divide_patch": ew.elem_stepb_divide, "step_mask_patch": ew.step_mask, "median": ew.median, "median_patch": ew.median,
}

REDUCTIONS: dict[str, Callable] = {
    "dot": reduce.dot, "dot_patch": reduce.dot, "ddot_patch_dp": reduce.dot, "norm1": reduce.norm1, "norm_infinity": reduce.norm_infinity, "select_elem": reduce.select_elem,
    "step_max": reduce.step_max, "step_max_patch": reduce.step_max, "step_bound_info": reduce.step_bound_info, "step_bound_info_patch": reduce.step_bound_info,
    "gop": reduce.global_op, "pgroup_gop": reduce.global_op, "brdcst": reduce.broadcast_from, "pgroup_brdcst": reduce.broadcast_from, "msg_brdcst": reduce.broadcast_from,
    "merge_mirrored": reduce.merge_mirrored, "merge_distr_patch": reduce.merge_distr_patch, "num_nonzeros": reduce.num_nonzeros,
}

SCANS: dict[str, Callable] = {
    "scan_add": scans.scan_add, "scan_copy": scans.scan_copy, "pack": scans.pack, "unpack": scans.unpack, "bin_index": scans.bin_index, "bin_sorter": scans.bin_sorter,
    "create_bin_range": scans.bin_range, "bin_counts": scans.bin_counts, "sort_permutation": numbered, "shared_counter": access.tickets,
}

ALGEBRA: dict[str, Callable] = {
    "matmul": dense.matmul, "matmul_patch": dense.matmul_patch, "matmul_patch_alt": dense.matmul_patch_alt, "matmul_basic": dense.matmul_basic, "matmul_mirrored": dense.matmul_mirrored,
    "transpose": dense.transpose, "symmetrize": dense.symmetrize, "get_diag": dense.get_diag, "set_diagonal": dense.set_diagonal, "add_diagonal": dense.add_diagonal,
    "shift_diagonal": dense.shift_diagonal, "zero_diagonal": dense.zero_diagonal, "scale_rows": dense.scale_rows, "scale_cols": dense.scale_cols, "lu_solve": dense.lu_solve,
    "lu_solve_alt": dense.lu_solve_alt, "lu_solve_seq": dense.lu_solve_seq, "llt_solve": dense.llt_solve, "solve": dense.solve, "spd_invert": dense.spd_invert, "diag": dense.diag,
    "diag_reuse": dense.diag_reuse, "diag_seq": dense.diag_seq, "diag_std": dense.diag_std, "diag_std_seq": dense.diag_std_seq, "cholesky": dense.cholesky,
    "zero_triangle": dense.zero_triangle, "mirror_triangle": dense.mirror_triangle,
}

GHOSTS: dict[str, Callable] = {
    "update_ghosts": halo.update_ghosts, "update_ghosts_nb": halo.update_ghosts, "update_ghost_dir": halo.update_ghost_dir, "nbget_ghost_dir": halo.nb_get_ghost_dir,
    "get_ghost_block": halo.get_ghost_block, "access_ghost_ptr": halo.ghost_block, "access_ghosts": halo.ghost_block, "access_ghost_element": halo.ghost_element,
    "access_ghost_element_ptr": halo.ghost_element,
    **dict.fromkeys(("release_ghosts", "release_update_ghosts", "release_ghost_element", "release_update_ghost_element", "ghost_barrier", "set_ghost_info", "set_update4_info", "set_update5_info"), nothing),
    **dict.fromkeys((f"update{k}_ghosts" for k in (1, 2, 3, 4, 44, 5, 55, 6, 7)), halo.update_ghosts),
}

SPARSE: dict[str, Callable] = {
    "sprs_array_create": sparse.create, "sprs_array_add_element": sparse.add_elements, "sprs_array_assemble": sparse.assemble, "sprs_array_create_from_dense": sparse.from_dense,
    "sprs_array_create_from_sparse": sparse.to_dense, "sprs_array_duplicate": sparse.duplicate, "sprs_array_destroy": sparse.destroy, "sprs_array_export": sparse.export,
    "sprs_array_row_distribution": sparse.row_distribution, "sprs_array_column_distribution": sparse.column_distribution, "sprs_array_col_block_list": sparse.column_blocks,
    "sprs_array_access_col_block": sparse.compressed_rows, "sprs_array_access_col_block_idx": sparse.compressed_rows, "sprs_array_get_block": sparse.get_block,
    "sprs_array_get_column": sparse.get_column, "sprs_array_get_diag": sparse.get_diag, "sprs_array_diag_left_multiply": sparse.diag_left_multiply,
    "sprs_array_diag_right_multiply": sparse.diag_right_multiply, "sprs_array_shift_diag": sparse.shift_diag, "sprs_array_scale": sparse.scale,
    "sprs_array_matvec_multiply": sparse.matvec_multiply, "sprs_array_matmat_multiply": sparse.matmat_multiply, "sprs_array_sprsdns_multiply": sparse.sparse_dense_multiply,
    "sprs_array_dnssprs_multiply": sparse.dense_sparse_multiply, "sprs_array_count_sketch": sparse.count_sketch, "sprs_array_num_nonzeros": sparse.num_nonzeros, "sprs_array_load": sparse.load,
}

EXECUTION: dict[str, Callable] = {
    "initialize": Engine, "initialize_comm": Engine, "initialize_ltd": lambda spark, limit: Engine(spark, memory_limit=limit), "initialized": lambda e: isinstance(e, Engine), "terminate": Engine.terminate,
    **dict.fromkeys(("sync", "pgroup_sync", "msg_sync", "msg_pgroup_sync", "mask_sync", "fence", "init_fence"), nothing),
    "create_mutexes": Engine.create_mutexes, "destroy_mutexes": Engine.destroy_mutexes, "lock": Engine.lock, "unlock": Engine.unlock, "pgroup_create": Engine.create_group,
    "pgroup_destroy": Engine.destroy_group, "pgroup_duplicate": Engine.duplicate_group, "pgroup_self": Engine.self_group, "pgroup_split": Engine.split_group,
    "pgroup_split_irreg": Engine.split_group_by, "pgroup_set_default": Engine.set_default_group, "pgroup_get_default": lambda e: e.default_group, "pgroup_get_mirror": Engine.mirror_group,
    "pgroup_get_world": Engine.world_group, "pgroup_nodeid": Engine.rank_in, "pgroup_nnodes": Engine.group_size, "pgroup_absolute_id": Engine.absolute_id, "nodeid": lambda e: 0,
    "nnodes": lambda e: e.n_processes, "list_nodeid": lambda e: list(range(e.n_processes)), "cluster_nnodes": lambda e: len(e.cluster()), "cluster_nodeid": lambda e: 0,
    "cluster_nprocs": lambda e, node: len(e.cluster()[node]), "cluster_procid": lambda e, node, k: e.cluster()[node][k], "cluster_proc_nodeid": lambda e, p: p // e.per_node,
    "uses_ma": lambda e: False, "memory_limited": lambda e: e.memory_limited, "memory_avail": Engine.memory_available, "memory_avail_type": Engine.memory_available,
    "inquire_memory": Engine.memory_used, "malloc": lambda n: bytearray(n), "free": nothing, "set_debug": lambda e, on: setattr(e, "debug", bool(on)), "get_debug": lambda e: e.debug,
    "timer": time.perf_counter, "wtime": Engine.wall_time, "version": Engine.version, "error": Engine.error, "comp_patch": index.same_shape, "patch_intersect": index.intersect,
    "checkpoint_arrays": Engine.save, "recover_arrays": Engine.recover, "trace_genrec": Engine.traced, "trace": Engine.trace, "process_grid": layout.process_grid,
}

TEXT: dict[str, Callable] = {
    "print": text.print_patch, "print_file": text.print_file, "print_patch": text.print_patch, "print_patch_file": text.print_file, "print_patch2d": text.print_patch,
    "print_patch_file2d": text.print_file, "print_distribution": text.distribution, "print_stats": text.stats, "summarize": Engine.summary,
}

DISK: dict[str, Callable] = {
    "disk_create": disk_arrays.create, "disk_open": disk_arrays.open_array, "disk_close": disk_arrays.close, "disk_delete": disk_arrays.delete, "disk_inquire": disk_arrays.inquire,
    "disk_write": disk_arrays.write, "disk_read": disk_arrays.read, "disk_write_section": disk_arrays.write_section, "disk_read_section": disk_arrays.read_section,
    "disk_probe": disk_arrays.probe, "disk_wait": disk_arrays.wait, "disk_create_config": disk_arrays.create, "disk_set_default_config": disk_arrays.set_default_config,
    "disk_set_debug": disk_arrays.set_debug, "disk_print_internals": disk_arrays.internals,
}

FILES: dict[str, Callable] = {
    "shared_create": files.shared_file, "shared_open": files.shared_file, "shared_destroy": files.SharedFile.destroy, "shared_read_only": files.SharedFile.read_only,
    "shared_close": files.SharedFile.close, "shared_fsync": files.SharedFile.fsync, "shared_write": files.SharedFile.write, "shared_read": files.SharedFile.read,
    "shared_wait": files.SharedFile.wait, "shared_wait_all": files.SharedFile.wait_all, "private_open": files.PrivateFile, "private_close": files.PrivateFile.close,
    "private_write": files.PrivateFile.write, "private_awrite": files.PrivateFile.write_async, "private_read": files.PrivateFile.read, "private_aread": files.PrivateFile.read_async,
    "private_wait": files.PrivateFile.wait, "private_probe": files.PrivateFile.probe, "private_delete": files.PrivateFile.delete, "private_stat": files.local_space,
    "private_eof": files.PrivateFile.is_end, "private_truncate": files.PrivateFile.truncate, "private_length": files.PrivateFile.length, "private_print_stats": lambda f: dict(f.stats),
    "file_length": storage.length, "file_delete": storage.delete, "file_stat": storage.free_space,
}

BLOBS: dict[str, Callable] = {
    "blob_create": blobs.create, "blob_distribution": blobs.distribution, "blob_assign_local_element": blobs.assign, "blob_free_local_element": blobs.free, "blob_memzero": blobs.zeroed,
    "blob_get_size": blobs.get_size, "blob_get": blobs.get, "blob_put": blobs.put, "blob_gather_size": blobs.gather_size, "blob_gather": blobs.gather, "blob_scatter": blobs.scatter,
    "blob_destroy": blobs.destroy, "blob_access_element": blobs.element, "blob_release_element": nothing, "blob_release_update_element": nothing, "blob_debug": blobs.summary, "blob_get_dimension": lambda b: b.ndim,
}

OPERATIONS: dict[str, Callable] = CREATION | METADATA | ACCESS | ELEMENTWISE | REDUCTIONS | SCANS | ALGEBRA | GHOSTS | SPARSE | EXECUTION | TEXT | DISK | FILES | BLOBS


def operation(name: str) -> Callable:
    try:
        return OPERATIONS[name]
    except KeyError:
        raise ValueError(f"no operation {name!r}") from None
