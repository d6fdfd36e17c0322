"""Distributed prefix sums and numberings: no window ever runs over a whole table in one task.

Positions are cut into blocks of a fixed number of cells. A block is scanned by itself, one summary row per block goes
to the same scan one level up, and what was carried so far comes back by a join on the block. The number of levels
follows from the number of positions, so the last level always has at most one block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.plans.lineage import cut

#: Cells of a block: one task's window, and the factor by which a level shrinks.
BLOCK = 65_536


def block_of(k: Column, block: int = BLOCK) -> Column:
    return F.floor(k / block).cast("long")


def segmented_sums(rows: DataFrame, n: int, values: Sequence[str], block: int = BLOCK) -> DataFrame:
    """rows: k (0 <= k < n, unique), bit (a segment starts here), and value columns; adds, for each value, its running
    sum since the last bit (`sum_` + name, inclusive) and `seen`: whether any bit was set up to here.

    Rows that have `_blk`, the number of their block of k, are taken as they are dealt.
    """
    rows = rows if "_blk" in rows.columns else rows.withColumn("_blk", block_of(F.col("k"), block))
    upto = Window.partitionBy("_blk").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_seg", F.sum(F.col("bit").cast("long")).over(upto))
    within = Window.partitionBy("_blk", "_seg").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    local = local.withColumns({f"_in_{v}": F.sum(v).over(within) for v in values})
    if n <= block:
        return finished(local, values, None)
    # what a block hands on is the running sum at its end
    tails = local.groupBy("_blk").agg(F.max("bit").alias("bit"), *(F.max_by(f"_in_{v}", "k").alias(v) for v in values))
    above = segmented_sums(tails.withColumnRenamed("_blk", "k"), -(-n // block), values, block)
    carry = above.select((F.col("k") + 1).alias("_blk"), F.col("seen").alias("_seen"), *(F.col(f"sum_{v}").alias(f"_carry_{v}") for v in values))
    return finished(local.join(carry, "_blk", "left"), values, carry)


def finished(local: DataFrame, values: Sequence[str], carry: DataFrame | None) -> DataFrame:
    out = local.withColumn("seen", (F.col("_seg") > 0) | (F.coalesce("_seen", F.lit(False)) if carry is not None else F.lit(False)))
    for v in values:
        own = F.col(f"_in_{v}")
        carried = F.when(F.col("_seg") == 0, F.coalesce(f"_carry_{v}", F.lit(0))).otherwise(F.lit(0)) if carry is not None else F.lit(0)
        out = out.withColumn(f"sum_{v}", own + carried)
    return out.drop("_blk", "_seg", "_seen", *(f"_in_{v}" for v in values), *(f"_carry_{v}" for v in values))


def running_sums(rows: DataFrame, n: int, values: Sequence[str], block: int = BLOCK) -> DataFrame:
    """The same without segments: sums from position 0."""
    return segmented_sums(rows.withColumn("bit", F.col("k") == 0), n, values, block).drop("bit", "seen")


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "number", parts: int | None = None) -> DataFrame:
    """df with a number from 0 in the given order: range partitions, their counts summed ahead, and a number within each.

    A hot value of the leading key is split as far as later keys tell its rows apart.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = dealt.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_part").orderBy(*order)
    out = dealt.join(F.broadcast(starts), "_part")  # `parts` rows
    return out.withColumn(name, F.row_number().over(within) - 1 + F.col("_start")).drop("_part", "_start")
