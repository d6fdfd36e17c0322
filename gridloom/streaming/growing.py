"""Accumulates and puts that arrive as a stream.

Every micro-batch is reduced to one row per cell and written to a folder named after its number, so that a batch which
runs again replaces what it had written: each update counts once. The array at any time is its base with the batches
on top; compaction folds finished batches into a new base, which is kept beside the updates as a version with a record
of the last batch in it. Batches up to it no longer count, so a stop between any two steps neither loses nor repeats
updates, and a later session resumes from the record.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridloom.operators import access
from gridloom.operators.access import checked_subscripts
from gridloom.plans import versions
from gridloom.plans.engine import Array
from gridloom.sources import storage


@dataclass
class Growing:
    """An array of a real or integer type, and the folder of its updates."""

    base: Array
    path: str
    op: str = "acc"  # or put: the update with the greatest pos holds, later batches over earlier ones
    folded: int = -1  # the last batch that is in the base

    def __post_init__(self) -> None:
        if self.op not in ("acc", "put") or self.base.dtype.kind == "complex":
            raise ValueError(f"{self.op!r} of {self.base.dtype.name}")

    @property
    def updates(self) -> str:
        return f"{self.path.rstrip('/')}/updates"

    def schema(self) -> str:
        return ", ".join([*(f"{n} long" for n in self.base.index), "v double" if self.base.dtype.kind == "real" else "v long", "batch long"])

    def write_batch(self, rows: DataFrame, batch: int) -> None:
        """rows: subscripts, v and, for puts, pos."""
        v = F.col("v").cast("double" if self.base.dtype.kind == "real" else "long")
        keyed = checked_subscripts(self.base, rows).groupBy(*self.base.index)
        once = keyed.agg((F.sum(v) if self.op == "acc" else F.max_by(v, F.col("pos"))).alias("v"))
        once.write.mode("overwrite").parquet(f"{self.updates}/batch={batch}")

    def follow(self, stream: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        """Start taking updates from a streaming DataFrame."""
        return stream.writeStream.foreachBatch(self.write_batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def pending(self) -> DataFrame:
        spark = self.base.engine.spark
        if not storage.exists(spark, self.updates):
            return spark.createDataFrame([], self.schema())
        return spark.read.schema(self.schema()).option("basePath", self.updates).parquet(self.updates).where(F.col("batch") > self.folded)

    def current(self, upto: int | None = None) -> Array:
        """The array with all batches, or those up to a number."""
        rows = self.pending()
        rows = rows if upto is None else rows.where(F.col("batch") <= upto)
        if self.op == "acc":
            return access.scatter_acc(self.base, rows)
        return access.scatter(self.base, rows.withColumnRenamed("batch", "pos"))

    def compact(self, upto: int) -> Growing:
        """Fold batches up to a number into the base; their folders go once the new base is written and recorded."""
        spark = self.base.engine.spark
        done = [r["batch"] for r in self.pending().where(F.col("batch") <= upto).select("batch").distinct().collect()]  # one row for each batch
        last = max([self.folded, *done])
        df = versions.commit(spark, self.kept, self.current(upto).df, {"folded": last, "op": self.op})
        for batch in done:
            storage.delete(spark, f"{self.updates}/batch={batch}")
        return Growing(self.base.with_df(df), self.path, self.op, last)

    @property
    def kept(self) -> str:
        return f"{self.path.rstrip('/')}/base"

    def resumed(self) -> Growing:
        """With the base that the last compaction recorded, if there was any: how a new session goes on."""
        try:
            df, said = versions.latest(self.base.engine.spark, self.kept)
        except ValueError:
            return self
        return Growing(self.base.with_df(df), self.path, said["op"], said["folded"])
