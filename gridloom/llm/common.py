"""Helpers that the operators of this subpackage share.

Tables that cut a plan's lineage are written as Parquet under the folder that the cluster names in
``spark.checkpoint.dir``, which every executor and the driver can read.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one Arrow batch holds at most, so that a batch of very long texts stays small.
BATCH_ROWS = "512"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only where it is unset and the master is local (tests) a temporary one is made."""
    place = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it again: the lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gridloom_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that written() gave, once nothing that is still to run reads them."""
    for df in tables:
        at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._gridloom_path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, fn: Callable[..., Iterator], schema: str, *, once: Callable | None = None) -> DataFrame:
    """mapInArrow with small batches. fn(state, batch) yields lists of columns; once() makes the state of a task."""
    small_batches(df.sparkSession)
    out = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = once() if once else None
        for batch in batches:
            if batch.num_rows:
                for columns in fn(state, batch):
                    yield pa.RecordBatch.from_arrays([as_array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    return df.mapInArrow(run, schema)


def small_batches(spark: SparkSession) -> None:
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > int(BATCH_ROWS):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def as_array(column, kind: pa.DataType) -> pa.Array:
    if isinstance(column, (pa.Array, pa.ChunkedArray)):
        return column.cast(kind) if column.type != kind else column
    return pa.array(column, kind)


ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<float>": pa.list_(pa.float32())}


def to_arrow(schema: str) -> pa.Schema:
    pairs = [part.strip().split(" ", 1) for part in schema.split(",")]
    return pa.schema([(name, ARROW[kind.strip()]) for name, kind in pairs])


def as_bytes(column: str = "text"):
    """The text as UTF-8 bytes; a null text counts as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b"")).alias(column)


def id_text_crc(column: str = "doc_id"):
    """crc32 of the id as text; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary"))
