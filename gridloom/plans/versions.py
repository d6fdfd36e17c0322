"""Tables in versions: a version's rows are written to a folder of its own, and a small record then names it.

A reader sees the last record, so a writer that fails halfway leaves the version before. The folder isn't scratch: it
stays when spark.checkpoint.dir is cleared, and a new session finds the record.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gridloom.sources import storage


def record(path: str) -> str:
    return f"{path.rstrip('/')}/version.json"


def commit(spark: SparkSession, path: str, df: DataFrame, more: dict) -> DataFrame:
    """Write df as the new version and give it as read again; the version before goes once the record names the new one."""
    before = storage.read_json(spark, record(path)) if storage.exists(spark, record(path)) else None
    folder = f"{path.rstrip('/')}/version-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    storage.write_json(spark, f"{record(path)}.new", more | {"folder": folder, "schema": df.schema.json()})
    storage.delete(spark, record(path))
    storage.rename(spark, f"{record(path)}.new", record(path))
    if before:
        storage.delete(spark, before["folder"])
    return spark.read.schema(df.schema).parquet(folder)


def latest(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    import json

    from pyspark.sql.types import StructType

    at = record(path)
    if not storage.exists(spark, at):  # a writer stopped between two steps: the new record is whole
        at = f"{at}.new"
    if not storage.exists(spark, at):
        raise ValueError(f"nothing was saved at {path}")
    said = storage.read_json(spark, at)
    return spark.read.schema(StructType.fromJson(json.loads(said["schema"]))).parquet(said["folder"]), said
