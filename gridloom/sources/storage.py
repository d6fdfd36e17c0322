"""Small files and folders of the cluster's file system, by the file system that a path names."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.delete(at, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, at = file_system(spark, old)
    _, to = file_system(spark, new)
    if not fs.rename(at, to):
        raise OSError(f"{old} can't be moved to {new}")


def length(spark: SparkSession, path: str) -> int:
    fs, at = file_system(spark, path)
    return fs.getContentSummary(at).getLength()


def free_space(spark: SparkSession, path: str) -> tuple[int, str]:
    """Bytes left, and the file system's scheme."""
    fs, _ = file_system(spark, path)
    return fs.getStatus().getRemaining(), fs.getScheme()


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    fs, at = file_system(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(json.dumps(value).encode()))
    finally:
        out.close()


def read_json(spark: SparkSession, path: str) -> dict:
    rows = spark.read.text(path, wholetext=True).collect()  # one small file
    return json.loads(rows[0][0])


def joined(spark: SparkSession, folder: str, to: str) -> None:
    """The part files of a folder, in order of name, as one file; bytes are copied as streams, in pieces."""
    fs, at = file_system(spark, folder)
    target, to_at = file_system(spark, to)
    parts = sorted((x.getPath() for x in fs.listStatus(at) if x.getPath().getName().startswith("part-")), key=lambda x: x.getName())
    target.delete(to_at.getParent(), True)
    out = target.create(to_at, True)
    try:
        for part in parts:
            given = fs.open(part)
            try:
                spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes(given, out, 1 << 16, False)
            finally:
                given.close()
    finally:
        out.close()
