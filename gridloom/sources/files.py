"""Files of bytes: shared ones as rows (offset, bytes) in the cluster's file system, private ones of one process.

A write at an offset is one more numbered piece; a read lays the pieces over one another in the order of writing.
"""

from __future__ import annotations

import os
import shutil
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources import storage

PIECES = "seq long, offset long, bytes binary"


@dataclass
class SharedFile:
    spark: SparkSession
    path: str
    writable: bool = True
    stats: dict[str, int] = field(default_factory=lambda: {"writes": 0, "reads": 0, "bytes_written": 0, "bytes_read": 0})

    @property
    def data(self) -> str:
        return f"{self.path}/pieces"

    def pieces(self) -> DataFrame:
        if not storage.exists(self.spark, self.data):
            return self.spark.createDataFrame([], PIECES)
        return self.spark.read.schema(PIECES).parquet(self.data)

    def write_rows(self, rows: DataFrame) -> None:
        """(offset, bytes) rows, from executors; of pieces of one call that overlap, the one with the greater offset holds."""
        if not self.writable:
            raise PermissionError(f"{self.path} is read-only")
        last = self.pieces().agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]
        seq = max(last + 1, time.time_ns())  # writers at the same time don't share a number
        rows.select(F.lit(seq).cast("long").alias("seq"), F.col("offset").cast("long").alias("offset"), "bytes").write.mode("append").parquet(self.data)

    def write(self, offset: int, data: bytes) -> None:
        self.write_rows(self.spark.createDataFrame([(offset, bytearray(data))], "offset long, bytes binary"))
        self.stats["writes"] += 1
        self.stats["bytes_written"] += len(data)

    def overlapping(self, offset: int, size: int) -> DataFrame:
        return self.pieces().where((F.col("offset") < offset + size) & (F.col("offset") + F.length("bytes") > offset))

    def read(self, offset: int, size: int) -> bytes:
        """size bytes; what was never written is 0."""
        out = bytearray(size)
        for r in self.overlapping(offset, size).orderBy("seq", "offset").toLocalIterator():
            start, data = r["offset"] - offset, bytes(r["bytes"])
            skip = max(0, -start)
            part = data[skip : skip + size - max(0, start)]
            out[max(0, start) : max(0, start) + len(part)] = part
        self.stats["reads"] += 1
        self.stats["bytes_read"] += size
        return bytes(out)

    def length(self) -> int:
        return self.pieces().agg(F.coalesce(F.max(F.col("offset") + F.length("bytes")), F.lit(0))).first()[0]

    def read_only(self) -> SharedFile:
        return SharedFile(self.spark, self.path, False)

    def destroy(self) -> None:
        storage.delete(self.spark, self.path)

    def done(self, *_) -> bool:
        return True

    close = fsync = wait = wait_all = probe = done


def shared_file(spark: SparkSession, path: str, suffix: str = "") -> SharedFile:
    return SharedFile(spark, path + suffix)


class PrivateFile:
    """A file of one process, with reads and writes at offsets."""

    def __init__(self, path: str, mode: str = "rw") -> None:
        if mode not in ("r", "w", "rw"):
            raise ValueError(f"mode {mode!r}")
        flags = {"r": os.O_RDONLY, "w": os.O_WRONLY | os.O_CREAT, "rw": os.O_RDWR | os.O_CREAT}[mode]
        self.path, self.fd = path, os.open(path, flags, 0o644)
        self.stats = {"writes": 0, "reads": 0, "bytes_written": 0, "bytes_read": 0}

    def write(self, offset: int, data: bytes) -> int:
        done = 0
        while done < len(data):
            done += os.pwrite(self.fd, data[done:], offset + done)
        self.stats["writes"] += 1
        self.stats["bytes_written"] += done
        return done

    def read(self, offset: int, size: int) -> bytes:
        """Fewer bytes at the end of the file; EOFError beyond it."""
        out = os.pread(self.fd, size, offset)
        if size and not out:
            raise EOFError(f"offset {offset} of {self.path}")
        self.stats["reads"] += 1
        self.stats["bytes_read"] += len(out)
        return out

    write_async, read_async = write, read

    def truncate(self, size: int) -> None:
        os.ftruncate(self.fd, size)

    def length(self) -> int:
        return os.fstat(self.fd).st_size

    def fsync(self) -> None:
        os.fsync(self.fd)

    def close(self) -> None:
        os.close(self.fd)

    def delete(self) -> None:
        os.unlink(self.path)

    def wait(self, *_) -> bool:
        return True

    probe = wait

    @staticmethod
    def is_end(error: BaseException) -> bool:
        return isinstance(error, EOFError)


def local_space(path: str) -> tuple[int, str]:
    """Free bytes and the kind of file system of a local folder."""
    return shutil.disk_usage(path).free, "local"
