"""Token counts by separator scan.

Flat token files hold ids without any index; documents end at an end-of-document id. A file is read in blocks of a
fixed number of ids. In each block numpy finds the separators; a prefix scan over the blocks' summaries (how many
separators came before, where the last one was) stitches documents that cross blocks. Long files are scanned in two
levels, so that no task sees all blocks of a file.

Defined results: an empty document (two separators in a row) has 0 tokens; ids after the last separator of a file are an
unfinished document; an empty file has no documents; bytes at a file's end that make no whole id are no token. For documents, a null text counts as empty, and repeated rows and
null ids are counted like any others; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import as_bytes, map_rows, small_batches, table, written
from gridloom.llm.tokens import as_text, encoder

END = 50_256
BLOCK_IDS = 1 << 18
#: Blocks that one task of the prefix scan's first level covers.
SUPER = 4096


def flat_files(docs: DataFrame, place: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Blocks (file, block, ids as little-endian uint16) of one flat file per partition, and the order (file, ordinal, doc_id)."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("ids", pa.binary()), ("ordinals", pa.list_(pa.int64())), ("doc_ids", pa.list_(pa.int64()))])
        encode = encoder(place)
        parts: list[np.ndarray] = []
        size = block = ordinal = 0
        file = None

        def blocks(rest: bool):
            nonlocal parts, size, block
            if not parts or size < BLOCK_IDS and not rest:
                return
            flat = np.concatenate(parts)
            end = len(flat) if rest else len(flat) // BLOCK_IDS * BLOCK_IDS
            for s in range(0, end, BLOCK_IDS):
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((file, block, flat[s : min(end, s + BLOCK_IDS)].tobytes(), None, None), schema, strict=True)], schema=schema)
                block += 1
            parts, size = [flat[end:]], len(flat) - end

        for batch in batches:
            if not batch.num_rows:
                continue
            file = batch.column(2)[0].as_py()
            for text in batch.column(1):
                ids = encode(as_text(text.as_py())).astype("<u2")
                parts.append(np.append(ids, np.uint16(END)))
                size += len(ids) + 1
                yield from blocks(False)
            n = batch.num_rows
            order = [[file], [None], [None], [list(range(ordinal, ordinal + n))], [batch.column(0).to_pylist()]]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(order, schema, strict=True)], schema=schema)
            ordinal += n
        yield from blocks(True)

    small_batches(docs.sparkSession)
    source = docs.select("doc_id", as_bytes(), F.spark_partition_id().cast("long").alias("file"))
    stored = written(source.mapInArrow(run, "file long, block long, ids binary, ordinals array<long>, doc_ids array<long>"), "tokens", "zstd")
    order = stored.where(F.col("block").isNull()).select("file", F.explode(F.arrays_zip("ordinals", "doc_ids")).alias("x")).select("file", F.col("x.ordinals").alias("ordinal"), F.col("x.doc_ids").alias("doc_id"))
    return stored.where(F.col("block").isNotNull()).select("file", "block", "ids"), order


def blocks_of(files: DataFrame, width: int = 2) -> DataFrame:
    """Blocks of flat files; files: path and length, as the binaryFile source gives them (it then reads no content).

    Executors read the byte ranges of blocks, each by itself, so a file may have any length. The path is a URI that
    pyarrow's file systems open; file is the path."""
    size = BLOCK_IDS * width
    last = F.ceil(F.col("length") / size) - 1
    cut = files.where("length > 0").select(F.col("path").alias("file"), F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("block"))
    cut = cut.repartition(F.xxhash64("file", "block"))

    def rows(_, batch):
        from pyarrow import fs

        for path, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            uri = "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path
            system, own = fs.FileSystem.from_uri(uri)
            with system.open_input_file(own) as f:
                f.seek(block * size)
                yield [[path], [block], [f.read(size)]]

    return map_rows(cut, rows, "file string, block long, ids binary")


def scan(blocks: DataFrame, end: int = END, width: int = 2, block_ids: int = BLOCK_IDS) -> DataFrame:
    """file, ordinal, start, n_tokens, finished for every document of the blocks' files."""
    kind = np.dtype(f"<u{width}")

    def rows(_, batch):
        n, first, last, gaps, begins, at = [], [], [], [], [], []
        for ids, block in zip(batch.column(2), batch.column(1), strict=True):
            data = np.frombuffer(ids.as_py(), np.uint8)
            data = data[: len(data) // width * width].view(kind)
            seps = np.flatnonzero(data == end) + block.as_py() * block_ids
            n.append(len(seps))
            first.append(int(seps[0]) if len(seps) else None)
            last.append(int(seps[-1]) if len(seps) else None)
            gaps.append(seps)
            begins.append(np.append(-1, seps[:-1] + 1)[: len(seps)])  # the first start is known after the prefix scan
            at.append(block.as_py() * block_ids + len(data))
        yield [batch.column(0), batch.column(1), n, first, last, at, gaps, begins]

    kind_of_file = dict(blocks.dtypes)["file"]
    file = "file string" if kind_of_file == "string" else "file long"
    found = written(map_rows(blocks.select("file", "block", "ids"), rows, f"{file}, block long, n long, first long, last long, stop long, seps array<long>, begins array<long>"), "token-scan")
    slim = found.select("file", "block", "n", "last", "stop").withColumn("super", F.floor(F.col("block") / SUPER))
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    tops = slim.groupBy("file", "super").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    over = ahead(Window.partitionBy("file").orderBy("super"))
    tops = tops.select("file", "super", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("n0"), F.max("last").over(over).alias("last0"))
    inner = ahead(Window.partitionBy("file", "super").orderBy("block"))
    carry = slim.join(tops, ["file", "super"]).select(
        "file", "block", (F.col("n0") + F.coalesce(F.sum("n").over(inner), F.lit(0))).alias("ordinal0"), F.coalesce(F.greatest("last0", F.max("last").over(inner)), F.lit(-1)).alias("previous")
    )
    documents = found.where("n > 0").join(carry, ["file", "block"]).select("file", "ordinal0", "previous", F.posexplode(F.arrays_zip("begins", "seps")).alias("k", "x"))
    start = F.when(F.col("k") == 0, F.col("previous") + 1).otherwise(F.col("x.begins"))
    documents = documents.withColumn("stop", F.col("x.seps"))
    documents = documents.select("file", (F.col("ordinal0") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("stop") - start).alias("n_tokens"), F.lit(True).alias("finished"))
    ends = found.groupBy("file").agg(F.sum("n").alias("ordinal"), (F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("start"), F.max("stop").alias("stop"))
    open_end = ends.where("stop > start").select("file", "ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), F.lit(False).alias("finished"))
    return documents.unionAll(open_end)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, order = flat_files(table(spark, sf_dir, "documents"))
    return order.join(scan(blocks), ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal", "start")
