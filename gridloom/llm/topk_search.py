"""Exact top-k inner products by MaxScore.

Vectors are cut into shards; a shard keeps its postings by dimension, with the largest and smallest impact of each.
For a query, a term's bound is the most that its dimension can add to a score in the shard. Terms in order of bounds
are split in two: the essential ones, and those whose bounds together can't lift a document over the k-th score so far.
Essential postings are traversed, the other terms are probed only for documents that can still compete, and shards are
merged by rank.

Defined results: vectors that are null, empty or hold a null or a non-finite component take no part, nor do rows
without vec_id; a shorter vector counts as ended by zeros; rows with the query's own vec_id are no candidates; every
other row is a candidate, so repeated rows take a rank each; of several vectors of one id the smallest asks; fewer than k candidates
give all of them; scores beyond 64 bits are refused with an error.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import table, written

TOP = 5
QUERY_STEP = 50
SCALE = 256
#: Vectors of a shard and queries of a block, on average; their numbers follow the tables' sizes.
SHARD_ROWS = 8192
BLOCK_ROWS = 16_384
LEAST_SHARDS = 12
#: Documents whose essential postings are traversed at once.
WINDOW = 1024


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v (array<long>): floor(scale * x) of each component, for the vectors that take part."""
    whole = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0)
    big = float(1 << 62)
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    value = F.transform("embedding", lambda x: F.when(F.abs(x.cast("double") * scale) < big, F.floor(x.cast("double") * scale)).otherwise(F.raise_error(F.lit("component beyond 64 bits")).cast("long")))
    return vectors.where(whole & fine).select(F.col("vec_id").cast("long").alias("vec_id"), value.alias("v"))


def matrix(column) -> np.ndarray:
    """Rows of a list column as a matrix; shorter rows end in zeros."""
    lists = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy()[offsets[0] : offsets[-1]]
    lengths = np.diff(offsets)
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = values
    return out


def exact_kind(queries: np.ndarray, vectors: np.ndarray) -> type:
    """The fastest kind of number in which all scores are exact."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * queries.shape[1]
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object


def search_shard(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score) of each query's k best in the shard, ties to the smaller id."""
    width = max(queries.shape[1], vectors.shape[1])
    queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
    vectors = np.pad(vectors, ((0, 0), (0, width - vectors.shape[1])))
    kind = exact_kind(queries, vectors)
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    postings = np.ascontiguousarray(vectors[order].T.astype(kind))
    q = queries.astype(kind)
    windows = [(s, postings[:, s : s + WINDOW]) for s in range(0, len(ids), WINDOW)]
    high, low = postings.max(axis=1), postings.min(axis=1)
    bounds = np.maximum(q * high[None, :], q * low[None, :])  # the most that a term adds
    by_bound = np.argsort(-bounds, axis=1, kind="stable")
    out_q, out_v, out_s = [], [], []
    for i in range(len(q)):
        terms = by_bound[i]
        weights = q[i][terms]
        after = np.append(np.cumsum(bounds[i][terms][::-1])[::-1], 0)  # what the terms from here on add at most
        best_s, best_v, floor = np.empty(0, kind), np.empty(0, np.int64), None
        for start, window in windows:
            if floor is None:
                essential = width
            else:
                if after[0] < floor:
                    continue
                essential = max(1, int(np.argmax(after < floor)) if (after < floor).any() else width)
            score = weights[:essential] @ window[terms[:essential]]
            at = np.flatnonzero(score + after[essential] >= floor) if floor is not None else np.arange(window.shape[1])
            score, probe = score[at], essential
            while probe < width and len(at):
                step = min(width, probe + 8)
                score = score + weights[probe:step] @ window[terms[probe:step]][:, at]
                probe = step
                able = score + after[probe] >= floor
                at, score = at[able], score[able]
            if not len(at):
                continue
            found = ids[start + at]
            other = found != query_ids[i]
            best_s = np.concatenate((best_s, score[other]))
            best_v = np.concatenate((best_v, found[other]))
            if len(best_s) > k:
                if kind is not object and len(best_s) > 4 * k:
                    cut = np.partition(best_s, len(best_s) - k)[len(best_s) - k]
                    near = best_s >= cut
                    best_s, best_v = best_s[near], best_v[near]
                top = np.lexsort((best_v, -best_s))[:k]
                best_s, best_v = best_s[top], best_v[top]
            if len(best_s) == k:
                floor = best_s.min()
        out_q.append(np.full(len(best_v), query_ids[i]))
        out_v.append(best_v)
        out_s.append(np.array([int(x) for x in best_s], np.int64))
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


def top_k(queries: DataFrame, vectors: DataFrame, k: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score for tables of (vec_id, v), vectors with _row, a number of the row's own.

    Blocks of queries meet shards of vectors in pairs."""
    n, m = vectors.count(), queries.count()
    shards, blocks = max(LEAST_SHARDS, -(-n // SHARD_ROWS)), max(1, -(-m // BLOCK_ROWS))
    shard = F.pmod(F.xxhash64("vec_id", "_row", F.lit(1)), F.lit(shards))  # rows of one id are spread as well
    block = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks))
    left = queries.withColumn("block", block).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    right = vectors.withColumn("shard", shard).drop("_row").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def pair(a, b):
        import pyarrow as pa

        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        found = search_shard(a.column("vec_id").to_numpy(), matrix(a.column("v")), b.column("vec_id").to_numpy(), matrix(b.column("v")), k)
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in found], schema=schema)

    found = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(pair, "query_id long, vec_id long, score long")
    merged = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(merged)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_maxscore_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = written(quantised(table(spark, sf_dir, "embeddings")).withColumn("_row", F.monotonically_increasing_id()), "topk-vectors")
    asked = vectors.where(F.pmod("vec_id", F.lit(QUERY_STEP)) == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    return top_k(asked, vectors)


ORACLE_SQL = {
    "op10_maxscore_top_k": f"""
WITH parts AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
asked AS (SELECT vec_id, min(v) AS v FROM parts WHERE vec_id % {QUERY_STEP} = 0 GROUP BY vec_id),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, least(len(a.v), len(b.v)) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM asked a JOIN parts b ON a.vec_id <> b.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {TOP}"""
}
