"""Mixing sources to target weights.

Every document gets a hash-random key. A source is range-sorted by it: equal ranges of the key are its buckets, sums of
sizes over the buckets and then within a bucket make a distributed prefix sum, and the source is cut where that sum
meets its budget. A budget above the source's size repeats whole epochs first.

Defined results: a null text has size 0; a null source is a source of its own, ordered last; documents of size 0 and
sources of total 0 take 0; repeated rows follow one another in the order; an empty table gives no rows. Columns of the
input may have any names: they travel in one struct, apart from the operator's own.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import WORD, table, written

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
#: Documents that share a bucket of the key's range, on average; the number of buckets follows the table's size.
BUCKET_ROWS = 20_000
#: Buckets whose sums one task of the prefix sum's first level takes.
RUN_BUCKETS = 4096
SEED = 20_240_229
KEY_BITS = 60


def numbered(sources: DataFrame, most: int = 50_000) -> DataFrame:
    """_mix_rank: the place of a source by code point, null last; ranges are ranked apart and then joined."""
    parts = max(1, -(-sources.count() // most))
    dealt = sources.repartitionByRange(parts, F.col("source").asc_nulls_last()).withColumn("_mix_part", F.spark_partition_id())
    dealt = written(dealt, "mix-ranges")
    before = Window.orderBy("_mix_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_mix_part").count().select("_mix_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_mix_start"))
    within = Window.partitionBy("_mix_part").orderBy(F.col("source").asc_nulls_last())
    return dealt.join(starts, "_mix_part").select("source", "_mix_total", (F.row_number().over(within) - 1 + F.col("_mix_start")).alias("_mix_rank"))


def shares(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Targets: all sizes shared by weight, none above MOST_EPOCHS times its source, the excess shared again.

    Water-filling on exact sums: each round sends four numbers to the driver.
    """
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.col("_mix_rank") % len(weights) + 1).cast("int"))
    ranked = written(numbered(sources).withColumn("_mix_weight", pick.cast("long")), "mix-sources")
    total = int(ranked.agg(F.sum("_mix_total")).first()[0] or 0)
    level, last = Fraction(0), -1
    while True:
        # a source stops at its limit if level * weight passes it
        full = F.col("_mix_total") * MOST_EPOCHS * F.lit(level.denominator).cast("decimal(38,0)") <= F.col("_mix_weight") * F.lit(level.numerator).cast("decimal(38,0)") if last >= 0 else F.lit(False)
        n, held, free = ranked.agg(F.sum(F.when(full, 1).otherwise(0)), F.sum(F.when(full, F.col("_mix_total")).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("_mix_weight")))).first()
        if not free or n == last:
            break
        last, level = n, Fraction(total - MOST_EPOCHS * int(held), int(free))
    limit = F.col("_mix_total") * MOST_EPOCHS
    return ranked.select("source", "_mix_total", F.least(limit.cast("double"), F.col("_mix_weight") * F.lit(level.numerator / level.denominator)).alias("_mix_target"))


def sized(docs: DataFrame, *more) -> DataFrame:
    """doc_id, source, _mix_size and further columns of the operator's own: nothing of the input can clash with them."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    return docs.select("doc_id", "source", size.alias("_mix_size"), *more)


def random_key():
    """KEY_BITS bits of a hash of id and size (which spreads rows without an id): one that SQL engines agree on."""
    said = F.concat_ws(":", F.lit(SEED).cast("string"), F.col("doc_id").cast("string"), F.col("_mix_size").cast("string"))
    return F.conv(F.substring(F.md5(said.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def started(sums: DataFrame) -> DataFrame:
    """_mix_start: what the buckets of a group before a bucket hold. In two levels: over runs of RUN_BUCKETS, and within one."""
    ahead = lambda w: F.coalesce(F.sum("_mix_sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("_mix_run", F.floor(F.col("_mix_bucket") / RUN_BUCKETS))
    runs = sums.groupBy("_mix_group", "_mix_run").agg(F.sum("_mix_sum").alias("_mix_sum"))
    runs = runs.select("_mix_group", "_mix_run", ahead(Window.partitionBy("_mix_group").orderBy("_mix_run")).alias("_mix_above"))
    within = sums.withColumn("_mix_below", ahead(Window.partitionBy("_mix_group", "_mix_run").orderBy("_mix_bucket")))
    return within.join(runs, ["_mix_group", "_mix_run"]).select("_mix_group", "_mix_bucket", (F.col("_mix_above") + F.col("_mix_below")).alias("_mix_start"))


def mix(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """rows (as sized() gives them) with _mix_total (the source's), _mix_target, _mix_taken, _mix_epochs and _mix_part."""
    slim = rows.groupBy("source").agg(F.sum("_mix_size").alias("_mix_total"), F.count(F.lit(1)).alias("_mix_n"))
    sources = written(slim, "mix-totals")
    n_rows = int(sources.agg(F.sum("_mix_n")).first()[0] or 0)
    goals = shares(sources.drop("_mix_n"), weights)
    goals = goals.select(F.col("source").alias("_mix_source"), "_mix_total", "_mix_target", F.floor("_mix_target").alias("_mix_budget"))
    buckets = max(1, -(-n_rows // BUCKET_ROWS))
    group = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))  # a join key without nulls
    keyed = rows.withColumn("_mix_key", random_key()).withColumn("_mix_group", group).withColumn("_mix_bucket", F.floor(F.col("_mix_key") / float(1 << KEY_BITS) * buckets))
    sums = keyed.groupBy("_mix_group", "_mix_bucket").agg(F.sum("_mix_size").alias("_mix_sum"))
    starts = started(sums)
    goals = goals.withColumn("_mix_group", F.when(F.col("_mix_source").isNull(), "n").otherwise(F.concat(F.lit("s"), "_mix_source"))).drop("_mix_source")
    joined = keyed.join(starts.join(goals, "_mix_group"), ["_mix_group", "_mix_bucket"])
    ties = [c for c in ("_mix_tie",) if c in rows.columns]
    within = Window.partitionBy("_mix_group", "_mix_bucket").orderBy("_mix_key", "doc_id", "_mix_size", *ties).rowsBetween(Window.unboundedPreceding, -1)
    prefix = F.col("_mix_start") + F.coalesce(F.sum("_mix_size").over(within), F.lit(0))
    epochs = F.when(F.col("_mix_total") > 0, F.expr("_mix_budget div _mix_total")).otherwise(F.lit(0).cast("long"))
    rest = F.col("_mix_budget") - epochs * F.col("_mix_total")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("_mix_size"), rest - prefix))
    return joined.select(*rows.columns, "_mix_total", "_mix_target", (epochs * F.col("_mix_size") + part).alias("_mix_taken"), epochs.alias("_mix_epochs"), part.alias("_mix_part"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mix itself, with the columns of docs: a row per epoch that takes a document, cut to the words it takes."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_mix_row")
    out = mix(sized(docs, F.xxhash64("text").alias("_mix_tie"), row), weights).where(F.col("_mix_size") > 0)
    whole = F.array_repeat("_mix_size", F.col("_mix_epochs").cast("int"))
    copies = F.when(F.col("_mix_part") > 0, F.array_append(whole, F.col("_mix_part"))).otherwise(whole)
    out = out.select("_mix_row", "_mix_size", F.explode(copies).alias("_mix_words"))
    first = F.expr(r"array_join(slice(regexp_extract_all(_mix_row.text, '([^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*)', 1), 1, cast(_mix_words as int)), '')")
    cut = F.col("_mix_words") < F.col("_mix_size")
    out = out.withColumn("_mix_text", F.when(cut, first).otherwise(F.col("_mix_row.text")))
    kinds = {f.name: f.dataType for f in docs.schema}
    kept = {"text": F.col("_mix_text")}
    if "n_chars" in kinds:
        kept["n_chars"] = F.when(cut, F.length("_mix_text").cast(kinds["n_chars"])).otherwise(F.col("_mix_row")["n_chars"])
    return out.select(*(kept.get(c, F.col("_mix_row")[c]).alias(c) for c in docs.columns))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(written(sized(table(spark, sf_dir, "documents")), "mix-sizes"))
    return out.select("doc_id", F.col("_mix_size").alias("size"), F.col("_mix_total").alias("source_size"), F.col("_mix_target").alias("target"), F.col("_mix_taken").alias("taken"))


ORACLE_SQL = {
    "op4_mix_sources": rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS total, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sized GROUP BY source),
weighed AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][place % {len(WEIGHTS)} + 1] AS weight FROM totals),
ahead AS (  -- by the level at which a source is full: what the fuller ones hold and weigh
  SELECT *, sum({MOST_EPOCHS} * total) OVER w - {MOST_EPOCHS} * total AS held, sum(weight) OVER w - weight AS gone,
         sum(total) OVER () AS everything, sum(weight) OVER () AS weights
  FROM weighed WINDOW w AS (ORDER BY {MOST_EPOCHS} * total / CAST(weight AS DOUBLE), place ROWS UNBOUNDED PRECEDING)),
levels AS (SELECT CAST(everything - held AS DOUBLE) / CAST(weights - gone AS DOUBLE) AS level, {MOST_EPOCHS} * total / CAST(weight AS DOUBLE) AS full_at FROM ahead),
chosen AS (SELECT coalesce(max(level), CAST('inf' AS DOUBLE)) AS level FROM levels WHERE level < full_at),
goals AS (
  SELECT source, total, least(CAST({MOST_EPOCHS} * total AS DOUBLE), weight * (SELECT CASE WHEN isinf(level) THEN 1e300 ELSE level END FROM chosen)) AS target FROM weighed),
placed AS (
  SELECT s.doc_id, s.size, g.total, g.target, CAST(floor(g.target) AS BIGINT) AS budget,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY CAST('0x' || substr(md5(concat_ws(':', '{SEED}', s.doc_id, s.size)), 1, {KEY_BITS // 4}) AS BIGINT), s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size AS before
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, total AS source_size, target,
       CAST(CASE WHEN total = 0 THEN 0 ELSE budget // total * size + greatest(0, least(size, budget % total - before)) END AS BIGINT) AS taken
FROM placed"""
}
