"""Toxicity by non-negative positive-unlabelled learning.

A linear model over square roots of the rates of hashed byte n-grams is trained in numpy from confirmed toxic examples and unlabelled text.
The risk is the class-prior-corrected estimate; where its negative part falls below zero, the step goes against it.

Learning reads bounded samples, taken by hash: at most MOST_POSITIVE confirmed toxic documents and MOST_UNLABELLED
documents of any kind. Only sums of bounded size and vectors of the chosen features reach the driver. Scoring reads all
documents and whole texts.

Defined results: a null or empty text is scored as a text without features; without any confirmed toxic example every
score is the (default) class prior; a null doc_id is never held out and never a label's document; labels that repeat
count once; repeated rows give repeated rows; columns other than doc_id and text are not read for scoring.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import as_bytes, id_text_crc, map_rows, small_batches, table, written

FOLDS, HELD_OUT = 5, 0
MOST_POSITIVE, MOST_UNLABELLED = 4000, 8000
SAMPLE_PARTS = 8
GRAMS = (5, 7)
BUCKET_BITS = 17
BUCKETS = 1 << BUCKET_BITS
FEATURES = 128
#: A feature occurs in at least so many confirmed examples (and this share of them) and differs by so many deviations.
LEAST_EXAMPLES, LEAST_SHARE, LEAST_STRENGTH = 4, 0.01, 4.0
#: A rate above this says no more: one repeated word is no more toxic.
MOST_RATE = 0.05
#: Words that are added to a text's length: in a short text one chance n-gram weighs less.
SMOOTHING = 30
#: Parts of the sample that are scored, for the limit, by a model which hasn't seen them.
CROSS_PARTS = 4
DEFAULT_PRIOR = 0.05
SEED = 3
_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_PIECE = 1 << 20


def codes(data: np.ndarray, n: int) -> np.ndarray:
    """Hash buckets of all n-grams of bytes."""
    m = len(data) - n + 1
    if m <= 0:
        return np.empty(0, np.int64)
    code = data[:m].astype(np.uint64)
    for k in range(1, n):
        code <<= np.uint64(8)
        code |= data[k : k + m]
    code *= np.uint64(0x9E3779B97F4A7C15)
    code >>= np.uint64(64 - BUCKET_BITS)
    return code.view(np.int64)


def pieces(text: bytes):
    """Bytes of the text's letters in lower case, other bytes as blanks; very long texts in overlapping pieces."""
    plain = b" " + text.lower().translate(_LETTERS) + b" "
    if len(plain) <= _PIECE:
        yield np.frombuffer(plain, np.uint8), 0
        return
    for s in range(0, len(plain), _PIECE):
        yield np.frombuffer(plain[max(0, s - max(GRAMS) + 1) : s + _PIECE], np.uint8), min(s, max(GRAMS) - 1)


def counted(text: bytes, of: np.ndarray | None, size: int) -> tuple[np.ndarray, int]:
    """Counts of the n-grams' buckets (mapped by `of`, -1: not counted) and the number of words."""
    total = np.zeros(size, np.int64)
    n_words = 0
    for data, overlap in pieces(text):
        for n in GRAMS:
            c = codes(data, n)[max(0, overlap - n + 1) :]
            if of is not None:
                c = of[c]
                c = c[c >= 0]
            if len(c):
                total += np.bincount(c, minlength=size)
        letters = data != 32
        n_words += int((letters[1:] & ~letters[:-1])[max(0, overlap - 1) :].sum())
    return total, n_words


def rates(counts: np.ndarray, words: int) -> np.ndarray:
    return np.sqrt(np.minimum(counts / (words + SMOOTHING), MOST_RATE))


@dataclass
class Model:
    of: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, text: bytes) -> float:
        if not len(self.weights):
            return float(1 / (1 + np.exp(-self.bias)))
        counts, n = counted(text, self.of, len(self.weights))
        z = float(rates(counts, n) @ self.weights) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, epochs: int = 150, batch: int = 512, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise prior * E_p[l(z)] + max(0, E_u[l(-z)] - prior * E_p[l(-z)]), l the logistic loss."""
    rng = np.random.default_rng(SEED)
    w, b = np.zeros(positive.shape[1]), float(np.log(prior / (1 - prior)))
    mean, var, t = np.zeros(len(w) + 1), np.zeros(len(w) + 1), 0
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    steps = max(1, len(unlabelled) // batch)
    for epoch in range(epochs):
        p_order, u_order = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
        for s in range(steps):
            u = unlabelled[u_order[s::steps]]
            p = positive[p_order[s::steps]] if len(positive) >= steps else positive
            zp, zu = p @ w + b, u @ w + b
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            gp, gu = sigmoid(zp), sigmoid(zu)
            if negative < 0:  # the estimate is below zero: the model overfits, so this part is ascended
                up, uu = prior * gp / len(p), -gu / len(u)
            else:
                up, uu = prior * (gp - 1) / len(p) - prior * gp / len(p), gu / len(u)
            grad = np.append(p.T @ up + u.T @ uu + decay * w, up.sum() + uu.sum())
            t += 1
            mean = 0.9 * mean + 0.1 * grad
            var = 0.999 * var + 0.001 * grad * grad
            step = rate * (1 - epoch / epochs) * (mean / (1 - 0.9**t)) / (np.sqrt(var / (1 - 0.999**t)) + 1e-8)
            w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def best_limit(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The limit of z, near 0, that maximises recall squared over the share of all text that is rejected."""
    limits = np.unique(np.clip(np.append(positive, 0.0), -1.5, 1.5))
    worth = [(positive >= t).mean() ** 2 / max((unlabelled >= t).mean(), 1 / len(unlabelled)) for t in limits]
    return float(limits[int(np.argmax(worth))])


def sampled(docs: DataFrame, n: int, most: int) -> DataFrame:
    """Ids of at most so many of the n documents, the first by hash.

    A threshold from the number of rows keeps back all but about twice as many before any row moves; where ids repeat so
    often that too few are left, it is raised."""
    hashed = docs.select("doc_id").withColumn("_tox_h", F.xxhash64("doc_id", F.lit(SEED)))
    first = lambda rows: rows.distinct().orderBy("_tox_h", "doc_id").limit(most).select("doc_id")
    passing = 2.0 * most + 100
    while passing < n:
        ids = written(first(hashed.where((F.col("_tox_h") / F.lit(float(1 << 63)) + 1) / 2 * n <= passing)), "toxicity-ids")
        if ids.count() >= most:
            return ids
        passing *= 16
    return first(hashed)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from the documents that aren't held out; labels has doc_id and toxic."""
    nothing = Model(np.empty(0, np.int64), np.empty(0), float(np.log(DEFAULT_PRIOR / (1 - DEFAULT_PRIOR))))
    open_docs = docs.where(F.col("doc_id").isNotNull() & (id_text_crc() % FOLDS != HELD_OUT))
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (id_text_crc() % FOLDS != HELD_OUT)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, n_toxic = known.agg(F.count(F.lit(1)), F.sum((F.col("toxic") == 1).cast("long"))).first()
    if not n_toxic:
        return nothing
    prior = float(min(0.5, max(0.001, n_toxic / n)))
    toxic = sampled(known.where("toxic = 1"), n_toxic, MOST_POSITIVE).select(F.col("doc_id").alias("_tox_id"), F.lit(1).alias("_tox_p"))
    other = sampled(open_docs, open_docs.count(), MOST_UNLABELLED).select(F.col("doc_id").alias("_tox_id"), F.lit(0).alias("_tox_p"))
    chosen = toxic.unionAll(other).groupBy("_tox_id").agg(F.max("_tox_p").alias("_tox_p"), (F.min("_tox_p") == 0).alias("_tox_u"))
    # at most MOST_POSITIVE + MOST_UNLABELLED short rows
    texts = open_docs.select("doc_id", as_bytes()).join(F.broadcast(chosen), F.col("doc_id") == F.col("_tox_id"))
    once = texts.groupBy(F.xxhash64("text").alias("_tox_text")).agg(F.min_by(F.struct("doc_id", "text", "_tox_p", "_tox_u"), "doc_id").alias("x")).select("x.*")  # copies teach once
    sample = written(once.select("doc_id", "text", F.col("_tox_p").cast("int").alias("p"), F.col("_tox_u").cast("int").alias("u")).repartition(SAMPLE_PARTS, F.xxhash64("doc_id")), "toxicity-sample")

    def moments(batches):  # five sums by bucket for each task: bounded
        import pyarrow as pa

        sums = np.zeros((5, BUCKETS), np.float32)
        n_p = n_u = 0
        for batch in batches:
            for t, p, u in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                counts, words = counted(t.as_py(), None, BUCKETS)
                at = np.flatnonzero(counts)
                x = rates(counts[at], words).astype(np.float32)
                for flag, row in ((p.as_py(), 0), (u.as_py(), 2)):
                    if flag:
                        sums[row, at] += x
                        sums[row + 1, at] += x * x
                if p.as_py():
                    sums[4, at] += 1
                n_p, n_u = n_p + p.as_py(), n_u + u.as_py()
        yield pa.RecordBatch.from_arrays([pa.array([n_p], pa.int64()), pa.array([n_u], pa.int64()), pa.array([sums.tobytes()], pa.binary())], ["n_p", "n_u", "sums"])

    n_p = n_u = 0
    sums = np.zeros((5, BUCKETS))
    for row in sample.mapInArrow(moments, "n_p long, n_u long, sums binary").toLocalIterator():
        n_p, n_u = n_p + row.n_p, n_u + row.n_u
        sums += np.frombuffer(row.sums, np.float32).reshape(5, BUCKETS)
    if not n_p or not n_u:
        return nothing
    mean_p, mean_u = sums[0] / n_p, sums[2] / n_u
    spread = np.maximum(sums[1] / n_p - mean_p**2, 0) / n_p + np.maximum(sums[3] / n_u - mean_u**2, 0) / n_u
    strength = (mean_p - mean_u) / np.sqrt(spread + 1e-12)
    strength[sums[4] < max(LEAST_EXAMPLES, LEAST_SHARE * n_p)] = 0
    picked = np.sort(np.argsort(-strength, kind="stable")[:FEATURES])
    picked = picked[strength[picked] > LEAST_STRENGTH]
    if not len(picked):
        return nothing
    of = np.full(BUCKETS, -1, np.int64)
    of[picked] = np.arange(len(picked))

    def vectors(_, batch):
        out = []
        for t in batch.column(0):
            counts, words = counted(t.as_py(), of, len(picked))
            out.append(rates(counts, words).astype(np.float32).tobytes())
        yield [out, batch.column(1), batch.column(2), batch.column(3)]

    rows = map_rows(sample.select("text", "p", "u", "doc_id"), vectors, "x binary, p int, u int, doc_id long").orderBy("doc_id").collect()
    x = np.array([np.frombuffer(r.x, np.float32) for r in rows], np.float64)
    is_p, is_u = np.array([r.p for r in rows], bool), np.array([r.u for r in rows], bool)
    scale = x[is_u].std(axis=0) + x[is_p].std(axis=0) + 1e-6
    part, unseen = np.arange(len(x)) % CROSS_PARTS, np.zeros(len(x))
    for k in range(CROSS_PARTS):
        rest = part != k
        if (is_p & rest).any() and (is_u & rest).any():
            w, b = nnpu(x[is_p & rest] / scale, x[is_u & rest] / scale, prior)
            unseen[~rest] = x[~rest] @ (w / scale) + b
    w, b = nnpu(x[is_p] / scale, x[is_u] / scale, prior)
    return Model(of, w / scale, b - best_limit(unseen[is_p], unseen[is_u]))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id and text) with held_out, score and predicted."""

    def rows(_, batch):
        s = np.array([model.score(t.as_py()) for t in batch.column(1)])
        yield [batch.column(0), batch.column(2), s, (s >= 0.5).astype(np.int32)]

    held = F.coalesce(id_text_crc() % FOLDS == HELD_OUT, F.lit(False)).alias("held_out")
    return map_rows(docs.select("doc_id", as_bytes(), held), rows, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the classifier rejects; the columns stay, in a single pass over the texts."""
    model = fit(docs, labels)
    import pyarrow as pa

    schema = docs.schema
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = batch.column(place).cast(pa.binary())  # the bytes that scored() reads
            keep = [model.score(t.as_py() or b"") < 0.5 for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def op3_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))
