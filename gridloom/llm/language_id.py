"""Language identification by averaged hashed subword embeddings.

A text is the average of the embeddings of its hashed byte n-grams; a linear softmax reads its language. Both are
trained by stochastic gradient descent in numpy on a sample of labelled rows, taken by hash: of each language at most
MOST_EACH documents and a share of MOST_ROWS, but LEAST_EACH where it has them, so that every label can be learned and
predicted. Part of the sample calibrates the softmax's temperature and the confidence under which a prediction is rejected.
For use, embeddings and softmax are multiplied out into one table. Model and sample grow with the number of labels only.

The sample is cut by a hash threshold for each language before any row is moved, so that the main language's rows don't
meet in one task, and a document's features are its MOST_FEATURES most frequent buckets, so that the driver holds at
most four bytes times these a row. Predictions use whole texts and all buckets.

Defined results: a text that is null or has no letter gets `und` and score 0; without any labelled document every
text gets `und`; null lang values and null ids are never learned from; a null doc_id is never held out; repeated rows give
repeated rows; columns other than doc_id and text are not read for predictions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import as_bytes, id_text_crc, map_rows, table, written

FOLDS, HELD_OUT = 4, 2
MOST_EACH, MOST_ROWS, LEAST_EACH = 800, 8000, 12
MOST_FEATURES = 4096
GRAMS = (2, 3, 4)
BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
DIMENSIONS = 16
EPOCHS, RATE = 6, 0.5
#: Share of accepted predictions that is to be right on the calibration part.
PRECISION = 0.99
UNKNOWN = "und"
SEED = 6
_PIECE = 1 << 19
_LETTER = regex.compile(r"\p{L}")
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
_BLANK = bytes(32 if c < 65 or 91 <= c <= 96 or 123 <= c <= 127 else c for c in range(256))


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or not text.isascii() and bool(_LETTER.search(text.decode("utf-8", "replace")))


def buckets(text: bytes):
    """Buckets of all n-grams of the lower-cased text, whose other bytes than letters are blanks; long texts in pieces."""
    plain = b" " + text.lower().translate(_BLANK) + b" "
    for s in range(0, len(plain), _PIECE):
        data = np.frombuffer(plain[s : s + _PIECE + max(GRAMS) - 1], np.uint8).astype(np.uint32)
        code = data
        for n in range(2, max(GRAMS) + 1):
            m = min(_PIECE, len(data) - n + 1)
            if m <= 0:
                break
            code = (code[: len(data) - n + 1] << np.uint32(8)) | data[n - 1 :]
            if n in GRAMS:
                yield ((code[:m] * np.uint32(2654435761) + np.uint32(n * 0x61C88647 & 0xFFFFFFFF)) >> np.uint32(32 - BUCKET_BITS)).astype(np.intp)


@dataclass
class Model:
    names: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float

    def predict(self, text: bytes) -> tuple[str, float, bool]:
        """Language, calibrated probability, and whether the prediction is accepted."""
        if not self.names or not has_letter(text):
            return UNKNOWN, 0.0, False
        total, n = np.zeros(len(self.names)), 0
        for b in buckets(text):
            total += np.bincount(b, minlength=BUCKETS) @ self.table if len(b) > 4 * BUCKETS else self.table.take(b, axis=0).sum(axis=0)
            n += len(b)
        p = softmax((total / max(1, n) + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.names[best], float(p[best]), bool(p[best] >= self.reject_below)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(features: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Table and bias of the logits: embeddings times softmax weights, by stochastic gradient descent."""
    rng = np.random.default_rng(SEED)
    embed = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)) / DIMENSIONS
    weights, bias = np.zeros((DIMENSIONS, n_classes)), np.zeros(n_classes)
    total, done = EPOCHS * len(y), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            rate = RATE * (1 - done / total)
            done += 1
            at, share = features[i][0], features[i][1].astype(np.float64)
            hidden = share @ embed[at]
            g = softmax(hidden @ weights + bias)
            g[y[i]] -= 1
            back = weights @ g
            weights -= rate * np.outer(hidden, g)
            bias -= 0.1 * rate * g
            embed[at] -= (rate * len(at) ** 0.5) * share[:, None] * back[None, :]
    return embed @ weights, bias


def calibrated(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The temperature of least log loss, and the least confidence at which accepted predictions reach PRECISION."""
    if not len(y):
        return 1.0, 0.0
    grid = np.geomspace(0.02, 5, 60)
    loss = [-np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    t = float(grid[int(np.argmin(loss))])
    p = softmax(logits / t)
    order = np.argsort(-p.max(axis=1), kind="stable")
    right = np.cumsum(p.argmax(axis=1)[order] == y[order]) / np.arange(1, len(y) + 1)
    enough = np.flatnonzero(right >= PRECISION)
    return t, float(p.max(axis=1)[order][enough[-1]]) if len(enough) else 1.0


def sampled(open_docs: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """doc_id, lang of at most so many documents of each language, the first by hash.

    A threshold from the language's number of rows lets about twice as many pass to the exact cut, some more where these
    are few; so a task of the cut holds a bounded number of rows, however frequent the language."""
    place = F.xxhash64("doc_id", F.lit(SEED))
    share = (place / F.lit(float(1 << 63)) + 1) / 2
    passing = open_docs.select("doc_id", "lang").join(F.broadcast(sizes.withColumnRenamed("lang", "_lid_of")), F.col("lang") == F.col("_lid_of"))
    passing = passing.where(share * F.col("_lid_n") <= 2.0 * most + 40).select("doc_id", "lang").distinct()
    order = Window.partitionBy("lang").orderBy(place, "doc_id")
    return passing.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).drop("n")


def fit(docs: DataFrame) -> Model:
    """Learn from text and lang of documents that aren't held out."""
    open_docs = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (id_text_crc() % FOLDS != HELD_OUT))
    sizes = written(open_docs.groupBy("lang").agg(F.count(F.lit(1)).alias("_lid_n")), "lid-languages")
    names = sorted(r.lang for r in sizes.select("lang").collect())  # a class each
    if not names:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 1.0)
    chosen = sampled(open_docs, sizes, max(LEAST_EACH, min(MOST_EACH, MOST_ROWS // len(names))))
    chosen = chosen.groupBy(F.col("doc_id").alias("_lid_id")).agg(F.min("lang").alias("_lid_lang"))
    texts = open_docs.select("doc_id", as_bytes()).join(F.broadcast(chosen), F.col("doc_id") == F.col("_lid_id")).select("doc_id", "text", F.col("_lid_lang").alias("lang"))

    def rows(_, batch):
        index, share = [], []
        for t in batch.column(1):
            counts = np.zeros(BUCKETS)
            for b in buckets(t.as_py()):
                counts += np.bincount(b, minlength=BUCKETS)
            at = np.flatnonzero(counts)
            if len(at) > MOST_FEATURES:
                at = np.sort(at[np.argsort(-counts[at], kind="stable")[:MOST_FEATURES]])
            index.append(at.astype(np.uint16))
            share.append((counts[at] / max(1, counts.sum())).astype(np.float16))
        yield [batch.column(0), batch.column(2), [x.tobytes() for x in index], [x.tobytes() for x in share]]

    sample = written(map_rows(texts, rows, "doc_id long, lang string, at binary, share binary"), "lid-sample")
    found = sorted(((r.doc_id, r.lang, bytes(r["at"]), bytes(r.share)) for r in sample.toLocalIterator()))
    features = [(np.frombuffer(at, np.uint16), np.frombuffer(share, np.float16)) for _, _, at, share in found]
    place = {name: k for k, name in enumerate(names)}
    y = np.array([place[lang] for _, lang, _, _ in found])
    aside = np.arange(len(y)) % 5 == 0
    part = np.flatnonzero(~aside) if len(y) >= 20 else np.arange(len(y))
    logit_table, bias = train([features[i] for i in part], y[part], len(names))
    check = np.flatnonzero(aside) if len(y) >= 20 else part
    logits = np.array([share @ logit_table[at] + bias for at, share in (features[i] for i in check)])
    return Model(names, logit_table.astype(np.float32), bias, *calibrated(logits, y[check]))


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, and accepted: whether the calibrated score is above the limit of rejection."""

    def rows(_, batch):
        yield [batch.column(0), batch.column(2), *zip(*(model.predict(t.as_py()) for t in batch.column(1)), strict=True)]

    held = F.coalesce(id_text_crc() % FOLDS == HELD_OUT, F.lit(False)).alias("held_out")
    return map_rows(docs.select("doc_id", as_bytes(), held), rows, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identified(docs, fit(docs))
