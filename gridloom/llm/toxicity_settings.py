"""How the settings of the toxicity model were chosen: python -m gridloom.llm.toxicity_settings FOLDER...

GRID was laid down before any of its scores were looked at. Only open rows are read: models learn from the remainders 2
to 4 of crc32(doc_id) mod 5 and are compared on remainder 1, by the mean over the folders of F1 at score 0.5; remainder
0, which is held out, is never opened. The first best setting in the grid's order is taken.
"""

from __future__ import annotations

import itertools
import sys
import zlib

import numpy as np
import pyarrow.dataset as ds

from gridloom.llm import toxicity as T

GRID = {"root": (True, False), "features": (128, 256, 512), "decay": (1e-3, 3e-3, 1e-2)}
MOST_DOCUMENTS = 6000


def open_rows(folder: str) -> tuple[list[tuple[int, str]], dict[int, int]]:
    """Documents and labels whose remainder isn't 0."""
    is_open = lambda d: d is not None and zlib.crc32(str(d).encode()) % T.FOLDS != T.HELD_OUT
    labels = ds.dataset(f"{folder}/labels.parquet").to_table(columns=["doc_id", "toxic"]).to_pylist()
    known = {r["doc_id"]: r["toxic"] for r in labels if is_open(r["doc_id"]) and r["toxic"] is not None}
    docs = {}
    for batch in ds.dataset(f"{folder}/documents.parquet").to_batches(columns=["doc_id", "text"], batch_size=2000):
        for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if is_open(d):
                docs[d] = text or ""
    return sorted(docs.items()), known


def compared(folder: str) -> dict[tuple, float]:
    docs, known = open_rows(folder)
    part = {d: zlib.crc32(str(d).encode()) % T.FOLDS for d, _ in docs}
    order = np.random.default_rng(T.SEED).permutation(len(docs))
    learn = [docs[i] for i in order if part[docs[i][0]] != 1]
    positive = [x for x in learn if known.get(x[0]) == 1][:MOST_DOCUMENTS]
    rest = learn[:MOST_DOCUMENTS]
    test = [docs[i] for i in order if part[docs[i][0]] == 1 and docs[i][0] in known][: 2 * MOST_DOCUMENTS]
    y = np.array([known[d] for d, _ in test]) == 1
    labelled = [known[d] for d, _ in learn if d in known]
    prior = float(min(0.5, max(0.001, np.mean(labelled))))

    def sparse(rows):
        for _, text in rows:
            counts, words = T.counted(text.encode("utf-8", "replace"), None, T.BUCKETS)
            at = np.flatnonzero(counts)
            yield at, counts[at], words

    found = [list(sparse(rows)) for rows in (positive, rest, test)]
    out = {}
    for root in GRID["root"]:
        rate = (lambda c, w: T.rates(c, w)) if root else (lambda c, w: np.minimum(c / (w + T.SMOOTHING), T.MOST_RATE))
        sums, numbers = np.zeros((5, T.BUCKETS)), [len(found[0]), len(found[1])]
        for row, group in ((0, found[0]), (2, found[1])):
            for at, c, w in group:
                x = rate(c, w)
                sums[row, at] += x
                sums[row + 1, at] += x * x
                if not row:
                    sums[4, at] += 1
        mean_p, mean_u = sums[0] / numbers[0], sums[2] / numbers[1]
        spread = np.maximum(sums[1] / numbers[0] - mean_p**2, 0) / numbers[0] + np.maximum(sums[3] / numbers[1] - mean_u**2, 0) / numbers[1]
        strength = (mean_p - mean_u) / np.sqrt(spread + 1e-12)
        strength[sums[4] < max(T.LEAST_EXAMPLES, T.LEAST_SHARE * numbers[0])] = 0
        for features in GRID["features"]:
            picked = np.sort(np.argsort(-strength, kind="stable")[:features])
            picked = picked[strength[picked] > T.LEAST_STRENGTH]
            of = np.full(T.BUCKETS, -1)
            of[picked] = np.arange(len(picked))
            vectors = []
            for group in found:
                x = np.zeros((len(group), len(picked)))
                for i, (at, c, w) in enumerate(group):
                    own = of[at] >= 0
                    x[i, of[at[own]]] = rate(c[own], w)
                vectors.append(x)
            p, u, t = vectors
            scale = u.std(axis=0) + p.std(axis=0) + 1e-6
            p, u, t = p / scale, u / scale, t / scale
            for decay in GRID["decay"]:
                unseen_p, unseen_u = np.zeros(len(p)), np.zeros(len(u))
                for k in range(T.CROSS_PARTS):
                    in_p, in_u = np.arange(len(p)) % T.CROSS_PARTS == k, np.arange(len(u)) % T.CROSS_PARTS == k
                    w, b = T.nnpu(p[~in_p], u[~in_u], prior, decay=decay)
                    unseen_p[in_p], unseen_u[in_u] = p[in_p] @ w + b, u[in_u] @ w + b
                w, b = T.nnpu(p, u, prior, decay=decay)
                said = t @ w + b >= T.best_limit(unseen_p, unseen_u)
                hit = float((said & y).sum())
                out[root, features, decay] = 2 * hit / max(1.0, said.sum() + y.sum())
    return out


def main(folders: list[str]) -> None:
    scores = [compared(f) for f in folders]
    for setting in itertools.product(*GRID.values()):
        own = [s[setting] for s in scores]
        print(setting, f"{np.mean(own):.4f}", [round(x, 4) for x in own], flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
