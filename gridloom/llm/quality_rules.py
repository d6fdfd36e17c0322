"""Quality rules by repetition coverage.

Per text, hashes of single words are rolled into hashes of 2 to 10 words in numpy. The characters inside repeated
n-grams and repeated lines are measured and held against the usual limits for web text. The share of repeated lines is one
of bytes, those of n-grams are of code points in words.

Defined results: a null or empty text has no words and fails the base rule; repeated rows give repeated rows;
a null doc_id is carried along; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.common import as_bytes, map_rows, table

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, dup_line_share double, top_gram_share double, dup_gram_share double, failed_rule string"
)
SYMBOLS = [s.encode() for s in "#*$%&|<>"]
SPACES = [bytes([c]) for c in (0x20, *range(0x09, 0x0E))]
#: Share of word characters inside the most frequent n-gram, and inside n-grams that occurred before, above which a text fails.
TOP_LIMITS = {2: 0.20, 3: 0.18, 4: 0.16}
DUP_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
DUP_LINE_LIMIT = 0.20
#: A top n-gram must occur so often: in short texts one chance repeat would exceed the share.
TOP_LEAST = 4
_MIX = np.uint64(0x9E3779B97F4A7C15)


def rolled(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every window of n words: a polynomial in the words' hashes, modulo 2**64, by doubling."""
    done, out, width = 0, None, 1
    power, block = _MIX, hashes
    while True:
        if n & width:
            if out is None:
                out, done, scale = block, width, power
            else:  # out covers the first `done` words of a window, block the next `width`
                m = len(hashes) - done - width + 1
                if m <= 0:
                    return np.empty(0, np.uint64)
                out = out[:m] * power + block[done : done + m]
                done += width
        width *= 2
        if width > n:
            break
        m = len(block) - width // 2
        if m <= 0:
            return np.empty(0, np.uint64)
        block = block[:m] * power + block[width // 2 :]
        power = np.uint64(int(power) ** 2 & 0xFFFFFFFFFFFFFFFF)
    return out if len(hashes) >= n else np.empty(0, np.uint64)


def repeated(windows: np.ndarray) -> np.ndarray:
    """For each window, whether its hash occurs twice or more."""
    order = np.argsort(windows, kind="stable")
    s = windows[order]
    same = s[1:] == s[:-1]
    flag = np.zeros(len(s), bool)
    flag[1:] |= same
    flag[:-1] |= same
    out = np.empty(len(s), bool)
    out[order] = flag
    return out


def again(windows: np.ndarray) -> np.ndarray:
    """For each window, whether its hash occurred before."""
    order = np.argsort(windows, kind="stable")
    s = windows[order]
    out = np.zeros(len(s), bool)
    out[order[1:]] = s[1:] == s[:-1]
    return out


def covered(flags: np.ndarray, n: int, n_words: int) -> np.ndarray:
    """Words that lie in a flagged window of n words."""
    steps = np.zeros(n_words + 1, np.int64)
    at = np.flatnonzero(flags)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + n, -1)
    return np.cumsum(steps[:-1]) > 0


def top_gram(windows: np.ndarray, frequent: np.ndarray, lens: np.ndarray, n: int) -> np.uint64:
    """Of the most frequent n-grams the one with the most characters, and of those the first in the text."""
    if len(frequent) == 1:
        return frequent[0]
    ends = np.concatenate(([0], np.cumsum(lens)))
    size = np.where(np.isin(windows, frequent), ends[n:] - ends[:-n], -1)
    return windows[int(size.argmax())]


def measure(text: bytes) -> tuple:
    """The columns of SCHEMA after doc_id, for one text."""
    words = text.split()
    n = len(words)
    ascii_only = text.isascii()
    points = len(text) if ascii_only else len(text.decode("utf-8", "replace"))
    word_chars = points - sum(map(text.count, SPACES))
    n_symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    distinct = set(lines)
    n_dup_lines = len(lines) - len(distinct)
    line_share = 0.0
    if n_dup_lines:
        seen: set[bytes] = set()
        inside = 0
        for x in lines:
            if x in seen:
                inside += len(x)
            seen.add(x)
        line_share = inside / max(1, sum(map(len, lines)))
    n_repeat, dup_share, top_share, worst = 0, 0.0, 0.0, ""
    if n >= 2:
        h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        grams = {1: h}
        lens = None

        def lengths() -> np.ndarray:
            return np.fromiter(map(len, words) if ascii_only else (len(w.decode("utf-8", "replace")) for w in words), np.int64, n)

        if n > 5 and again(rolled(h, 5)).any():  # a longer repeated n-gram holds a repeated 5-gram
            lens = lengths()
            for k, limit in DUP_LIMITS.items():
                windows = rolled(h, k) if n > k else np.empty(0, np.uint64)
                flags = again(windows)
                if not flags.any():
                    break
                if k == 8:
                    n_repeat = int(covered(repeated(windows), k, n).sum())
                share = float(lens[covered(flags, k, n)].sum()) / word_chars
                dup_share = max(dup_share, share)
                if share > limit and not worst:
                    worst = f"dup_{k}_grams"
        for k, limit in TOP_LIMITS.items():
            windows = rolled(h, k)
            if len(windows) < TOP_LEAST:
                break
            s = np.sort(windows)
            edges = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1], [True])))
            counts = np.diff(edges)
            most = int(counts.max())
            if most < TOP_LEAST:
                break  # longer n-grams are no more frequent
            lens = lengths() if lens is None else lens
            share = float(lens[covered(windows == top_gram(windows, s[edges[:-1][counts == most]], lens, k), k, n)].sum()) / word_chars
            top_share = max(top_share, share)
            if share > limit and not worst:
                worst = f"top_{k}_gram"
    if line_share > DUP_LINE_LIMIT and not worst:
        worst = "dup_lines"
    base_failed = n < 20 or 100 * n_repeat > 30 * n
    return n, word_chars, n_symbols, n_dup_lines, n_repeat, base_failed, not (base_failed or worst), line_share, top_share, dup_share, "base" if base_failed else worst or None


def quality(docs: DataFrame) -> DataFrame:
    """One row of SCHEMA per document; no shuffle, memory bounded by one batch."""

    def rows(_, batch):
        yield [batch.column(0), *zip(*(measure(t.as_py()) for t in batch.column(1)), strict=True)]

    return map_rows(docs.select("doc_id", as_bytes()), rows, SCHEMA)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def _sql() -> str:
    words = r"[^\x20\x09-\x0D]+"
    limits = [(f"dup_{k}_grams", "again", k, x) for k, x in DUP_LIMITS.items()] + [(f"top_{k}_gram", "top", k, x) for k, x in TOP_LIMITS.items()]
    share = lambda kind, k: f"coalesce(max(inside) FILTER (kind = '{kind}' AND k = {k}), 0) / CAST(any_value(chars) AS DOUBLE)"
    rules = " ".join(f"WHEN {share(kind, k)} > {x} THEN '{name}'" for name, kind, k, x in limits)
    most = lambda kind: f"coalesce(max(inside) FILTER (kind = '{kind}'), 0) / CAST(any_value(chars) AS DOUBLE)"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '{words}') AS ws FROM d),
words AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
sizes AS (SELECT r, count(*) AS n, sum(length(word)) AS chars FROM words GROUP BY r),
lines AS (SELECT r, line, row_number() OVER (PARTITION BY r, line) > 1 AS dup FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{words}')),
by_line AS (SELECT r, count(*) FILTER (dup) AS n_dup, coalesce(sum(strlen(line)) FILTER (dup), 0) / CAST(sum(strlen(line)) AS DOUBLE) AS dup_share FROM lines GROUP BY r),
grams AS (SELECT r, k, i AS p, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS g
          FROM w, (SELECT unnest(range(2, {max(DUP_LIMITS) + 1})) AS k), LATERAL (SELECT unnest(range(1, len(ws) - k + 2)) AS i)),
counted AS (SELECT r, k, p, g, count(*) OVER (PARTITION BY r, k, g) AS c, row_number() OVER (PARTITION BY r, k, g ORDER BY p) AS nth FROM grams),
best AS (SELECT r, k, first(g ORDER BY c DESC, length(g) DESC, p) AS g FROM counted WHERE k <= {max(TOP_LIMITS)} AND c >= {TOP_LEAST} GROUP BY r, k),
flagged AS (
  SELECT r, k, p, 'again' AS kind FROM counted WHERE k >= {min(DUP_LIMITS)} AND nth > 1
  UNION ALL SELECT r, k, p, 'repeat' FROM counted WHERE k = 8 AND c > 1
  UNION ALL SELECT c.r, c.k, c.p, 'top' FROM counted c JOIN best b ON c.r = b.r AND c.k = b.k AND c.g = b.g),
inside AS (SELECT kind, k, f.r, sum(length(word)) AS inside, count(*) AS n_inside
           FROM (SELECT DISTINCT r, k, kind, unnest(range(p, p + k)) AS q FROM flagged) f JOIN words ON words.r = f.r AND words.p = q GROUP BY ALL),
said AS (
  SELECT r, CASE {rules} END AS worst, {most("again")} AS dup_gram_share, {most("top")} AS top_gram_share, coalesce(max(n_inside) FILTER (kind = 'repeat'), 0) AS n_repeat
  FROM inside JOIN sizes USING (r) GROUP BY r),
measured AS (
  SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, CAST(coalesce(chars, 0) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words, coalesce(dup_share, 0) AS dup_line_share,
         coalesce(top_gram_share, 0) AS top_gram_share, coalesce(dup_gram_share, 0) AS dup_gram_share,
         coalesce(worst, CASE WHEN dup_share > {DUP_LINE_LIMIT} THEN 'dup_lines' END) AS worst
  FROM d LEFT JOIN sizes USING (r) LEFT JOIN by_line USING (r) LEFT JOIN said USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND worst IS NULL AS kept,
       dup_line_share, top_gram_share, dup_gram_share, CASE WHEN base_failed THEN 'base' ELSE worst END AS failed_rule
FROM (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured)"""


ORACLE_SQL = {"op9_quality_rules": _sql()}
