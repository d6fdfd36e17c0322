"""Secret scans with a randomness test battery, in DataFrame functions only.

Rules find the base kinds: assign, access and hex. The method adds spans of kind random: tokens with letters and digits,
whose encoding is inferred from their characters, go through tests of uniformity (chi-squared over the encoding's
alphabet), of runs (above and below the alphabet's middle) and of serial correlation. The least of the three tail values
is the token's raw score; where it stands among the raw scores of SIMULATED random tokens of the same encoding and length,
is its p value, which is hence uniform for random tokens whatever the length (ties are broken by hash). These tables are
constants; the texts' tokens go through DataFrame functions alone.

What is looked for are random tokens, so a discovery is a token with p above a limit and a false one is a token that
isn't random. For each encoding and class of lengths the number of random tokens is estimated from the upper p values
(above 1/4 if these are as frequent as those above 1/2, else above 1/2), and the limit is the least at which
(1 + accepted tokens - random tokens expected above it) / accepted tokens is at most FDR; a class in which none is accepts
nothing, so it takes about ten random tokens for any. A class of fewer than CLASS_LEAST tokens is judged with its encoding's
other lengths, or else with all tokens.

Defined results: a null text counts as empty and has no spans; repeated rows give repeated rows; null ids are carried
along; offsets are code points, ends exclusive; columns other than doc_id and text are not read by the scan.
"""

from __future__ import annotations

from functools import lru_cache
from math import log2

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import table, written

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Each match of ASSIGN holds one of these in lower case.
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ACCESS = r"AKIA[A-Z0-9]{16,}"
#: A run that is too short can't hold a long enough one, so the least length may stand in the pattern; nor can a match
#: start within a run.
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
TOKEN_RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
TOKEN = TOKEN_RUN + "={0,2}"
KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE = 6
FDR = 0.1
BINS = 20
#: Random tokens that are made for each encoding and length, lengths that are told apart, and the class of longer ones.
SIMULATED, EXACT_LENGTH, LENGTH_STEP, MOST_LENGTH = 4000, 64, 16, 160
SEED = 5
CLASS_LEAST = 40
#: Pattern and alphabet by encoding; the first that fits is taken.
ENCODINGS = {
    "hex": (r"^[0-9a-f]+$", "0123456789abcdef"),
    "HEX": (r"^[0-9A-F]+$", "0123456789ABCDEF"),
    "base32": (r"^[A-Z2-7]+={0,2}$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    "upper36": (r"^[A-Z0-9]+={0,2}$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "lower36": (r"^[a-z0-9]+={0,2}$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    "base62": (r"^[A-Za-z0-9]+={0,2}$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    "base64": (r"^[A-Za-z0-9+/]+={0,2}$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    "base64url": (r"^[A-Za-z0-9_-]+={0,2}$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
}
REDACTED = "[redacted]"


def letters_of(enc: str) -> str:
    return f"CASE {enc} " + " ".join(f"WHEN '{k}' THEN '{own}'" for k, (_, own) in ENCODINGS.items()) + " END"


def battery_sql(token: str) -> str:
    """SQL of struct(enc, n, p) for a token; lambda variables bind each intermediate value once."""
    enc = "CASE " + " ".join(f"WHEN t RLIKE '{p}' THEN '{k}'" for k, (p, _) in ENCODINGS.items()) + " ELSE 'base64url' END"
    letters = letters_of("enc")
    return f"""element_at(transform(transform(transform(transform(
        array({token}),
        t -> named_struct('w', rtrim('=', t), 'enc', {enc})),
        s -> named_struct('w', s.w, 'enc', s.enc, 'n', CAST(length(s.w) AS DOUBLE), 'chars', split(s.w, ''), 'letters', element_at(transform(array(s.enc), enc -> {letters}), 1))),
        s -> named_struct('w', s.w, 'enc', s.enc, 'n', s.n, 'k', CAST(length(s.letters) AS DOUBLE),
            'sq', aggregate(transform(array_distinct(s.chars), c -> pow(s.n - length(replace(s.w, c, '')), 2)), 0D, (a, x) -> a + x),
            'at', transform(s.chars, c -> CAST(instr(s.letters, c) AS DOUBLE)))),
        s -> named_struct('enc', s.enc, 'n', s.n, 'k', s.k,
            'z_chi', (s.sq * s.k / s.n - s.n - (s.k - 1)) / sqrt(2 * (s.k - 1) * (s.n - 1) / s.n),
            'upper', aggregate(transform(s.at, x -> IF(x > s.k / 2, 1D, 0D)), 0D, (a, x) -> a + x),
            'runs', 1 + aggregate(zip_with(slice(s.at, 1, CAST(s.n AS INT) - 1), slice(s.at, 2, CAST(s.n AS INT)), (x, y) -> IF((x > s.k / 2) <> (y > s.k / 2), 1D, 0D)), 0D, (a, x) -> a + x),
            'mean', aggregate(s.at, 0D, (a, x) -> a + x) / s.n,
            'ss', aggregate(s.at, 0D, (a, x) -> a + x * x),
            'cross', aggregate(zip_with(slice(s.at, 1, CAST(s.n AS INT) - 1), slice(s.at, 2, CAST(s.n AS INT)), (x, y) -> x * y), 0D, (a, x) -> a + x),
            'ends', element_at(s.at, 1) + element_at(s.at, -1))), 1)"""


def raw_score(s: str) -> str:
    """SQL of the least tail value of the three tests, for the struct that battery_sql makes."""
    q = lambda z: f"(CASE WHEN {z} < 0 THEN 1 - exp(-0.717D * abs({z}) - 0.416D * {z} * {z}) / 2 WHEN {z} > 8 THEN 0D ELSE exp(-0.717D * abs({z}) - 0.416D * {z} * {z}) / 2 END)"
    lower = f"({s}.n - {s}.upper)"
    both = f"(2 * {s}.upper * {lower})"
    z_runs = f"CASE WHEN {s}.upper = 0 OR {lower} = 0 OR {both} <= {s}.n THEN 9D ELSE abs({s}.runs - 1 - {both} / {s}.n) / sqrt({both} * ({both} - {s}.n) / ({s}.n * {s}.n * ({s}.n - 1))) END"
    spread = f"({s}.ss - {s}.n * {s}.mean * {s}.mean)"
    r = f"({s}.cross - {s}.mean * (2 * {s}.n * {s}.mean - {s}.ends) + ({s}.n - 1) * {s}.mean * {s}.mean) / {spread}"
    z_serial = f"CASE WHEN {spread} <= 0 THEN 9D ELSE abs({r} + 1 / {s}.n) * sqrt({s}.n) END"
    return f"""element_at(transform(array(named_struct('a', {s}.z_chi, 'b', {z_runs}, 'c', {z_serial})), z -> least({q("z.a")}, 2 * {q("z.b")}, 2 * {q("z.c")})), 1)"""


def tested(token: str) -> str:
    """SQL of struct(enc, size, n0, raw) of a token, null for one without a digit and a letter: it takes no part.

    n0 is the length whose random tokens it is held against; equal raw scores are told apart by a hash of the token."""
    n0 = f"CAST(IF(b.n <= {EXACT_LENGTH}, b.n, least({MOST_LENGTH}, {LENGTH_STEP} * ceil(b.n / {LENGTH_STEP}))) AS INT)"
    tie = f"(1 - 1e-6D * pmod(xxhash64({token}), 1000003) / 1000003)"
    return (
        f"IF({token} RLIKE '[0-9]' AND {token} RLIKE '[A-Za-z]', element_at(transform(array({battery_sql(token)}), "
        f"b -> named_struct('enc', b.enc, 'size', CAST(floor(log2(b.n)) AS INT), 'n0', {n0}, 'raw', {raw_score('b')} * {tie})), 1), NULL)"
    )


RANDOM_SQL = f"transform(_sec_tokens, w -> {tested('w')})"


PATTERNS = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, TOKEN), strict=True))


def hinted(rows: DataFrame) -> DataFrame:
    """rows with _there_<kind>: whether _sec_text may hold a match. Two passes tell for most texts that they hold none: every
    match of access and hex lies in a run of a token's characters."""
    lower = F.lower("_sec_text")
    assign = F.lit(False)
    for word in ASSIGN_WORDS:
        assign = assign | F.contains(lower, F.lit(word))
    out = rows.withColumn("_there_random", F.col("_sec_text").rlike(TOKEN_RUN)).withColumn("_there_assign", assign)
    run = F.col("_there_random")
    return out.withColumn("_there_access", run & F.contains("_sec_text", F.lit("AKIA"))).withColumn("_there_hex", run & F.col("_sec_text").rlike(HEX))


def hits(docs: DataFrame) -> DataFrame:
    """doc_id and, for each kind, lengths of the matches and of the pieces between, and which matches hold; no text."""
    text = F.coalesce(F.col("text"), F.lit("")).alias("_sec_text")
    none_int, none_bool = F.array().cast("array<int>"), F.array().cast("array<boolean>")
    out = hinted(docs.select("doc_id", text))
    columns = ["doc_id"]
    for kind, pattern in PATTERNS.items():
        there = F.col(f"_there_{kind}")
        found = F.when(there, F.regexp_extract_all("_sec_text", F.lit(pattern), F.lit(0)))
        between = F.when(there, F.split("_sec_text", pattern, -1))
        if kind == "random":
            out = out.withColumn("_sec_tokens", F.coalesce(found, F.array().cast("array<string>")))
            out = out.withColumn("_tests", F.expr(RANDOM_SQL))
            columns.append("_tests")
            found = F.col("_sec_tokens")
        out = out.withColumn(f"_{kind}_m", F.coalesce(F.transform(found, F.length), none_int)).withColumn(f"_{kind}_p", F.coalesce(F.transform(between, F.length), none_int))
        if kind == "assign":
            values = F.when(there, F.regexp_extract_all("_sec_text", F.lit(pattern), F.lit(2)))
            out = out.withColumn("_assign_k", F.coalesce(F.transform(values, lambda v: F.length(v) >= LEAST_VALUE), none_bool))
            columns.append("_assign_k")
        columns += [f"_{kind}_m", f"_{kind}_p"]
    return out.select(*columns)


@lru_cache(maxsize=None)
def null_levels(enc: str, n: int) -> tuple[float, ...]:
    """The raw scores at shares 1/BINS, 2/BINS... of random tokens of an encoding and length, from SIMULATED tokens.

    A table of constants: no row of the data goes in. Tokens whose characters happen to fit an earlier encoding, or which
    lack a digit or a letter, are left out, as they are among the texts' tokens."""
    letters = ENCODINGS[enc][1]
    k = len(letters)
    at = np.random.default_rng([SEED, list(ENCODINGS).index(enc), n]).integers(1, k + 1, (SIMULATED, n))
    among = lambda chosen: np.isin(at, [i for i, c in enumerate(letters, 1) if c in chosen])
    digits = among("0123456789")
    fits = digits.any(axis=1) & among("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz").any(axis=1)
    for other, (_, own) in ENCODINGS.items():
        if other == enc:
            break
        fits &= ~among(own).all(axis=1)
    at = at[fits].astype(float)
    m = len(at)
    counts = np.bincount((at.astype(np.int64) + (k + 1) * np.arange(m)[:, None]).ravel(), minlength=m * (k + 1)).reshape(m, k + 1)
    chi = ((counts.astype(float) ** 2).sum(axis=1) * k / n - n - (k - 1)) / np.sqrt(2 * (k - 1) * (n - 1) / n)
    high = at > k / 2
    upper = high.sum(axis=1)
    both = 2.0 * upper * (n - upper)
    mean = at.mean(axis=1, keepdims=True)
    spread = ((at - mean) ** 2).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        runs = np.abs((high[:, 1:] != high[:, :-1]).sum(axis=1) - both / n) / np.sqrt(both * (both - n) / (n * n * (n - 1.0)))
        serial = np.abs(((at[:, 1:] - mean) * (at[:, :-1] - mean)).sum(axis=1) / spread + 1 / n) * np.sqrt(n)
    runs[both <= n], serial[spread <= 0] = 9, 9
    raw = np.minimum(tail(chi), 2 * np.minimum(tail(runs), tail(serial)))
    return tuple(np.quantile(raw, np.arange(1, BINS) / BINS).tolist()) if m else ()


def tail(z: np.ndarray) -> np.ndarray:
    """The upper tail of the normal distribution, as raw_score approximates it."""
    half = np.exp(-0.717 * np.abs(z) - 0.416 * z * z) / 2
    return np.where(z < 0, 1 - half, np.where(z > 8, 0.0, half))


def limit_of(own: list[int]) -> int | None:
    """The least bin from which tokens are accepted, by their numbers in equal ranges of p; None: none is."""
    quarter, half = BINS // 4, BINS // 2
    low, high = sum(own[quarter:half]), sum(own[half:])
    truly = (low + high) / 0.75 if low <= high / 2 + 2 * (0.75 * high + 1) ** 0.5 else high / 0.5
    for b in range(half + 1):
        above = sum(own[b:])
        if above and 1 + max(0.0, above - truly * (1 - b / BINS)) <= FDR * above:
            return b
    return None


def limits(tests: DataFrame) -> dict[str, float]:
    """The raw score from which a token counts as random, by encoding and length ("enc:n0"); what isn't in it accepts nothing.

    tests: enc, size, n0, raw. All that is collected has a bounded size, whatever the table's."""
    kinds = sorted((r.enc, r.n0) for r in tests.select("enc", "n0").distinct().collect())  # at most encodings * lengths
    by_kind = {x: levels for x in kinds if (levels := null_levels(*x))}
    if not by_kind:
        return {}
    table = ", ".join(f"('{enc}', {n0}, array({', '.join(f'{x!r}D' for x in levels)}))" for (enc, n0), levels in by_kind.items())
    levels = tests.sparkSession.sql(f"SELECT * FROM VALUES {table} AS t(enc, n0, levels)")
    where = F.expr("CAST(size(filter(levels, x -> x <= raw)) AS INT)").alias("bin")
    counts: dict[tuple[str, int], list[int]] = {}
    for r in tests.join(F.broadcast(levels), ["enc", "n0"]).groupBy("enc", "size", where).count().collect():  # at most encodings * 31 * BINS rows
        counts.setdefault((r.enc, r.size), [0] * BINS)[r.bin] += r["count"]
    added = lambda rows: [sum(x) for x in zip(*rows, strict=True)]
    out = {}
    for (enc, n0), own_levels in by_kind.items():
        size = int(log2(n0))
        for pool in ([(enc, size)], [k for k in counts if k[0] == enc], list(counts)):
            own = added([counts[k] for k in pool if k in counts]) or [0] * BINS
            if sum(own) >= CLASS_LEAST:
                break
        first = limit_of(own)
        if first is not None:
            out[f"{enc}:{n0}"] = own_levels[first - 1] if first else 0.0
    return out


def accepts(bounds: dict[str, float]):
    """A function from a test's struct to whether the token counts as random."""
    bound = F.create_map(*(F.lit(x) for pair in bounds.items() for x in pair)) if bounds else F.create_map(F.lit(""), F.lit(2.0))
    return lambda t: F.coalesce(t["raw"] >= F.try_element_at(bound, F.concat_ws(":", t["enc"], t["n0"].cast("string"))), F.lit(False))


def spans(found: DataFrame, bounds: dict[str, float]) -> DataFrame:
    """(_sec_row, kind, start, stop) of all spans; found: a written table of hits with _sec_row."""
    random, rows = accepts(bounds), None
    for k, kind in enumerate(KINDS):
        m, p = f"_{kind}_m", f"_{kind}_p"
        keep = F.col("_assign_k") if kind == "assign" else F.transform(m, lambda _: F.lit(True))
        if kind == "random":
            keep = F.transform("_tests", random)
        one = found.where(F.size(m) > 0).select("_sec_row", F.lit(k).alias("kind"), F.posexplode(F.arrays_zip(F.slice(p, 1, F.size(m)).alias("p"), F.col(m).alias("m"), keep.alias("k"))).alias("at", "x"))
        one = one.select("_sec_row", "kind", "at", F.col("x.p").alias("p"), F.col("x.m").alias("m"), F.col("x.k").alias("k"))
        rows = one if rows is None else rows.unionAll(one)
    rows = rows.repartition("_sec_row")
    upto = Window.partitionBy("_sec_row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("stop", F.sum(F.col("p") + F.col("m")).over(upto)).where("k").select("_sec_row", "kind", (F.col("stop") - F.col("m")).alias("start"), "stop")
    by_start = Window.partitionBy("_sec_row").orderBy("start", "kind", "stop")
    base = F.col("kind") < len(KINDS) - 1
    reach = F.max(F.when(base, F.col("stop"))).over(by_start.rowsBetween(Window.unboundedPreceding, 0))
    follows = F.min(F.when(base, F.col("start"))).over(by_start.rowsBetween(0, Window.unboundedFollowing))
    clear = ~F.coalesce(reach > F.col("start"), F.lit(False)) & ~F.coalesce(follows < F.col("stop"), F.lit(False))
    return rows.withColumn("_clear", base | clear).where("_clear").drop("_clear")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts and spans of every document; only rows with matches are shuffled, without their texts."""
    found = written(hits(docs).withColumn("_sec_row", F.monotonically_increasing_id()), "secret-hits")
    tests = found.select(F.explode("_tests").alias("t")).where("t IS NOT NULL").select("t.*")
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    said = F.concat_ws(":", name, F.col("start").cast("string"), F.col("stop").cast("string"))
    base = F.col("kind") < len(KINDS) - 1
    ordered = lambda keep: F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.when(keep, F.struct("start", "kind", "stop", said.alias("said"))))), lambda x: x["said"]))
    count = lambda k: F.count_if(F.col("kind") == k)
    by_row = spans(found, limits(tests)).groupBy("_sec_row").agg(count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), count(3).alias("n_random"), ordered(base).alias("_base"), ordered(F.lit(True)).alias("spans"))
    any_hit = F.lit(False)
    for kind in KINDS:
        any_hit = any_hit | (F.size(f"_{kind}_m") > 0)
    zero = F.lit(0).cast("long")
    with_hits = found.where(any_hit).select("_sec_row", "doc_id").join(by_row, "_sec_row", "left")
    with_hits = with_hits.select("doc_id", *(F.coalesce(c, zero).alias(c) for c in ("n_assign", "n_access", "n_hex", "n_random")), *(F.coalesce(c, F.lit("")).alias(c) for c in ("_base", "spans")))
    without = found.where(~any_hit).select("doc_id", *(zero.alias(c) for c in ("n_assign", "n_access", "n_hex", "n_random")), F.lit("").alias("_base"), F.lit("").alias("spans"))
    return with_hits.unionAll(without).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("_base", 256).alias("base_sha256"), "spans", "n_random")


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every secret in text replaced; the columns stay, n_chars follows, no text is shuffled."""
    tokens = F.when(F.col("text").rlike(TOKEN_RUN), F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)))
    tests = docs.select(tokens.alias("_sec_tokens")).where("_sec_tokens IS NOT NULL")
    tests = written(tests.select(F.explode(F.expr(RANDOM_SQL)).alias("t")).where("t IS NOT NULL").select("t.*"), "secret-tests")
    random = accepts(limits(tests))
    out = hinted(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_sec_row"), F.col("text").alias("_sec_text")))

    def replaced(pattern: str, there: Column, keep: Column) -> Column:
        parts = F.split("_sec_text", pattern, -1)
        joined = F.zip_with(parts, keep, lambda piece, word: F.concat(piece, F.coalesce(word, F.lit(""))))
        return F.when(there, F.array_join(joined, "")).otherwise(F.col("_sec_text"))

    whole = F.regexp_extract_all("_sec_text", F.lit(ASSIGN), F.lit(0))
    value = F.regexp_extract_all("_sec_text", F.lit(ASSIGN), F.lit(2))
    safe = F.zip_with(whole, value, lambda w, v: F.when(F.length(v) >= LEAST_VALUE, F.concat(F.substr(w, F.lit(1), F.length(w) - F.length(v)), F.lit(REDACTED))).otherwise(w))
    out = out.withColumn("_sec_text", replaced(ASSIGN, F.col("_there_assign"), safe))
    for kind in ("access", "hex"):
        out = out.withColumn("_sec_text", F.when(F.col(f"_there_{kind}"), F.regexp_replace("_sec_text", PATTERNS[kind], REDACTED)).otherwise(F.col("_sec_text")))
    out = out.withColumn("_sec_tokens", F.when(F.col("_there_random"), F.regexp_extract_all("_sec_text", F.lit(TOKEN), F.lit(0))))
    out = out.withColumn("_sec_tests", F.expr(RANDOM_SQL))
    shown = F.zip_with("_sec_tokens", F.transform("_sec_tests", random), lambda w, r: F.when(r, F.lit(REDACTED)).otherwise(w))
    out = out.withColumn("_sec_text", replaced(TOKEN, F.col("_sec_tokens").isNotNull(), shown))
    kinds, row = {f.name: f.dataType for f in docs.schema}, F.col("_sec_row")
    kept = {"text": F.col("_sec_text")}
    if "n_chars" in kinds:
        kept["n_chars"] = F.when(F.col("_sec_text") == row["text"], row["n_chars"]).otherwise(F.length("_sec_text").cast(kinds["n_chars"]))
    return out.select(*(kept.get(c, row[c]).alias(c) for c in docs.columns))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
