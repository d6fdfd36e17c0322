"""Token counts and packing against the tokenizers library."""

import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import best_fit_pack as B
from gridloom.llm import token_counts as C
from gridloom.llm.tokens import encoder
from tests.llm import cases

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
TOKENIZER.encode_special_tokens = True
ids_of = lambda text: TOKENIZER.encode(text or "", add_special_tokens=False).ids
#: The contract's call of op8: special strings are their ids.
PLAIN = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
plain_ids = lambda text: PLAIN.encode(text or "", add_special_tokens=False).ids


def check_pack(rows, docs, size=1024):
    by_piece = sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want = []
    for d, text in docs:
        ids = [*plain_ids(text), 2]
        first = (len(ids) - 1) % size + 1
        cuts = [0, *range(first, len(ids), size), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want.append((str(d), k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))))
    assert by_piece == sorted(want)
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(sequences), sum(r.length for r in rows)


def best_fit_decreasing(lengths, size=1024):
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [(room, k) for k, room in enumerate(rooms) if room >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(size - n)
    return len(rooms)


def test_pack_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = B.op8_best_fit_pack(spark, sf).collect()
    n, total = check_pack(rows, docs)
    assert n <= best_fit_decreasing([r.length for r in rows]) * 1.005 + 1 and n >= -(-total // 1024)


def test_pack_edge_cases(spark):
    check_pack(B.packed(cases.documents(spark)).collect(), [(r[0], r[1]) for r in cases.rows()])
    assert B.packed(cases.empty(spark)).count() == 0


def test_a_hot_length_is_ranked_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(B, "BUCKET_ROWS", 10)
    docs = [(k, "same words") for k in range(150)] + cases.generated(60)
    n, total = check_pack(B.packed(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect(), docs)
    assert n <= total / 1024 * 1.05 + 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200), st.sampled_from([1, 4, 16]))
def test_plans_place_every_document_once(lengths, groups):
    counts = np.bincount(lengths, minlength=65)
    made = B.plan(counts, groups, 64)
    placed: dict = {}
    rooms: dict = {}
    for length, rank0, n, each, first_seq, offset in made.runs:
        for k in range(n):
            assert (length, rank0 + k) not in placed
            seq, at = first_seq + k // each, offset + k % each * length
            placed[length, rank0 + k] = seq
            rooms.setdefault(seq, []).append((at, length))
    assert set(placed) == {(n, r) for n in range(65) for r in range(counts[n])}
    for own in rooms.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert len(rooms) == made.n


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_the_best_plan_is_about_as_good_as_best_fit_decreasing(lengths):
    """A plan of few groups rounds much and wastes room (one group: [8, 8, 8, 33] takes 4 sequences); the best one doesn't."""
    assert B.best_plan(np.bincount(lengths, minlength=65), 64).n <= best_fit_decreasing(lengths, 64) * 1.03 + 1


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=120))
def test_both_forms_of_the_vocabulary_agree(text):
    assert encode(text).tolist() == ids_of(text)


encode, encode_special = encoder(), encoder(special=True)
SPECIAL = ["<|endoftext|>", "a<|endoftext|>b", "a <|endoftext|> <|endoftext|>", "<|endoftext", "x" * 5000 + "<|endoftext|>" * 3 + "y z"]


@pytest.mark.parametrize("text", SPECIAL)
def test_special_strings(text):
    assert encode_special(text).tolist() == plain_ids(text)
    assert (plain_ids(text) != ids_of(text)) == ("<|endoftext|>" in text)


def test_pack_special_strings(spark):
    docs = list(enumerate(SPECIAL * 2))
    check_pack(B.packed(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs)


def test_plans_round_to_few_sizes_and_waste_little(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect()]
    sizes = np.array([len(encode(t or "")) + 1 for t in texts])
    first = (sizes - 1) % 1024 + 1
    documents = np.bincount(np.append(first, np.full(int((sizes - first).sum()) // 1024, 1024)), minlength=1025)
    logs = np.bincount(np.clip(np.random.default_rng(1).lognormal(5.7, 0.8, 30_000).astype(int), 1, 1024), minlength=1025)
    for counts in (documents, logs, logs * 10_000_000):
        made = B.best_plan(counts)
        assert len(made.sizes) <= B.MOST_SIZES and len(made.sizes) * 10 < (counts[128:] > 0).sum()
        assert made.n <= int((counts * np.arange(1025)).sum()) / 1024 * 1.01 and len(made.runs) < 10_000


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=5, unique=True), st.lists(st.integers(0, 4), min_size=5, max_size=5), st.integers(0, 40))
def test_fillings_are_the_best(sizes, left, room):
    import itertools

    sizes = sorted(sizes, reverse=True)
    left = left[: len(sizes)]
    out = B.filling(sizes, left, room)
    assert all(0 <= a <= b for a, b in zip(out, left, strict=True))
    sums = (sum(s * k for s, k in zip(sizes, ks, strict=True)) for ks in itertools.product(*(range(n + 1) for n in left)))
    assert sum(s * k for s, k in zip(sizes, out, strict=True)) == max(x for x in sums if x <= room)


@pytest.mark.parametrize("text", ["<|endoftext|>", "a\u0000b", "  \n\n\t x  ", "1234567 'll I'LL", "\U0001f600‍", "日本語のテキスト", "é" * 50, "\r\n  　"])
def test_odd_texts(text):
    assert encode(text).tolist() == ids_of(text)


def test_token_counts_of_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r.n_tokens for r in C.op7_token_counts(spark, sf).collect()}
    assert got == {r.doc_id: len(ids_of(r.text)) for r in docs}


def test_token_counts_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_IDS", 64)
    blocks, order = C.flat_files(cases.documents(spark))
    out = order.join(C.scan(blocks, block_ids=64), ["file", "ordinal"])
    assert sorted((str(r.doc_id), r.n_tokens) for r in out.collect()) == sorted((str(r[0]), len(ids_of(r[1]))) for r in cases.rows())
    blocks, order = C.flat_files(cases.empty(spark))
    assert order.count() == 0 and C.scan(blocks).count() == 0


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
@pytest.mark.parametrize("top", [2, 4096])
def test_separator_scan_stitches_blocks(spark, monkeypatch, block, top):
    monkeypatch.setattr(C, "SUPER", top)
    rng = np.random.default_rng(block)
    files = {k: rng.integers(0, 5, n) for k, n in enumerate((0, 1, 50, 121))}
    files[9] = np.full(4, 4)
    rows = [(k, b, bytearray(x[b * block : (b + 1) * block].astype("<u2").tobytes())) for k, x in files.items() for b in range(-(-len(x) // block))]
    out = C.scan(spark.createDataFrame(rows, "file long, block long, ids binary").repartition(3), end=4, block_ids=block).collect()
    want = []
    for k, x in files.items():
        start = ordinal = 0
        for at in np.flatnonzero(x == 4):
            want.append((k, ordinal, start, at - start, True))
            start, ordinal = at + 1, ordinal + 1
        if start < len(x):
            want.append((k, ordinal, start, len(x) - start, False))
    assert sorted((r.file, r.ordinal, r.start, r.n_tokens, r.finished) for r in out) == sorted(want)


def test_files_of_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_IDS", 4)
    (tmp_path / "a.bin").write_bytes(np.array([1, 2, 9, 3, 9, 9, 7], "<u2").tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}/*.bin").select("path", "length")
    out = C.scan(C.blocks_of(files), end=9, block_ids=4).orderBy("ordinal").collect()
    assert [(r.start, r.n_tokens, r.finished) for r in out] == [(0, 2, True), (3, 1, True), (5, 0, True), (6, 1, False)]


def test_a_torn_last_id_is_no_token(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_IDS", 4)
    ids = np.array([1, 9, 3, 4, 5, 9, 7], "<u2").tobytes()
    for name, torn in (("a.bin", b"\x09"), ("b.bin", b"\x01")):
        (tmp_path / name).write_bytes(ids + torn)
    (tmp_path / "c.bin").write_bytes(b"\x05")
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}/*.bin").select("path", "length")
    out = C.scan(C.blocks_of(files), end=9, block_ids=4).orderBy("file", "ordinal").collect()
    assert [(r.start, r.n_tokens, r.finished) for r in out] == [(0, 1, True), (2, 3, True), (6, 1, False)] * 2


def test_a_sparse_file_beyond_two_gib_is_read_in_ranges(spark, tmp_path):
    """The last block of a file of 2.5 GiB, by itself."""
    size = 5 << 29
    with open(tmp_path / "large.bin", "wb") as f:
        f.truncate(size)
        f.seek(size - 6)
        f.write(np.array([9, 3, 9], "<u2").tobytes())
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}/large.bin").select("path", "length")
    blocks = C.blocks_of(files)
    assert files.first().length == size and blocks.count() == -(-size // (2 * C.BLOCK_IDS))
    last = -(-size // (2 * C.BLOCK_IDS)) - 1
    out = C.scan(blocks.where(F.col("block") == last), end=9).orderBy("ordinal").collect()
    assert [(r.start, r.n_tokens) for r in out][1:] == [(size // 2 - 2, 1)]
