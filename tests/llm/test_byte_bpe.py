import base64
import random

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken

from debtscope.llm import byte_bpe
from debtscope.llm.byte_bpe import ByteBpe, decode_ids, encode_texts

with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
    RANKS = f.read()
FULL = tiktoken.Encoding(
    "own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}, special_tokens={}
)
PARTS = ["don't", "'s", "'", "''", "'l", "'ll", "'re", "we're", " ", "  ", "\n", "\n\n", " \n ", "\t", "　", "\x1c", "\x85", "12", "7", "x1", "été", "日本", "語", "。", "...", "!?", "a" * 9, "<|x|>", "\x00", "🙂", "é", " the", "ой"]


def wild(n, seed, parts=PARTS):
    return "".join(random.Random(seed).choices(parts, k=n))


def encoded(spark, rows, **options):
    df = spark.createDataFrame([(*r, 5, "r", 0.5) for r in rows], "doc_id long, text string, n int, `row` string, `begin` double").repartition(3)
    out = encode_texts(df, RANKS, P.PATTERN, **options)
    assert out.columns == ["doc_id", "n", "row", "begin", "ids"]
    back = decode_ids(out, RANKS, P.PATTERN).collect()
    assert all((r.n, r.row, r.begin) == (5, "r", 0.5) for r in back)
    return sorted((r.doc_id, r.ids, bytes(r.decoded)) for r in back)


def whole(rows):
    return sorted((i, FULL.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)


def test_every_code_point_like_the_library():
    codec = ByteBpe(RANKS, P.PATTERN)
    for at in range(0, 0x110000, 4096):
        text = "".join(f"a{c}b {c} 1{c}{c}  {c}." for c in map(chr, range(at, at + 4096)) if not 0xD800 <= ord(c) <= 0xDFFF)
        assert np.frombuffer(codec.encode(text), np.int32).tolist() == FULL.encode_ordinary(text)


@pytest.mark.parametrize("own,shared", [(5, 3), (16, 8), (40, 40), (300, 20)])
def test_chunks_join_to_the_whole(spark, own, shared):
    rows = [(i, wild(n, i)) for i, n in enumerate([0, 1, 4, 30, 200, 200, 200])]
    rows += [(20, "a" * 900 + " b"), (21, " " * 500 + "x"), (22, "'" * 400 + "s's's" * 60), (23, "\n" * 301), (24, "日本語" * 150 + "。" + "日本" * 60)]
    rows += [(25, wild(300, 9, ["'s", "'", "l", "'ll", "e"])), (26, wild(300, 8, [" ", "\n", "x"])), (27, None), (28, ""), (28, ""), (20, "a" * 900 + " b")]
    assert encoded(spark, rows, chunk=own, overlap=shared) == whole(rows)


def test_boundaries_that_chunks_give_on_are_true():
    codec = ByteBpe(RANKS, P.PATTERN)
    for seed in range(60):
        text, own = wild(80, seed), 30
        true = {m.start() for m in codec.pattern.finditer(text)} | {len(text)}
        for at in range(0, max(len(text) - 20, 1), own):
            piece = text[at : at + own + 20]
            _, tail = codec.seams(piece, own, at == 0, at + len(piece) == len(text))
            assert {at + b for b in tail} <= true


def test_very_long_texts(spark):
    rows = [(1, wild(300_000, 1)), (2, "word " * 250_000), (3, "x" * 200_000), (4, "short")]
    assert encoded(spark, rows) == whole(rows)


def test_memory_and_seams_of_batches(spark, monkeypatch):
    monkeypatch.setattr(byte_bpe, "_IDS", 7)
    codec = ByteBpe(RANKS, P.PATTERN)
    texts = [wild(n, n) for n in (0, 3, 9, 0, 40)]
    got = [(n, ids.to_pylist()) for n, ids in byte_bpe._lists(codec.encode(t) for t in texts)]
    assert [x for _, ids in got for x in ids] == [FULL.encode_ordinary(t) for t in texts] and sum(n for n, _ in got) == 5


def test_empty_table_and_odd_ids(spark):
    assert encoded(spark, []) == []
    df = spark.createDataFrame([(1, [None, 3]), (2, None), (3, [])], "k int, ids array<int>")
    got = {r.k: bytes(r.decoded) for r in decode_ids(df, RANKS, P.PATTERN).collect()}
    assert got == {1: FULL.decode_bytes([3]), 2: b"", 3: b""}


def test_text_column_alone(spark):
    df = spark.createDataFrame([("hello there",), ("a b " * 50,)], "text string")
    got = sorted(r.ids for r in encode_texts(df, RANKS, P.PATTERN, chunk=20, overlap=5).collect())
    assert got == sorted(FULL.encode_ordinary(t) for t in ("hello there", "a b " * 50))


def test_pattern_has_the_properties_that_stitching_needs():
    """No pre-token reaches from a letter, a digit or a mark into white space, or from a letter or digit into another kind."""
    p = regex.compile(P.PATTERN)
    assert not any(regex.search(r"\p{L}\P{L}|\p{N}\P{N}|\S\s", m) for seed in range(50) for m in p.findall(wild(300, seed)))
