"""Byte-level BPE against tiktoken and against merges as defined; round trips; odd rows."""

import base64
import hashlib
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import byte_bpe, registry

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    return byte_bpe.load(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def theirs():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def ids(own, text):
    return np.frombuffer(own.ids(text), "<i4").tolist()


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(), st.text("etaoins hr'\n\t.,1"), st.lists(st.sampled_from(["the", " ", "  ", "ing", "'s", "'re", "\n", "\t", "!!", "==", "中国", "的", "и", "т", "12", "a", "\x1c", "\x85", "　", "ä", "😀"])).map("".join)))
def test_as_tiktoken(own, theirs, text):
    assert ids(own, text) == theirs(text)


def test_code_points_of_all_planes(own, theirs):
    """All up to the Chinese letters, and one in 17 behind."""
    points = [c for c in (*range(0x3000), *range(0x3000, 0x110000, 17)) if not 0xD800 <= c < 0xE000]
    for begin in range(0, len(points), 256):
        text = "".join(f"a{chr(c)} {chr(c)}1{chr(c)}.{chr(c)}" for c in points[begin : begin + 256])
        assert ids(own, text) == theirs(text), hex(points[begin])


def test_random_letters_of_a_later_unicode(own, theirs):
    r = random.Random(4)
    late = sorted(own.later_letters)
    for _ in range(200):
        text = "".join(chr(r.choice(late)) if late and r.random() < 0.2 else chr(r.randrange(0x20, 0x3000)) for _ in range(30))
        assert ids(own, text) == theirs(text)


def test_pairs_against_merges(own):
    r = random.Random(1)
    for k in range(20_000):
        a, b = r.randrange(3000 if k % 2 else len(own.ranks)), r.randrange(3000 if k % 2 else len(own.ranks))
        assert own.compatible(a, b) == (own.merge(own.bytes[a] + own.bytes[b]) == [a, b])


def test_small_vocabularies_against_merges():
    """Vocabularies of few letters, where dead ends and ties are common; also ranks out of the order of merges."""
    r = random.Random(2)
    for n in range(20):
        tokens = [bytes([k]) for k in range(256)]
        while len(tokens) < 256 + 30:
            new = r.choice(tokens[97:100] + tokens[256:]) + r.choice(tokens[97:100] + tokens[256:])
            if len(new) < 12 and new not in tokens:
                tokens.append(new)
        if n % 3 == 2:
            tokens[256:] = r.sample(tokens[256:], len(tokens) - 256)
        own = byte_bpe.Encoder({t: k for k, t in enumerate(tokens)}, r"[a-c]+")
        for _ in range(60):
            text = "".join(r.choice("abc") for _ in range(r.randrange(1, 40)))
            want = [own.ranks[text.encode()]] if text.encode() in own.ranks else own.merge(text.encode())
            assert own.merged(text.encode()) == want


def test_long_pieces(own, theirs):
    for text in ("a" * 200_000, "ab" * 30_000, " " * 60_000 + "x", "ä" * 50_000, "".join(random.Random(3).choice("etaoinshr") for _ in range(60_000))):
        assert ids(own, text) == theirs(text)


def test_memory_is_bounded(own, theirs, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 8)
    text = " ".join(f"word{k}, {k}x" for k in range(300))
    assert ids(own, text) == theirs(text) and len(own.later) <= 8 and len(own.later.old) <= 8 and len(own.fits) <= max(8, len(own.fits))


def test_rows(spark, theirs):
    rows = [(1, "Hello, wörld!  \n x", 7), (2, None, 8), (3, "", 9), (3, "", 9), (None, "a\x00b", 1), (4, "x" * 30_000, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = byte_bpe.decode(byte_bpe.encode(df)).collect()
    assert sorted((r.doc_id or 0, r.text, r.ids, bytes(r.decoded)) for r in out if r.text is not None) == sorted((i or 0, t, theirs(t), t.encode()) for i, t, _ in rows if t is not None)
    assert [(r.ids, bytes(r.decoded)) for r in out if r.text is None] == [([], b"")]
    assert byte_bpe.encode(df.limit(0)).collect() == [] and byte_bpe.decode(byte_bpe.encode(df.limit(0))).collect() == []
    some = spark.createDataFrame([(1, [15496, 11]), (2, None), (3, [])], "doc_id long, ids array<int>").coalesce(1)
    assert [r.decoded and bytes(r.decoded) for r in byte_bpe.decode(some).orderBy("doc_id").collect()] == [b"".join(byte_bpe.load(PATH, public_tokenizers.PATTERN).bytes[i] for i in (15496, 11)), None, bytearray()]


def test_query_against_brute_force(spark, theirs):
    folder = "/root/testdata/sf0.001"
    want = []
    for doc_id, text in duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{folder}/documents.parquet'").fetchall():
        own = theirs(text)
        want.append((doc_id, len(own), hashlib.sha256(",".join(map(str, own)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, registry.op12_byte_bpe(spark, folder).collect())) == sorted(want)
