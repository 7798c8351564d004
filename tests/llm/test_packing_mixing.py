"""Packing and mixing: whole round trips, places without gaps, targets, odd rows."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import mixing, packing
from millrace.llm._shared import tokenizer_path

RANKS = tokenizer_path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


def test_ids_are_those_of_the_published_tokenizer(reference):
    unit = random.Random(2)
    bits = ["a", "the", " ", "  ", "\n", "\t", "é", "'s", "12", "!!", "<|endoftext|>", " ", "\x1c", "日本", "   "]
    encode = packing.published_encoder(RANKS)
    for _ in range(3000):
        text = "".join(unit.choice(bits) for _ in range(unit.randint(0, 12)))
        assert [*np.frombuffer(encode(text), "<u4"), 2] == reference(text)


def test_added_tokens_have_their_own_ids(spark):
    published = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    unit, end, encode = random.Random(3), "<|endoftext|>", packing.published_encoder(RANKS)
    bits = ["a", "the", " ", "\n", "'s", "12", "<|", "|>", "<|endof", end, "é", "   "]
    texts = ["a <|endoftext|> b", end, end * 2, f" {end} ", "".join(f"{end}x" for _ in range(200))]
    texts += ["".join(unit.choice(bits) for _ in range(unit.randint(0, 12))) for _ in range(3000)]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == published.encode(text, add_special_tokens=False).ids
    [got] = packing.packed(spark.createDataFrame([(1, texts[0])], "doc_id long, text string"), RANKS).collect()
    assert (got.length, got.ids_crc32) == (5, zlib.crc32(np.array([64, 220, 50256, 275, 2], "<u4").tobytes()))


def test_pieces_and_places(spark, reference):
    unit = random.Random(4)
    rows = [(k, " ".join("word" if unit.random() < 0.5 else "x" * unit.randint(1, 9) for _ in range(unit.randint(1, 60)))) for k in range(300)]
    rows += [(900, None), (901, ""), (902, "long text " * 4000), (903, "a b c"), (903, "a b c"), (None, "no id")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, length int")
    got = packing.packed(df, RANKS, size=128).collect()
    text, by_doc, by_sequence = dict(rows), defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert {k for k, _ in rows} == set(by_doc)
    for doc_id, pieces in by_doc.items():
        ids = reference(text[doc_id])
        times = 2 if doc_id == 903 else 1
        assert sum(p.length for p in pieces) == times * len(ids)
        for p in pieces:
            own = ids[p.start : p.start + p.length]
            assert p.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes()) and len(own) == p.length
            assert p.length == 128 or p.piece == 0
    total = sum(r.length for r in got)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 128
    assert len(by_sequence) <= 1.05 * -(-total // 128) + 1


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once_and_few_sequences(seed):
    unit = np.random.default_rng(seed)
    lengths = unit.integers(1, 65, 3000) if seed % 2 else np.minimum(64, unit.geometric(0.08, 3000))
    counts = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
    patterns, used = packing.plan(counts, 64), defaultdict(int)
    for pattern, n in patterns:
        assert sum(pattern) <= 64 and n > 0
        for x in pattern:
            used[x] += n
    assert dict(used) == counts
    least = max(-(-int(lengths.sum()) // 64), int((lengths > 32).sum()))
    assert sum(n for _, n in patterns) <= 1.02 * least + 1


def test_plan_of_extremes():
    assert packing.plan({}) == []
    assert sum(n for _, n in packing.plan({1: 5000}, 64)) == -(-5000 // 64)
    assert packing.plan({64: 3}, 64) == [((64,), 3)]
    assert sorted(packing.plan({40: 2, 20: 4, 4: 2}, 64)) == [((20, 20), 1), ((40, 20, 4), 2)] or sum(n for _, n in packing.plan({40: 2, 20: 4, 4: 2}, 64)) == 3


def test_empty_packing(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string"), RANKS).collect() == []


def test_targets_share_the_excess():
    got = mixing.targets([("a", 100), ("b", 100), ("c", 100)], [3, 1, 2])
    assert sum(got) == pytest.approx(450) and got[0] == 200 and got[1] == pytest.approx(250 / 3) and got[2] == pytest.approx(500 / 3)
    assert mixing.targets([("a", 10)], [3]) == [15]
    assert mixing.targets([("a", 0), (None, 10)], [3, 1]) == [0, 15]
    assert mixing.targets([], []) == []


def test_mix_meets_targets_and_repeats(spark):
    unit = random.Random(6)
    names = ["b", "a", None, "c", "é"]
    rows = [(k, unit.choice(names), "w " * unit.randint(0, 80), 7) for k in range(2000)]
    rows += [(3000, "a", None, 7), (3001, "big", "x " * 30000, 7), (3002, "a", "same text", 7), (3002, "a", "same text", 7), (None, "a", "y y", 7)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, size int")
    got = mixing.mix(df, block=100).collect()
    assert len(got) == len(rows)
    taken, by, longest = defaultdict(int), {}, defaultdict(int)
    for r in got:
        assert r.size == len((r.text or "").split()) and 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
        longest[r.source] = max(longest[r.source], r.size)
        by[r.source] = (r.source_size, r.target)
    sizes = defaultdict(int)
    for _, s, t, _ in rows:
        sizes[s] += len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = mixing.targets([(s, sizes[s]) for s in order], [(3, 1, 2)[k % 3] for k in range(len(order))])
    for s, t in zip(order, want, strict=True):
        assert by[s] == (sizes[s], pytest.approx(t))
        assert abs(taken[s] - t) <= longest[s]
    pick = lambda rs: sorted((r.doc_id or -1, r.size, r.copies) for r in rs)
    assert pick(mixing.mix(df.repartition(7), block=100).collect()) == pick(got)


def test_pivotal_keeps_expected_words():
    unit = np.random.default_rng(3)
    rows = [(k, int(unit.integers(1, 50)), float(unit.uniform(0.05, 0.95))) for k in range(12)]
    sums = np.zeros(12)
    for seed in range(4000):
        done = mixing._pivot(rows, np.random.default_rng(seed))
        assert sum(s * p for _, s, p in done) == pytest.approx(sum(s * p for _, s, p in rows))
        assert sum(0 < p < 1 for _, _, p in done) <= 1
        for key, _, p in done:
            sums[key] += p
    assert np.abs(sums / 4000 - [p for _, _, p in rows]).max() < 0.04


def test_pivotal_of_equal_rows_keeps_words():
    for seed in range(50):
        done = mixing._pivot([(k, 3, 0.5) for k in range(101)], np.random.default_rng(seed))
        assert len(done) == 101 and sum(s * p for _, s, p in done) == pytest.approx(3 * 50.5)


def test_mix_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string, text string")).collect() == []
    only = spark.createDataFrame([(1, "a", ""), (2, "a", None)], "doc_id long, source string, text string")
    assert [r.copies for r in mixing.mix(only).select(F.col("copies")).collect()] == [0, 0]


def test_names_of_columns_do_not_clash(spark):
    names = ["base", "p", "one", "blocks", "source_no", "name", "row_id", "key", "often", "doc", "block", "size", "target"]
    rows = [(k, f"s{k % 2}", "w " * (k % 7), *(f"{n}{k}" for n in names)) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, " + ", ".join(f"{n} string" for n in names))
    got = mixing.mix(df).collect()
    assert len(got) == 60 and set(got[0].asDict()) == {*df.columns, "source_size", "copies"}
    for r in got:
        assert all(r[n] == f"{n}{r.doc_id}" for n in names if n not in ("size", "target"))
        assert r.size == len(r.text.split())
    pieces = packing.cut(spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string"), RANKS)
    odd = pieces.withColumns({"sequence_id": F.lit("x"), "offset": F.lit("y"), "rank": F.lit(7), "salt": F.lit("s")})
    assert sorted((r.doc_id, r.offset, r["rank"], r.salt) for r in packing.pack(odd).collect()) == [(1, 0, 7, "s"), (2, 3, 7, "s")]


def test_a_row_that_is_repeated_often_is_many_blocks(spark):
    rows = [(1, "a", "same words here")] * 900 + [(k, "a", "w " * (k % 9 + 1)) for k in range(2, 300)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), share=0.5, block=100).collect()
    assert len(got) == len(rows) and abs(sum(r.copies * r["size"] for r in got) - got[0].target) <= 9


def test_lengths_that_many_pieces_have_are_dealt_to_salts(spark):
    df = spark.createDataFrame([(k, "a b c" if k % 3 else "a " * (k % 40)) for k in range(2000)], "doc_id long, text string")
    got = packing.pack(packing.cut(df, RANKS, size=64), size=64, ranked=20).collect()
    spans = defaultdict(list)
    for r in got:
        spans[r.sequence_id].append((r.offset, r.length))
    assert len(got) == 2000
    for own in spans.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64


def test_repeated_rows_are_dealt_to_many_tasks(spark):
    """100,000 equal pieces: as many salts as pieces of other lengths have, and places without gaps."""
    one = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(100).cast("long").alias("length"), F.lit(5).cast("long").alias("ids_crc32"))
    placed = packing.pack(one)
    assert placed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    of = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list("offset")).alias("at"))
    assert of.count() == 10_000 and of.where(F.col("at") != F.array(*(F.lit(100 * k).cast("long") for k in range(10)))).count() == 0
    row = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(-(-100_000 // packing.RANKED)))
    salts = one.groupBy(row.alias("salt")).count().collect()
    assert len(salts) == 50 and max(r["count"] for r in salts) < 2 * packing.RANKED
