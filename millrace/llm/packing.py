"""Best-fit packing of token sequences by exact-complement hashing.

Documents become ids; longer ones are cut into whole sequences and one shorter first piece. How
many pieces there are of each length is all that the plan needs: at most `size` counts. The plan takes
lengths from the longest down, looks the gap that it leaves up among single, pair and triple sums of the
lengths still available, uses up such exact fillings, and packs the rest best-fit. Pieces then find
their places by their rank among those of their length.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._shared import materialize, tokenizer_path

SIZE, END_ID = 1024, 2
#: Pieces of one length that a task ranks, and the most counts that come to the driver, but for one a length.
RANKED, COUNTS = 2_000, 100_000
_ENCODERS: dict[str, Callable[[str], bytes]] = {}


def encoder(path: str) -> Callable[[str], bytes]:
    """text -> ids as little-endian unsigned 32-bit bytes, for a byte-level BPE in ranks form. Added tokens
    are text like any other here."""
    if path not in _ENCODERS:
        import tiktoken

        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        ids = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        _ENCODERS[path] = lambda text: np.array(ids(text), "<u4").tobytes()
    return _ENCODERS[path]


def published_encoder(path: str) -> Callable[[str], bytes]:
    """encoder(), and the ids of the tokens that the published file, the JSON beside `path`, adds to the
    ranks: texts are split at these."""
    name = path.removesuffix(".tiktoken") + ".json"
    if name not in _ENCODERS:
        with open(name, "rb") as f:
            added = json.load(f)["added_tokens"]
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{name}: added tokens that take more than their own text")
        plain, ids = encoder(path), {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added}
        split = re.compile("(" + "|".join(re.escape(t) for t in sorted(ids, key=len, reverse=True)) + ")").split
        _ENCODERS[name] = (lambda text: b"".join(ids[part] if k % 2 else plain(part) for k, part in enumerate(split(text)) if part)) if ids else plain
    return _ENCODERS[name]


_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


def _pieces(path: str, size: int, end_id: int, with_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = published_encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                ids, piece, start, length, crc, kept = [], [], [], [], [], []
                part = batch.slice(at, 200)
                for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"], strict=True):
                    all_ids = encode(text.as_py() or "") + end
                    n, begin, k = len(all_ids) // 4, 0, 0
                    while begin < n:
                        take = (n - begin) % size or size
                        own = all_ids[4 * begin : 4 * (begin + take)]
                        ids.append(doc_id), piece.append(k), start.append(begin), length.append(take), crc.append(zlib.crc32(own)), kept.append(own if with_ids else None)
                        begin, k = begin + take, k + 1
                yield pa.RecordBatch.from_arrays([pa.array(a, f.type) for a, f in zip((ids, piece, start, length, crc, kept), _PIECE, strict=True)], schema=_PIECE)

    return run


def cut(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of the documents' ids: doc_id, piece, start, length, ids_crc32 (and ids, if asked for).

    Ids are those of the published tokenizer, added tokens included. A null or empty text is the end id alone. A document of more than `size` ids is cut into whole
    pieces of `size` from its end; what is left is the first, shorter piece.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return read.mapInArrow(_pieces(tokenizer, size, end_id, with_ids), "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in one sequence) and how many sequences use each; every piece is used once.

    Works on counts of lengths, so its cost depends on `size`, not on the number of pieces.
    """
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out: list[tuple[tuple[int, ...], int]] = []

    def use(pattern: tuple[int, ...], times: int) -> None:
        if times > 0:
            for length in pattern:
                left[length] -= times
            out.append((pattern, int(times)))

    def times(pattern: tuple[int, ...]) -> int:
        return min(int(left[x]) // pattern.count(x) for x in set(pattern))

    use((size,), int(left[size]))
    for a in range(size - 1, size // 2 - 1, -1):  # single sums
        use((a, size - a), times((a, size - a)))
    for a in range(size - 2, size // 3, -1):  # pair sums
        for b in range(min(a, size - a - 1), (size - a + 1) // 2 - 1, -1):
            if not left[a]:
                break
            c = size - a - b
            if left[b] and left[c]:
                use((a, b, c), times((a, b, c)))
    pairs: dict[int, list[tuple[int, int]]] = {}  # triple sums: a third length and a pair sum
    alive = [x for x in range(1, size) if left[x]]
    for i, c in enumerate(alive):
        for d in alive[: i + 1]:
            if c + d < size:
                pairs.setdefault(c + d, []).append((c, d))
    for a in reversed(alive):
        for b in reversed(alive):
            if not left[a]:
                break
            if b <= a and left[b] and a + b < size:
                for c, d in pairs.get(size - a - b, ()):
                    if c <= b and left[a] and left[b] and left[c] and left[d]:
                        use((a, b, c, d), times((a, b, c, d)))
    # Best fit for the rest: classes of equal open sequences, by gap.
    gaps: list[tuple[int, tuple[int, ...]]] = []
    open_: dict[tuple[int, ...], int] = {}

    def put(pattern: tuple[int, ...], n: int) -> None:
        if pattern not in open_:
            insort(gaps, (size - sum(pattern), pattern))
        open_[pattern] = open_.get(pattern, 0) + n

    for x in range(size - 1, 0, -1):
        n = int(left[x])
        while n:
            at = bisect_left(gaps, (x,))
            if at == len(gaps):
                fit = min(n, max(1, n // max(1, size // x)) if size // x > 1 else n)
                put((x,), fit)
                n -= fit
                continue
            _, pattern = gaps[at]
            fit = min(n, open_[pattern])
            open_[pattern] -= fit
            if not open_[pattern]:
                del open_[pattern]
                gaps.pop(at)
            put((*pattern, x), fit)
            n -= fit
    out += list(open_.items())
    return out


def _places(patterns: list[tuple[tuple[int, ...], int]], size: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks, first sequences and offsets of the runs that its pieces fill."""
    used: dict[int, int] = {}
    runs: dict[int, list[tuple[int, int, int]]] = {}
    first = 0
    for pattern, n in patterns:
        at = 0
        for length in pattern:
            rank = used.get(length, 0)
            runs.setdefault(length, []).append((rank, first, at))
            used[length] = rank + n
            at += length
        first += n
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in runs.items()}


def pack(pieces: DataFrame, size: int = SIZE, ranked: int = RANKED) -> DataFrame:
    """pieces with sequence_id and offset: sequences of at most `size` tokens without gaps inside.

    Pieces are told apart by a number of their row, which is written with them; which of one length takes which place is open. A
    length that many pieces have, repeated rows or not, is dealt to as many salts as it has `ranked` pieces (more, where that would be over
    COUNTS salts in all), ranks are taken inside (length, salt) and shifted by the counts of the salts before; so a
    length that a third of all pieces have is no single task's, and at most size + COUNTS counts come to the driver, whatever
    the table's size. Repeated rows are pieces of their own. Columns named sequence_id or offset are
    replaced; names that begin with two underscores are this function's own. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    own = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    pieces = materialize(pieces.select(*own).withColumn("__row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    per = max(ranked, -(-sum(counts.values()) // COUNTS))
    salts = np.array([-(-counts.get(length, 0) // per) for length in range(size + 1)], np.int64)
    many = F.element_at(F.array(*(F.lit(int(max(1, n))) for n in salts)), F.col("length").cast("int") + 1)
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64("__row"), many).cast("int"))
    base = np.cumsum(salts) - salts
    shift = np.zeros(int(salts.sum()) + 1, np.int64)
    held = sorted((r["length"], r["__salt"], r["n"]) for r in salted.groupBy("length", "__salt").agg(F.count("*").alias("n")).collect())
    before = dict.fromkeys(counts, 0)
    for length, salt, n in held:
        shift[base[length] + salt] = before[length]
        before[length] += n
    places = spark.sparkContext.broadcast((base, shift, _places(plan(counts, size), size)))
    order = Window.partitionBy("length", "__salt").orderBy("__row")
    placed = salted.withColumn("__rank", F.row_number().over(order) - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, shift, runs = places.value
        for batch in batches:
            length = batch["length"].to_numpy(zero_copy_only=False)
            rank = batch["__rank"].to_numpy(zero_copy_only=False) + shift[base[length] + batch["__salt"].to_numpy(zero_copy_only=False)]
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                first, at, off = runs[int(x)]
                mine = np.flatnonzero(length == x)
                run = np.searchsorted(first, rank[mine], "right") - 1
                sequence[mine] = at[run] + rank[mine] - first[run]
                offset[mine] = off[run]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in own), pa.array(sequence), pa.array(offset)], names=[*own, "sequence_id", "offset"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(*own).schema)
    return placed.mapInArrow(place, f"{types}, sequence_id long, offset long")


def packed(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """cut() and pack() in one: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(cut(docs, tokenizer or tokenizer_path("byte_bpe_50k.tiktoken"), size, end_id).drop("ids"), size)
