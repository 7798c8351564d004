"""Byte-level BPE, encoding by backtracking in linear time, and decoding.

A piece of text is looked at as Latin-1 characters, one a byte, so that an Aho-Corasick automaton of all tokens finds the longest
token at a place. The encoder takes longest tokens from the left. A token must be compatible with the one before
it: the merges of the two's bytes must end in just these two, which is looked up once a pair. Where it is not, the next shorter token
is tried; where none is left, the token before is taken back and the place marked as a dead end. Each place is left
for good once at most, and a sequence of which all neighbours are compatible is what the merges give.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._shared import tokenizer_path

#: Chunks and pairs that a worker remembers; chunks of more characters are encoded each time. Documents a batch.
REMEMBERED, REMEMBERED_CHARS, BATCH = 3 << 18, 64, 128
#: Where a space is followed by what no reading of \s takes for space, a match of the pattern begins at that space,
#: and what is before it is matched alike without what follows.
_CHUNK = re.compile(r" (?=[^\s\x1c-\x1f\x85])")
_LOADED: dict[tuple[str, str], Encoder] = {}


class _Chunks(dict):
    """The ids of a chunk as 32-bit bytes, by the chunk; found when first asked for. What was not asked for since half of
    REMEMBERED others came is forgotten."""

    def __init__(self, encoder: Encoder, before: str):
        super().__init__()
        self.encoder, self.before, self.old = encoder, before, {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            encoder = self.encoder
            pieces = encoder.pieces(self.before + chunk)
            if len(pieces) > 1 and len(chunk) <= REMEMBERED_CHARS:
                ids = b"".join([encoder.later[p[1:]] if p[0] == " " else encoder.first[p] for p in pieces])
            else:
                ids = b"".join([array("i", encoder.merged(p.encode())).tobytes() for p in pieces])
        if len(chunk) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED // 2:
                self.old = dict(self)
                self.clear()
            self[chunk] = ids
        return ids


def _later_letters(regex: ModuleType) -> dict[int, str]:
    """Letters and numbers of a later Unicode than tiktoken's, to be looked at as what they are there: neither."""
    import tiktoken

    kind, bytes_ = r"[\p{L}\p{N}]", {bytes([k]): k for k in range(256)}
    here = "".join(regex.findall(kind, "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    there = bytes(tiktoken.Encoding("letters", pat_str=kind, mergeable_ranks=bytes_, special_tokens={}).encode_ordinary(here)).decode()
    return {ord(c): "\ue000" for c in set(here) - set(there)}


class Encoder:
    """Text to ids and back by the ranks of a vocabulary that holds all single bytes.

    The ids are those of merging, in each match of the pattern, the neighbours of lowest rank first; a match that is a token is that token.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes = {i: t for t, i in ranks.items()}
        self.length = {i: len(t) for t, i in ranks.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.ordered = True
        self.whole = {i for t, i in ranks.items() if len(t) == 1}
        self.fits: dict[int, int] = {}
        self.prefixes: dict[int, int] = {}
        self.later_letters = _later_letters(regex)
        self.lowest = chr(min(self.later_letters, default=0x10FFFF))
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                self._learn(token, i)
        self.latin = ahocorasick.Automaton()
        for i in self.whole:
            self.latin.add_word(self.bytes[i].decode("latin-1"), i)
        self.latin.make_automaton()
        self.first, self.later = _Chunks(self, ""), _Chunks(self, " ")

    def pieces(self, text: str) -> list[str]:
        """The matches of the pattern in a text."""
        if not text.isascii() and max(text) >= self.lowest and (same := text.translate(self.later_letters)) != text:
            return [text[m.start() : m.end()] for m in self.pattern.finditer(same)]
        return self.pattern.findall(text)

    def _learn(self, token: bytes, i: int) -> None:
        """Finds the two parts of a token's last merge. Tokens that merges do not reach stand in no result of them and stay out."""
        for k in range(1, len(token)):
            a, b = self.ranks.get(token[:k], i), self.ranks.get(token[k:], i)
            if a in self.whole and b in self.whole and (max(a, b) < i) and self._stays(a, b, i):
                self.parts[i] = (a, b)
                self.whole.add(i)
                return
        if self.merge(token) == [i]:
            self.ordered = False  # a part ranks behind the whole, as in no trained vocabulary: neighbours alone then decide nothing
            self.whole.add(i)

    def merge(self, text: bytes) -> list[int]:
        """Merges as they are defined, in quadratic time: the neighbours of lowest rank, the leftmost of equals."""
        parts, none = [text[k : k + 1] for k in range(len(text))], 1 << 62
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, none), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == none:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _stays(self, a: int, b: int, below: int) -> bool:
        """Whether merges of rank lower than `below` leave the border between tokens a and b.

        Goes back in time: the part beside the border that was merged last is taken apart, till both are bytes. A merge over
        the border that comes before that one would have been made.
        """
        parts, ranks, said = self.parts, self.ranks, self.bytes
        while True:
            if ranks.get(said[a] + said[b], below) < below:
                return False
            left, right = parts.get(a), parts.get(b)
            if left is None and right is None:
                return True
            if right is None or (left is not None and a > b):
                below, a = a, left[1]
            else:  # of equal merges the left one, over the border, comes first
                below, b = b + 1, right[0]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges of a's and b's bytes end in a and b."""
        return self._stays(a, b, 1 << 62)

    def shorter(self, token: int) -> int:
        """The longest token that this one begins with, -1 if it is a single byte."""
        known = self.prefixes.get(token)
        if known is None:
            own = self.bytes[token]
            known = self.prefixes[token] = next((i for k in range(len(own) - 1, 0, -1) if (i := self.ranks.get(own[:k], -1)) in self.whole), -1)
        return known

    def fit(self, before: int, token: int) -> int:
        """Token, or the longest one that it begins with, that is compatible with the token before (-1: none stands before); -1 if none is."""
        key = before << 32 | token
        while token >= 0 and before >= 0 and not self.compatible(before, token):
            token = self.shorter(token)
        if len(self.fits) >= REMEMBERED:
            self.fits.clear()
        self.fits[key] = token
        return token

    def merged(self, piece: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        if not self.ordered:
            return self.merge(piece)
        text, n = piece.decode("latin-1"), len(piece)
        matches, fits, length = self.latin.iter_long, self.fits, self.length
        dead = bytearray(n + 1)
        out: list[int] = []
        at, before = 0, -1
        scan = matches(text)  # goes on from longest match to longest match, for as long as these are taken
        last, token = next(scan)
        while True:
            fit = fits.get(before << 32 | token)
            token = self.fit(before, token) if fit is None else fit
            if token >= 0:
                end = at + length[token]
                if not dead[end]:
                    out.append(token)
                    if end == n:
                        return out
                    if end != last + 1:
                        scan = matches(text, end)
                    at, before = end, token
                    last, token = next(scan)
                    continue
                token = self.shorter(token)
            if token < 0:
                if not out:
                    raise ValueError("the vocabulary does not hold all bytes")
                dead[at] = 1
                token = self.shorter(out.pop())
                at -= length[before]
                while token < 0 and out:  # nothing shorter: the place before is a dead end as well
                    dead[at] = 1
                    before = out.pop()
                    at -= length[before]
                    token = self.shorter(before)
                before = out[-1] if out else -1

    def ids(self, text: str) -> bytes:
        """The ids of a whole text, as little-endian 32-bit integers."""
        if not text:
            return b""
        head, *tail = _CHUNK.split(text)
        return self.first[head] + b"".join(map(self.later.__getitem__, tail))


class Decoder:
    """Ids to bytes: less to hold than an Encoder."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = {i: t for t, i in ranks.items()}
        self.vocabulary = pa.array([tokens.get(i) for i in range(max(tokens) + 1)], pa.binary())

    def decoded(self, ids: pa.ListArray) -> pa.BinaryArray:
        """The bytes of lists of ids: tokens one behind another in one buffer, cut where lists end. A null list
        is null; an id without a token raises KeyError."""
        tokens = self.vocabulary.take(ids.flatten())
        if tokens.null_count:
            raise KeyError("an id that the vocabulary does not hold")
        ends = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset :][: len(tokens) + 1] if len(tokens) else np.zeros(1, np.int32)
        lengths = np.nan_to_num(ids.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        places = np.concatenate([[0], np.cumsum(lengths)])
        valid = None if not ids.null_count else ids.is_valid().buffers()[1] if not ids.offset else pa.array(ids.is_valid().to_pylist()).buffers()[1]
        return pa.Array.from_buffers(pa.binary(), len(ids), [valid, pa.py_buffer(ends[places].astype(np.int32).tobytes()), tokens.buffers()[2] or pa.py_buffer(b"")])


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def load(path: str, pattern: str) -> Encoder:
    """The encoder of a file of ranks (base64 of the token, rank), once a worker."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Encoder(_ranks(path), pattern)
    return _LOADED[path, pattern]


def _pattern(pattern: str | None) -> str:
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    return pattern


def _path(path: str | None) -> str:
    return path or tokenizer_path("byte_bpe_multi_50k.tiktoken")


def _with(docs: DataFrame, column: str, kind: str) -> tuple[str, list[str]]:
    """The schema of docs with another column behind the others, which replaces one of that name."""
    kept = [f for f in docs.schema if f.name != column]
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{column}` {kind}"]), [f.name for f in kept]


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, text: str = "text") -> DataFrame:
    """docs with `ids`, array<int>, the tokens of each whole text (null: none).

    path: a file of ranks; pattern: what splits texts before merges. Rows stay where they are: no shuffle, one row out for each row in, repeated ones
    too; a column named ids is replaced, others are kept. A text of any length takes time by its length, also if it is one match
    of the pattern. Of an empty table the result is empty.
    """
    at, by = _path(path), _pattern(pattern)
    schema, kept = _with(docs, "ids", "array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(at, by)
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH):
                part = batch.slice(k, BATCH)
                ids = [encoder.ids(t.as_py() or "") for t in part[text]]
                ends = np.concatenate([[0], np.cumsum([len(i) // 4 for i in ids])]).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                yield pa.RecordBatch.from_arrays([*(part[c] for c in kept), pa.ListArray.from_arrays(pa.array(ends), flat)], names=[*kept, "ids"])

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded (with `ids`, array<int>) with `decoded`, the bytes that the ids stand for; null ids give null."""
    at = _path(path)
    schema, kept = _with(encoded, "decoded", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(_ranks(at))
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH):
                part = batch.slice(k, BATCH)
                yield pa.RecordBatch.from_arrays([*(part[c] for c in kept), decoder.decoded(part["ids"])], names=[*kept, "decoded"])

    return encoded.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: texts encoded, and decoded again from their ids."""
    both = decode(encode(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), path).drop("text"), path)
    said = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(said, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
