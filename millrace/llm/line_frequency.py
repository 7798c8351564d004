"""Quality rules by cross-document line frequency.

Lines are normalised (white space to one space, trimmed, A-Z lowered, digit runs to 0) and hashed. For
each host the distinct documents that hold a line are counted; copies of one text are one document.
Lines above the limit are boilerplate and are taken out; a document of which too little is left
is rejected. The basic rules (too short, too repetitive) stand beside it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._shared import materialize

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_DIGITS = re.compile(rb"[0-9]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


@dataclass(frozen=True)
class LineRules:
    """min_words, max_repeat_percent: the basic rules. max_line_docs: a line in more distinct documents
    of its host is boilerplate, whatever the host's size. min_kept_percent: a document needs this share
    of its words outside such lines."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_line_docs: int = 30
    min_kept_percent: int = 50


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more in the text, the first included."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    put = seen.setdefault
    ids = np.fromiter((put(w, len(seen)) for w in words), np.int64, n)
    k = np.int64(len(seen))
    if k < 2_000_000:
        key = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    else:
        _, inverse, counts = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], 1), axis=0, return_inverse=True, return_counts=True)
    again = counts[inverse.reshape(-1)] > 1
    covered = np.zeros(n, bool)
    covered[:-2] |= again
    covered[1:-1] |= again
    covered[2:] |= again
    return int(covered.sum())


def normalized(line: bytes) -> bytes:
    return _DIGITS.sub(b"0", b" ".join(line.translate(_LOWER).split()))


def text_row(text: str | None) -> dict:
    """The basic figures of one text, its hash and, for each distinct normalised line that has a
    word, the line's hash and the words that it holds in this text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    seen: set[bytes] = set()
    duplicates = 0
    lines: dict[int, int] = {}
    for line in raw.split(b"\n"):
        held = line.split()
        if not held:
            continue
        if line in seen:
            duplicates += 1
        seen.add(line)
        h = xxhash.xxh3_64_intdigest(normalized(line)) - (1 << 63)
        lines[h] = lines.get(h, 0) + len(held)
    return {
        "n_words": len(words),
        "word_chars": len(text or "") - sum(map((text or "").count, " \t\n\x0b\x0c\r")),
        "n_symbols": len(_SYMBOLS.findall(text or "")),
        "n_dup_lines": duplicates,
        "n_repeat_words": repeated_words(words),
        "text_hash": xxhash.xxh3_64_intdigest(raw) - (1 << 63),
        "lines": [{"hash": h, "words": n} for h, n in lines.items()],
    }


_FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_ROW = f"row_id long, doc_id long, host string, {_FIGURES}, text_hash long, lines array<struct<hash:long,words:long>>"


def _text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("row_id", pa.int64()), ("doc_id", pa.int64()), ("host", pa.string()), *((k, pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "text_hash")), ("lines", pa.list_(pa.struct([("hash", pa.int64()), ("words", pa.int64())])))])
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            rows = [text_row(x.as_py()) for x in part["text"]]
            made = pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(kinds)[3:]))
            yield pa.RecordBatch.from_arrays([part["row_id"], part["doc_id"], part["host"], *made.columns], schema=kinds)


def line_rules(docs: DataFrame, host: str = "source", rules: LineRules = LineRules()) -> DataFrame:
    """One row for each row of docs: doc_id, the basic figures, removed_words, base_failed, kept.

    Null and empty texts have no words and fail the basic rules. A null host is a host of its own.
    Repeated rows (same id, same text) each get a row; their lines count once. Documents without
    words are never divided by: they are not kept. Other columns of docs are not read.

    The texts are read once, by a task each; what is shuffled are 64-bit hashes of lines, first
    summed by (host, line, text), so a line that a third of all documents hold is counted in
    parts. Only lines above the limit meet the documents again.
    """
    read = docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("h"), F.col(host)), F.lit("none")).alias("host"), F.col("text"),
    )
    rows = materialize(read.mapInArrow(_text_rows, _ROW), "lines")
    held = rows.select("row_id", "host", "text_hash", F.explode("lines").alias("line")).select("row_id", "host", "text_hash", "line.*")
    common = (
        held.groupBy("host", "hash", "text_hash").agg(F.lit(1).alias("one"))
        .groupBy("host", "hash").agg(F.count("*").alias("docs")).where(F.col("docs") > rules.max_line_docs).select("host", "hash")
    )
    removed = held.join(common, ["host", "hash"], "left_semi").groupBy("row_id").agg(F.sum("words").alias("removed_words"))
    n, left = F.col("n_words"), F.col("n_words") - F.coalesce("removed_words", F.lit(0))
    failed = (n < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * n)
    return (
        rows.drop("lines", "text_hash", "host").join(removed, "row_id", "left")
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            F.coalesce("removed_words", F.lit(0)).cast("long").alias("removed_words"), failed.alias("base_failed"),
            (~failed & (100 * left >= rules.min_kept_percent * n)).alias("kept"),
        )
    )
