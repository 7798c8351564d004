"""Quality classifier: a factorisation machine over hashed words, structure statistics and length.

score = sigmoid(w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j); the pair sum is computed in time
linear in the features as half of (sum v_i x_i)^2 - sum (v_i x_i)^2 per factor. It is fitted on a
bounded sample of labelled rows and scores every text where it lies.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._shared import id_remainder

#: Buckets of hashed words, factors, most labelled rows that a fit reads, and the score from which a text is kept.
WORDS, FACTORS, FIT_ROWS, KEEP = 1 << 16, 8, 8000, 0.7
_BINS = 12
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_CLASS = np.zeros(256, np.int64)
_CLASS[list(b" \t\n\x0b\x0c\r")] = 1
_CLASS[65:91] = 2
_CLASS[97:123] = 3
_CLASS[48:58] = 4
_CLASS[128:] = 5
_CLASS[list(b".,;:'\"()-?")] = 6
_CLASS[list(b"#*$%&|<>!=_{}[]\\/^~@+`")] = 7
_N_STATS = 12
N_FEATURES = WORDS + _N_STATS * (_BINS + 1)


def _spread(share: float) -> int:
    """A share of 0..1 as one of _BINS bins, finer near 0."""
    return min(_BINS - 1, int(_BINS * share**0.5))


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature indexes and values of one whole text; an empty one has its structure alone."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.translate(_LOWER).split()
    n = len(words)
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=8) if raw else np.zeros(8, int)
    seen = max(1, len(raw) - int(kinds[1]))
    letters = max(1, int(kinds[2] + kinds[3] + kinds[5]))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    distinct = set(words)
    pairs = len(set(zip(words, words[1:]))) if n > 1 else 0
    size = len(text or "") if n_chars is None else n_chars
    shares = [
        kinds[2] / letters, kinds[4] / seen, kinds[5] / seen, kinds[6] / seen, kinds[7] / seen,
        len(distinct) / n if n else 1.0, pairs / (n - 1) if n > 1 else 1.0,
        len(set(lines)) / len(lines) if lines else 1.0,
        min(1.0, seen / n / 24) if n else 0.0, min(1.0, np.log1p(n) / 12), min(1.0, np.log1p(max(0, size)) / 14),
        sum(map(len, words[-20:])) / max(1, len(b" ".join(words[-20:]))),
    ]
    stats = np.array([min(1.0, max(0.0, float(s))) for s in shares])
    at = WORDS + np.arange(_N_STATS) * (_BINS + 1)
    hashed = np.fromiter((xxhash.xxh32_intdigest(w) for w in distinct), np.uint32, len(distinct)) % WORDS
    hashed = np.unique(hashed).astype(np.int64)
    index = np.concatenate([hashed, at + [_spread(s) for s in stats], at + _BINS])
    value = np.concatenate([np.full(len(hashed), 1 / np.sqrt(max(1, len(hashed)))), np.ones(_N_STATS), stats])
    return index, value


@dataclass(frozen=True)
class Machine:
    w0: float
    w: np.ndarray
    v: np.ndarray

    def scores(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For rows of features one after another, from starts on; no row is empty."""
        vx = self.v[index] * value[:, None]
        sums, squares = np.add.reduceat(vx, starts), np.add.reduceat(vx**2, starts)
        z = self.w0 + np.add.reduceat(self.w[index] * value, starts) + 0.5 * (sums**2 - squares).sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 8, batch: int = 128, rate: float = 0.08, decay: float = 2e-5, factors: int = FACTORS, seed: int = 1) -> Machine:
    """Adagrad on log loss, classes weighted alike. One class alone, or no rows, gives its share."""
    unit = np.random.default_rng(seed)
    y = np.array([r[2] for r in rows], float)
    share = (y.sum() + 1) / (len(y) + 2)
    w, v = np.zeros(N_FEATURES), unit.normal(0, 0.01, (N_FEATURES, factors))
    w0 = float(np.log(share / (1 - share)))
    if not 0 < y.sum() < len(y):
        return Machine(w0, w, v * 0)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w0, g0, gw, gv = 0.0, 1e-8, np.full(N_FEATURES, 1e-8), np.full((N_FEATURES, factors), 1e-8)
    for _ in range(epochs):
        order = unit.permutation(len(rows))
        for at in range(0, len(order), batch):
            mine = order[at : at + batch]
            index, value = np.concatenate([rows[k][0] for k in mine]), np.concatenate([rows[k][1] for k in mine])
            lens = np.array([len(rows[k][0]) for k in mine])
            starts, owner = np.cumsum(lens) - lens, np.repeat(np.arange(len(mine)), lens)
            vx = v[index] * value[:, None]
            sums = np.add.reduceat(vx, starts)
            z = w0 + np.add.reduceat(w[index] * value, starts) + 0.5 * (sums**2 - np.add.reduceat(vx**2, starts)).sum(1)
            slope = weight[mine] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[mine]) / len(mine)
            used, back = np.unique(index, return_inverse=True)
            dw = np.bincount(back, slope[owner] * value, len(used)) + decay * w[used]
            each = (slope[owner] * value)[:, None] * (sums[owner] - vx)
            dv = np.stack([np.bincount(back, each[:, f], len(used)) for f in range(factors)], 1) + decay * v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            g0 += slope.sum() ** 2
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= 0.3 * rate * dv / np.sqrt(gv[used])
            w0 -= rate * slope.sum() / np.sqrt(g0)
    return Machine(w0, w, v)


_FEATURES = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("index", pa.binary()), ("value", pa.binary())])


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = [features(t.as_py(), c.as_py()) for t, c in zip(b["text"], b["n_chars"], strict=True)]
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["quality"], pa.array([i.astype("<i4").tobytes() for i, _ in made], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in made], pa.binary())], schema=_FEATURES)


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Machine:
    """Fits on the labelled documents whose crc32(doc_id) mod 4 is not 2: at most fit_rows labels, those of smallest
    hash, are taken; their documents' features come to the driver, one row a label: of several rows with one id that of
    the smallest text hash, so that a repeated id brings no more."""
    seen = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (id_remainder("doc_id", 4) != 2)).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    sample = seen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    # The sample has at most fit_rows rows of two numbers, so it can be broadcast.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _length(docs)).join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "text", "n_chars")
    of = F.struct(F.xxhash64("text").alias("hash"), "n_chars")
    rows = rows.groupBy("doc_id", "quality").agg(F.min_by(F.struct("text", "n_chars"), of).alias("row")).select("doc_id", "quality", "row.text", "row.n_chars")
    got = rows.mapInArrow(_featured, "doc_id long, quality int, index binary, value binary").collect()
    got.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], bytes(r["index"])))
    return fit([(np.frombuffer(r["index"], "<i4").astype(np.int64), np.frombuffer(r["value"], "<f4").astype(float), r["quality"]) for r in got])


def _length(docs: DataFrame):
    return (F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")).alias("n_chars")


def score(docs: DataFrame, machine: Machine, keep: float = KEEP) -> DataFrame:
    """docs with held_out, score (0 to 1) and predicted (1 if score >= keep).

    Reads text and n_chars only (metadata; null or missing: counted). Null and empty texts are scored by their
    structure; repeated rows each get the same score. Clashing columns of docs are replaced, all others
    kept. The model (a few MB, of fixed size) is broadcast; texts are never shuffled.
    """
    docs = docs.drop("held_out", "score", "predicted", "_n")
    model = docs.sparkSession.sparkContext.broadcast((machine.w0, machine.w.astype(np.float32), machine.v.astype(np.float32)))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Machine(model.value[0], model.value[1], model.value[2])
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                b = batch.slice(at, 250)
                made = [features(t.as_py(), c.as_py()) for t, c in zip(b["text"], b["_n"], strict=True)]
                lens = np.array([len(i) for i, _ in made])
                p = fitted.scores(np.concatenate([i for i, _ in made]), np.concatenate([v for _, v in made]), np.cumsum(lens) - lens)
                yield pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array(p.astype(float))], names=[*names, "score"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    scored = docs.select("*", _length(docs).alias("_n")).mapInArrow(run, f"{types}, score double")
    return scored.withColumn("held_out", id_remainder("doc_id", 4) == 2).withColumn("predicted", (F.col("score") >= keep).cast("int"))
