"""Approximate nearest neighbours by randomly rotated one-bit codes.

Every vector is centred, rotated by a fixed random rotation and kept as one bit per dimension with two
scalars, its length and how well the bits stand for it. From bits and scalars the inner product with a
query is estimated together with a bound of the error. Blocks of queries meet blocks of codes: a first
pass reranks the best estimates exactly and so bounds each query's k-th distance; a second
pass reranks every vector whose lower bound is within it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._shared import materialize

#: Neighbours; bound of the error in its standard units; rows of a block of codes and of queries; seed.
K, EPSILON, CODE_BLOCK, QUERY_BLOCK, SEED = 10, 4.0, 8192, 8192, 7
_SIGNS = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2 - 1)


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float64)


def usable(vector: Column, dim: int) -> Column:
    """Of that dimension, not zero, without null or non-finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vector) == dim) & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _coded(dim: int, centre: list[float], seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, mean = rotation(dim, seed), np.array(centre)
        for b in batches:
            rest = _matrix(b["embedding"], dim) - mean
            norm = np.sqrt((rest**2).sum(1))
            x = rest @ turn.T / np.maximum(norm, 1e-300)[:, None]
            fit = np.maximum(np.abs(x).sum(1) / np.sqrt(dim), 1e-9)
            bits = np.packbits(x > 0, axis=1)
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["embedding"], pa.array([r.tobytes() for r in bits], pa.binary()), pa.array(norm), pa.array(fit)], names=["vec_id", "embedding", "bits", "norm", "fit"])

    return run


def estimates(bits: np.ndarray, norm: np.ndarray, fit: np.ndarray, query: np.ndarray, turn: np.ndarray, mean: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of one query to coded vectors: estimate and lower bound."""
    dim = len(query)
    rest = query - mean
    q_norm = np.sqrt((rest**2).sum())
    q = (turn @ (rest / max(q_norm, 1e-300))).astype(np.float32)
    table = _SIGNS @ np.pad(q, (0, -dim % 8)).reshape(-1, 8).T  # (256, bytes)
    dot = table[bits, np.arange(bits.shape[1])].sum(1) / np.sqrt(dim)
    inner = dot / fit
    error = epsilon * np.sqrt(np.maximum(1 - fit**2, 0)) / fit / np.sqrt(max(dim - 1, 1))
    both = norm**2 + q_norm**2
    return both - 2 * norm * q_norm * inner, both - 2 * norm * q_norm * np.minimum(inner + error, 1.0) - 1e-6 * both


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, summed dimension after dimension."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += (a[:, j] - b[j]) ** 2
    return np.sqrt(total)


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _cell(dim: int, centre: list[float], seed: int, k: int, epsilon: float, first: int | None):
    """One block of codes against one block of queries. first: rerank so many best estimates and
    return k of them; else rerank all within `within` and return those."""

    def run(codes: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if codes.num_rows and queries.num_rows:
            turn, mean = rotation(dim, seed), np.array(centre)
            vectors, wanted = _matrix(codes["embedding"], dim), _matrix(queries["embedding"], dim)
            ids, q_ids = codes["vec_id"].to_numpy(), queries["query_id"].to_numpy()
            bits = np.frombuffer(b"".join(codes["bits"].to_pylist()), np.uint8).reshape(len(ids), -1)
            norm, fit = codes["norm"].to_numpy(), codes["fit"].to_numpy()
            within = None if first else queries["within"].to_numpy()
            for i, q in enumerate(q_ids):
                near, low = estimates(bits, norm, fit, wanted[i], turn, mean, epsilon)
                near[ids == q], low[ids == q] = np.inf, np.inf
                if first:
                    pick = np.argpartition(near, first)[:first] if len(near) > first else np.arange(len(near))
                    pick = pick[np.isfinite(near[pick])]
                else:
                    pick = np.flatnonzero((low <= within[i] ** 2) & (ids != q))
                d = _exact(vectors[pick], wanted[i])
                keep = np.argsort(d, kind="stable")[:k] if first else np.flatnonzero(d <= within[i])
                out.append((np.full(len(keep), q), ids[pick[keep]], d[keep]))
        if not out:
            return _FOUND.empty_table()
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=_FOUND)

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, epsilon: float = EPSILON, code_block: int = CODE_BLOCK, query_block: int = QUERY_BLOCK, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest vectors of each query, its own id excepted.

    vectors and queries: vec_id, embedding. Distances are Euclidean, in double precision, on the
    original vectors; ties go to the smaller vec_id; with fewer than k candidates all are given. The
    dimension is the one most vectors have; components may be floats or doubles. Null, zero, non-finite and other-sized vectors take no
    part on either side, nor does a null id; repeated rows count once.

    Of equal vectors only the k + 1 smallest ids can be among anyone's k nearest, so only they are
    indexed, which keeps a vector that a third of all rows hold from making candidates by
    the square. All others are coded and every code is looked at for every query; the stated query
    set meets the codes in blocks of bounded size, each pair of blocks a group of its own, so codes are
    copied once for every query_block queries. Their vectors go with them: at `epsilon` a third of all vectors and more are within the
    bound (64 dimensions), which as pairs of ids to be joined with their vectors would be more to move by far.
    A neighbour is missed only if an error exceeds `epsilon` standard units.
    """
    spark = vectors.sparkSession
    sizes = vectors.where("embedding is not null and vec_id is not null and size(embedding) > 0").groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))
    top = sizes.orderBy(F.desc("n"), "dim").limit(1).collect()
    if not top:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = top[0]["dim"]
    clean = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(usable(F.col("embedding"), dim) & F.col("vec_id").isNotNull()).distinct()
    copies = Window.partitionBy("embedding").orderBy("vec_id")
    indexed = clean(vectors).withColumn("place", F.row_number().over(copies)).where(F.col("place") <= k + 1).drop("place")
    centre = list(indexed.agg(*(F.avg(F.col("embedding")[j].cast("double")) for j in range(dim))).first())
    if centre[0] is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    codes = materialize(indexed.mapInArrow(_coded(dim, centre, seed), "vec_id long, embedding array<double>, bits binary, norm double, fit double"), "codes")
    asked = materialize(clean(queries).withColumnRenamed("vec_id", "query_id"), "queries")
    n_codes, n_queries = -(-codes.count() // code_block), max(1, -(-asked.count() // query_block))
    dealt = codes.withColumn("_c", F.pmod(F.xxhash64("vec_id"), F.lit(n_codes)).cast("int")).withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))

    def cells(wanted: DataFrame, first: int | None) -> DataFrame:
        spread = wanted.withColumn("_q", F.pmod(F.xxhash64("query_id"), F.lit(n_queries)).cast("int")).withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(n_codes - 1))))
        return dealt.groupBy("_c", "_q").cogroup(spread.groupBy("_c", "_q")).applyInArrow(_cell(dim, centre, seed, k, epsilon, first), "query_id long, vec_id long, score double")

    place = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    bound = ranked(cells(asked, 3 * k)).groupBy("query_id").agg(F.max("score").alias("within"), F.count("*").alias("n"))
    wanted = asked.join(bound, "query_id").withColumn("within", F.when(F.col("n") < k, float("inf")).otherwise(F.col("within"))).drop("n")
    found = ranked(cells(materialize(wanted, "bounds"), None))
    return found.select("query_id", "rank", "vec_id", "score")
