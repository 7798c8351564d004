"""Centroid clustering by kd-tree filtering, in integers.

Every task puts its vectors into kd-trees of bounded size once; they are written with their nodes' counts, sums and boxes. A
round sends the centroids down each tree: at a node, centroids that are farther than the one nearest to its
middle from every point of its box are pruned; a node with one centroid left gives its count and sums to it whole, a leaf with several
is resolved point by point. All arithmetic is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._shared import materialize

#: Components; factor before rounding down; centroids; rounds; vectors of a tree, and of a leaf.
DIM, SCALE, CENTROIDS, ROUNDS, BLOCK, LEAF = 64, 64, 16, 3, 4096, 16
#: Components (scaled) must stay below this, or squared distances would be no longs.
LARGEST = 1 << 27


def usable(vector: Column, dim: int = DIM, scale: int = SCALE) -> Column:
    """Of exactly dim components, none null, non-finite or (scaled) 2^27 and more."""
    return F.coalesce((F.size(vector) == dim) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * scale < LARGEST)), F.lit(False))


class Tree:
    """A kd-tree over integer points: points in tree order, nodes with begin, end, depth, sums and boxes.

    Nodes are numbered level by level; left[k] is the left child of node k, -1 at a leaf; the right one follows it.
    """

    def __init__(self, points: np.ndarray, order: np.ndarray, begin: np.ndarray, end: np.ndarray, left: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray):
        self.points, self.order, self.begin, self.end, self.left, self.low, self.high, self.sums = points, order, begin, end, left, low, high, sums

    @classmethod
    def grown(cls, points: np.ndarray, leaf: int = LEAF) -> Tree:
        """Split at the median of the widest side of the box; equal points are one leaf, however many."""
        order, begin, end, left, low, high, sums = np.arange(len(points)), [0], [len(points)], [], [], [], []
        at = 0
        while at < len(begin):
            mine = points[order[begin[at] : end[at]]]
            low.append(mine.min(0)), high.append(mine.max(0)), sums.append(mine.sum(0))
            side = int((high[-1] - low[-1]).argmax())
            if len(mine) <= leaf or high[-1][side] == low[-1][side]:
                left.append(-1)
            else:
                middle = len(mine) // 2
                order[begin[at] : end[at]] = order[begin[at] : end[at]][np.argpartition(mine[:, side], middle)]
                left.append(len(begin))
                begin += [begin[at], begin[at] + middle]
                end += [begin[at] + middle, end[at]]
            at += 1
        of = lambda a: np.array(a, np.int64)
        return cls(points[order], order, of(begin), of(end), of(left), of(low), of(high), of(sums))

    def filtered(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Node by node: (nodes given whole, their centroids, candidates of the points of leaves that stay open).

        The candidates are a boolean table points x centroids, all false for points of nodes given whole.
        """
        n, k = len(self.points), len(centroids)
        open_ = np.zeros((n, k), bool)
        nodes, candidates = np.zeros(1, np.int64), np.ones((1, k), bool)
        whole, owner = [], []
        while len(nodes):
            low, high = self.low[nodes], self.high[nodes]
            # Twice the distance to the middle, so that it stays an integer; which centroid leads decides nothing about the result.
            off = 2 * centroids[None] - (low + high)[:, None]
            near = np.where(candidates, (off.astype(np.float64) ** 2).sum(2), np.inf).argmin(1)
            leader = centroids[near][:, None]
            corner = np.where(centroids[None] > leader, high[:, None], low[:, None])
            # |c - corner|^2 - |leader - corner|^2 = (c - leader) . (c + leader - 2 corner), at the box's corner that is best for c
            margin = ((centroids[None] - leader) * (centroids[None] + leader - 2 * corner)).sum(2)
            candidates = candidates & (margin <= 0)
            alone = candidates.sum(1) == 1
            whole.append(nodes[alone]), owner.append(near[alone])
            leaf = ~alone & (self.left[nodes] < 0)
            for node, mask in zip(nodes[leaf], candidates[leaf], strict=True):
                open_[self.begin[node] : self.end[node]] = mask
            down = ~alone & ~leaf
            first = self.left[nodes[down]]
            nodes, candidates = np.stack([first, first + 1], 1).ravel(), np.repeat(candidates[down], 2, axis=0)
        return np.concatenate(whole), np.concatenate(owner), open_

    def nearest(self, points: np.ndarray, centroids: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """For each point the nearest candidate, the smaller number of equals."""
        return np.where(candidates, _squared(points, centroids), np.iinfo(np.int64).max).argmin(1)

    def totals(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and sums of the points of each centroid."""
        whole, owner, open_ = self.filtered(centroids)
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros_like(centroids)
        np.add.at(counts, owner, self.end[whole] - self.begin[whole])
        np.add.at(sums, owner, self.sums[whole])
        rest = np.flatnonzero(open_.any(1))
        if len(rest):
            to = self.nearest(self.points[rest], centroids, open_[rest])
            np.add.at(counts, to, 1)
            np.add.at(sums, to, self.points[rest])
        return counts, sums

    def assigned(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cluster and squared distance of each point, in the points' order of coming."""
        whole, owner, open_ = self.filtered(centroids)
        to = np.zeros(len(self.points), np.int64)
        for node, c in zip(whole, owner, strict=True):
            to[self.begin[node] : self.end[node]] = c
        rest = np.flatnonzero(open_.any(1))
        if len(rest):
            to[rest] = self.nearest(self.points[rest], centroids, open_[rest])
        back = np.empty_like(to)
        back[self.order] = to
        own = np.empty_like(to)
        own[self.order] = ((self.points - centroids[to]) ** 2).sum(1)
        return back, own


def _squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, points x centroids. Doubles hold them exactly while all terms are below 2^53."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    kind = np.float64 if 4 * points.shape[1] * most * most < 1 << 53 else np.int64
    p, c = points.astype(kind), centroids.astype(kind)
    if kind is np.int64:
        return np.stack([((p - one) ** 2).sum(1) for one in c], 1)
    return ((p * p).sum(1)[:, None] - 2 * (p @ c.T) + (c * c).sum(1)).astype(np.int64)


_NODES = ("order", "begin", "end", "left", "low", "high", "sums")
_FOREST = "ids array<long>, points binary, order binary, begin binary, end binary, left binary, low binary, high binary, sums binary"


def _forest(dim: int, scale: int, block: int, leaf: int):
    """Tasks' vectors as trees of at most `block` of them, one row a tree."""

    def tree(ids: list[pa.Array], parts: list[np.ndarray]) -> pa.RecordBatch:
        grown = Tree.grown(np.concatenate(parts), leaf)
        all_ids = pa.concat_arrays(ids)
        columns = [pa.ListArray.from_arrays(pa.array([0, len(all_ids)], pa.int32()), all_ids), pa.array([grown.points.astype("<i4").tobytes()], pa.binary())]
        columns += [pa.array([getattr(grown, name).astype("<i8").tobytes()], pa.binary()) for name in _NODES]
        return pa.RecordBatch.from_arrays(columns, names=["ids", "points", *_NODES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, held = [], [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, min(block - held, batch.num_rows - at))
                vectors = part["embedding"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                ids.append(part["vec_id"]), parts.append(np.floor(vectors * scale).astype(np.int64))
                at, held = at + part.num_rows, held + part.num_rows
                if held == block:
                    yield tree(ids, parts)
                    ids, parts, held = [], [], 0
        if held:
            yield tree(ids, parts)

    return run


def _trees(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Array, Tree]]:
    for batch in batches:
        for k in range(batch.num_rows):
            flat = {name: np.frombuffer(batch[name][k].as_py(), "<i8") for name in _NODES}
            shaped = {name: a.reshape(-1, dim) if name in ("low", "high", "sums") else a for name, a in flat.items()}
            points = np.frombuffer(batch["points"][k].as_py(), "<i4").astype(np.int64).reshape(-1, dim)
            yield batch["ids"].slice(k, 1).flatten(), Tree(points, **shaped)


def _round(forest: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of the means of what is nearest to each; empty ones stay."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for _, tree in _trees(batches, dim):
            more = tree.totals(centroids)
            counts, sums = counts + more[0], sums + more[1]
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(counts), *(pa.array(c) for c in sums.T)], names=["cluster", "n", *(f"s{j}" for j in range(dim))])

    parts = forest.mapInArrow(run, "cluster int, n long, " + ", ".join(f"s{j} long" for j in range(dim)))
    wide = [F.sum(F.col(f"s{j}").cast("decimal(38,0)")).alias(f"s{j}") for j in range(dim)]
    out = centroids.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *wide).collect():
        if r["n"]:
            out[r["cluster"]] = [int(r[f"s{j}"]) // r["n"] for j in range(dim)]
    return out


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = 1, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid (array of long) for every usable vector.

    A vector's components x become floor(scale * x). The first centroids are the k vectors whose
    `<seed>:<vec_id>` has the smallest sha256 in hex (ties: the smaller vector; null ids last), numbered in that order; with fewer vectors
    each is one. A round gives every vector to its nearest centroid by squared Euclidean distance, the smaller number of
    equals, then moves every centroid that has some to the floors of their means. After the last round vectors
    are given out once more. cluster_inertia and inertia: distances summed over the cluster and over all, as decimal(38,0).

    Null vectors and those of another dimension or with null, non-finite or (scaled) 2^27 or larger components take
    no part. Repeated rows and null ids each count and give a row. An empty table gives an empty result. Other columns than vec_id and
    embedding are not read.

    Trees are built where their vectors are read, without a shuffle, `block` vectors each, so a vector that a third of all rows
    hold is dealt to many trees. A round shuffles k rows a task; k centroids come to the driver.
    """
    spark = vectors.sparkSession
    schema = "vec_id long, cluster int, distance long, cluster_inertia decimal(38,0), inertia decimal(38,0), centroid array<long>"
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(usable(F.col("embedding"), dim, scale))
    hashed = own.withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    first = hashed.orderBy(F.asc_nulls_last("hash"), F.transform("embedding", lambda x: F.floor(x * scale))).limit(k).select("embedding").collect()
    if not first:
        return spark.createDataFrame([], schema)
    centroids = np.floor(np.array([r["embedding"] for r in first], np.float64) * scale).astype(np.int64)
    forest = materialize(own.mapInArrow(_forest(dim, scale, block, leaf), _FOREST), "forest")
    for _ in range(rounds):
        centroids = _round(forest, centroids)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tree in _trees(batches, dim):
            to, distance = tree.assigned(centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(to.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    given = materialize(forest.mapInArrow(last, "vec_id long, cluster int, distance long"), "clusters")
    inertia = {r["cluster"]: int(r["inertia"]) for r in given.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}
    exact = lambda n: F.lit(str(n)).cast("decimal(38,0)")
    of = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1)
    return given.select(
        "vec_id", "cluster", "distance", of([exact(inertia.get(c, 0)) for c in range(len(centroids))]).alias("cluster_inertia"), exact(sum(inertia.values())).alias("inertia"),
        of([F.array(*(F.lit(int(x)).cast("long") for x in c)) for c in centroids]).alias("centroid"),
    )
