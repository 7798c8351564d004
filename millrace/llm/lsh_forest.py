"""Near-duplicate detection by an LSH forest of MinHash signatures.

Every document becomes the set of its word shingles; equal sets are one node. Each tree of the forest is
one sorted order of the nodes by a sequence of MinHash values. Nodes next to each other in an order are
candidates as far as they have a common prefix; how long a prefix it takes grows with how crowded that region
of the order is, for a node looks at a bounded number of neighbours, those of the longest
common prefixes. Nodes of crowded regions get further orders of greater depth. Candidates whose sketches agree
enough are put in one cluster; inside a cluster links are confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._shared import materialize

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


@dataclass(frozen=True)
class Forest:
    """width: words of a shingle. percent: Jaccard similarity of a link. trees: sorted orders. depths: MinHash
    values that candidates must share at least, and values of an order. crowd: nodes of a region beyond which
    it is crowded, and of a task's cluster. dense_orders, dense_depth: further orders of nodes in
    crowded regions, and their values; a block of these has a quarter of a crowd. sketch: signature bytes that
    estimate similarity; near: how many must agree for two nodes to share a cluster (five standard
    deviations under `percent`)."""

    width: int = 5
    percent: int = 80
    trees: int = 25
    depths: tuple[int, ...] = (4, 16)
    crowd: int = 512
    dense_orders: int = 128
    dense_depth: int = 24
    sketch: int = 128
    seed: int = 3

    @property
    def near(self) -> int:
        j = self.percent / 100
        return int(self.sketch * j - 5.2 * (self.sketch * j * (1 - j)) ** 0.5)

    @property
    def values(self) -> int:
        """MinHash values of a signature."""
        return max(8 * self.trees, self.sketch)

    def orders(self) -> np.ndarray:
        """Of every tree the places of its values: runs of the signature, of which the first eight are its own."""
        return (np.arange(self.trees)[:, None] * 8 + np.arange(self.depths[-1])[None, :]) % self.values

    def more_orders(self) -> np.ndarray:
        """Of every further order the places of its values, drawn without replacement."""
        unit = np.random.default_rng(self.seed + 1)
        return np.stack([unit.permutation(self.values)[: self.dense_depth] for _ in range(self.dense_orders)])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; fewer words than width are one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    span = min(width, n)
    out = np.full(n - span + 1, span, np.uint64) * _M1
    for k in range(span):
        out = _mixed(out ^ h[k : n - span + 1 + k]) + _M1
    return np.unique(out)


def set_hash(shingle_set: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(np.int64(_mixed(shingle_set).sum(dtype=np.uint64).view(np.int64))) if len(shingle_set) else 0


class Signer:
    def __init__(self, forest: Forest):
        unit = np.random.default_rng(forest.seed)
        self.forest, self.size = forest, forest.values
        self.a = unit.integers(0, 1 << 32, self.size, np.uint32) | np.uint32(1)
        self.b = unit.integers(0, 1 << 32, self.size, np.uint32)

    def minima(self, shingle_set: np.ndarray) -> np.ndarray:
        x = (shingle_set >> np.uint64(32)).astype(np.uint32)
        low = np.full(self.size, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), 512):
            low = np.minimum(low, (self.a[:, None] * x[None, at : at + 512] + self.b[:, None]).min(1))
        return low

    def sign(self, shingle_set: np.ndarray) -> tuple[bytes, bytes]:
        """(16 bits of every MinHash value, sketch)."""
        low = self.minima(shingle_set)
        return low.astype(np.uint16).astype(">u2").tobytes(), low[: self.forest.sketch].astype(np.uint8).tobytes()


_SIGNED = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("signature", pa.binary()), ("sketch", pa.binary())])
_SIGNED_TYPES = "doc_id long, text_key long, n_shingles long, node long, signature binary, sketch binary"


def text_key(text: Column) -> Column:
    """A hash that tells the texts of one doc_id apart."""
    return F.xxhash64(text)


def _signed(forest: Forest) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(forest)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                b, out = batch.slice(at, 1000), []
                for text in b["text"]:
                    s = shingles(text.as_py(), forest.width)
                    out.append((len(s), set_hash(s), *signer.sign(s)) if len(s) else (0, None, None, None))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([b["doc_id"], b["text_key"], *(pa.array(list(c), f.type) for c, f in zip(cols, list(_SIGNED)[2:], strict=True))], schema=_SIGNED)

    return run


# -- sorted orders ---------------------------------------------------------------------------------

_LABEL = pa.schema([("label", pa.binary()), ("tie", pa.int64()), ("root", pa.int64())])
_REGION = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("run", pa.int64())])


def _odd(n: int) -> np.ndarray:
    """Odd numbers, one an order. node * odd puts equal labels in another sequence in every order."""
    return _mixed(np.arange(1, n + 1, dtype=np.uint64) * _M1) | np.uint64(1)


def _flat(column: pa.Array, width: int) -> np.ndarray:
    """A column of binaries of one width, as bytes by row."""
    if not len(column):
        return np.empty((0, width), np.uint8)
    first = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint8)[first : first + width * len(column)].reshape(len(column), width)


def _labelled(orders: np.ndarray) -> Callable:
    """Of every node its label in every order, the order's number and the values, to be sorted as bytes; and its root, if it has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, depth = orders.shape
        odd, number = _odd(n), np.arange(n).astype(">u2").view(np.uint8).reshape(1, n, 2)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                width = len(b["signature"][0].as_py())
                values = _flat(b["signature"], width).reshape(b.num_rows, -1, 2)[:, orders].reshape(b.num_rows, n, 2 * depth)
                label = np.concatenate([np.broadcast_to(number, (b.num_rows, n, 2)), values], 2)
                tie = b["node"].to_numpy().astype(np.uint64)[:, None] * odd[None, :]
                cells = pa.Array.from_buffers(pa.binary(label.shape[2]), b.num_rows * n, [None, pa.py_buffer(np.ascontiguousarray(label).tobytes())]).cast(pa.binary())
                roots = [pa.array(np.repeat(b["root"].to_numpy(), n))] if "root" in b.schema.names else []
                yield pa.RecordBatch.from_arrays([cells, pa.array(tie.reshape(-1).view(np.int64)), *roots], schema=pa.schema(list(_LABEL)[: 2 + len(roots)]))

    return run


def _regions_of(n_orders: int, least: int, block: int, values: int) -> Callable:
    """key, node, run of the regions of a sorted partition; run, what all of a crowded run share, is null in others.

    A run of rows that share `least` values is a region, named by what they share, so that a run that is cut
    by the end of a partition meets its other part; what is beside a border of partitions is a region by the run and the
    border's number as well, so that a run that fills many partitions is whole at each of them. A run of over `block` rows is crowded: each half block of its
    order is a region together with the next half, so every node is beside its half block of nearest
    neighbours, of the longest common prefixes, on either side. Where roots are known, what is all of one root is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        with np.errstate(over="ignore"):
            back = np.array([pow(int(x), -1, 1 << 64) for x in _odd(n_orders)], np.uint64)
        width, head, half = 2 + 2 * values, 2 + 2 * least, max(1, block // 2)
        made = 0
        label, tie, root = np.empty((0, width), np.uint8), np.empty(0, np.uint64), np.empty(0, np.int64)
        at_start, flushed = True, False  # whether the held run begins the partition; whether blocks of it are out
        opening = None  # of such a run that is longer than what is held: its first block

        def named(rows: np.ndarray) -> np.ndarray:
            state = np.zeros(len(rows), np.uint64)
            words = np.ascontiguousarray(rows[:, :head]).view(np.uint16)
            for k in range(words.shape[1]):
                state = _mixed(state ^ words[:, k]) + _M1
            return state

        def told(key: np.ndarray, rows: np.ndarray, ties: np.ndarray, crowded: bool) -> pa.RecordBatch:
            order = rows[:, 0].astype(np.int64) * 256 + rows[:, 1]
            run = pa.array(named(rows).view(np.int64)) if crowded else pa.nulls(len(key), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array((ties * back[order]).view(np.int64)), run], schema=_REGION)

        def blocks(own: slice) -> Iterator[pa.RecordBatch]:
            """Of a crowded run, or the part of it at hand."""
            nonlocal made
            for at in range(own.start, max(own.start + 1, own.stop - half), half):
                part_of = slice(at, min(at + 2 * half, own.stop))
                made += 1
                if (root[part_of] != root[at]).any():
                    yield told(np.repeat(_mixed(np.array([part << 32 | made], np.uint64) * _M1), part_of.stop - at), label[part_of], tie[part_of], True)

        def seam(rows: np.ndarray, ties: np.ndarray) -> pa.RecordBatch:
            """A block at the end of a partition, to meet what the run has in the next one."""
            return told(named(rows), rows, ties, True)

        def border(rows: np.ndarray, ties: np.ndarray, number: int, crowded: bool) -> pa.RecordBatch:
            """What a run has on one side of the border before partition `number`, to meet the other side. A run may fill many partitions."""
            return told(_mixed(named(rows) ^ _mixed(np.array([number + 1], np.uint64) * _M1)), rows, ties, crowded)

        for batch in batches:
            if not batch.num_rows:
                continue
            label = np.concatenate([label, _flat(batch["label"], width)])
            more = batch["tie"].to_numpy()
            tie = np.concatenate([tie, more.view(np.uint64)])
            root = np.concatenate([root, batch["root"].to_numpy() if "root" in batch.schema.names else more])
            first = np.flatnonzero(np.r_[True, (label[1:, :head] != label[:-1, :head]).any(1)])
            last = int(first[-1])
            if len(first) > 1:
                size = np.diff(first)
                opens = np.arange(len(size)) == 0
                crowded = (size > block) | (opens & flushed)
                mixed = np.logical_or.reduceat(root[:last] != np.repeat(root[first[:-1]], size), first[:-1])
                take = np.flatnonzero(np.repeat(~crowded & (mixed | (opens & at_start)), size))
                if len(take):
                    yield told(named(label[take]), label[take], tie[take], False)
                if at_start and not crowded[0]:
                    yield border(label[: size[0]], tie[: size[0]], part, False)
                for k in np.flatnonzero(crowded):
                    yield from blocks(slice(int(first[k]), int(first[k + 1])))
                    if at_start and k == 0:
                        begins = opening or (label[: min(2 * half, int(size[0]))], tie[: min(2 * half, int(size[0]))])
                        yield seam(*begins)
                        yield border(*begins, part, True)
                at_start, flushed, opening = False, False, None
                label, tie, root = label[last:], tie[last:], root[last:]
            if len(tie) >= 8 * block:
                if at_start and not flushed:
                    opening = (label[: 2 * half].copy(), tie[: 2 * half].copy())
                keep = (len(tie) // half - 1) * half
                yield from blocks(slice(0, keep + half))
                label, tie, root, flushed = label[keep:], tie[keep:], root[keep:], True
        if flushed or len(tie) > block:
            yield from blocks(slice(0, len(tie)))
            if at_start:  # a run of a whole partition goes on on both sides
                yield border(*(opening or (label[: 2 * half], tie[: 2 * half])), part, True)
            else:
                yield seam(label[-2 * half :], tie[-2 * half :])
            yield border(label[-2 * half :], tie[-2 * half :], part + 1, True)
        elif len(tie):
            yield told(named(label), label, tie, False)
            yield border(label, tie, part + 1, False)
            if at_start:
                yield border(label, tie, part, False)

    return run


def _sorted_regions(nodes: DataFrame, orders: np.ndarray, least: int, block: int) -> DataFrame:
    """key, node, run: the regions of these orders of nodes (node, signature and, if known, root), by one range sort of all of them."""
    own = [c for c in ("node", "signature", "root") if c in nodes.columns]
    labels = nodes.select(*own).mapInArrow(_labelled(orders), "label binary, tie long" + ", root long" * (len(own) == 3))
    inside = labels.repartitionByRange("label", "tie").sortWithinPartitions("label", "tie")
    return inside.mapInArrow(_regions_of(len(orders), least, block, orders.shape[1]), "key long, node long, run long")


# -- clusters --------------------------------------------------------------------------------------


def _grouped(key: int, take: Callable[[list[tuple]], Iterator[tuple]], schema: pa.Schema, many: int = 20_000) -> Callable:
    """mapInArrow over partitions sorted by their first `key` columns: take() gets the rows of a key. A grouped
    applyInArrow would call Python once a group, and most groups have two rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][:key] != row[:key]:
                    out += take(held)
                    held = []
                    if len(out) >= many:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                        out = []
                held.append(row)
        if held:
            out += take(held)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def _agreement(sketches: np.ndarray) -> np.ndarray:
    """Equal bytes of each two sketches."""
    n = len(sketches)
    out = np.empty((n, n), np.int16)
    for at in range(0, n, 32):
        out[at : at + 32] = (sketches[at : at + 32, None, :] == sketches[None, :, :]).sum(2)
    return out


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _neighbours(near: int) -> Callable:
    """Edges between the roots of a region's nodes: from each to the smallest of those that their sketches reach."""

    def take(rows: list[tuple]) -> Iterator[tuple]:
        rows = sorted({r[1:] for r in rows})
        roots = [r[2] for r in rows]
        if len(set(roots)) < 2:
            return
        if len(rows) == 2:
            x, y = (np.frombuffer(r[1], np.uint8) for r in rows)
            if int((x == y).sum()) >= near:
                yield roots[1], roots[0]
            return
        close = _agreement(np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(len(rows), -1)) >= near
        label = np.arange(len(rows))
        while True:
            low = np.where(close, label[None, :], len(rows)).min(1)
            if (low == label).all():
                break
            label = low
        yield from {(roots[i], roots[k]) for i, k in enumerate(label.tolist()) if roots[i] != roots[k]}

    return take


def _shared_counts(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, columns: int = 1 << 19) -> np.ndarray:
    """How many elements sets[i] and sets[j] share, for pairs with i ascending inside: by bits, some columns at a time."""
    order = np.argsort(i, kind="stable")
    first = np.searchsorted(i[order], np.arange(len(sets) + 1))
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[place]
    ends = np.cumsum([len(s) for s in sets])
    own = [column[e - len(s) : e] for e, s in zip(ends, sets, strict=True)]
    total, out = int((times > 1).sum()), np.zeros(len(i), np.int64)
    for at in range(0, total, columns):
        width = min(columns, total - at)
        bits = np.zeros((len(sets), -(-width // 64) * 8), np.uint8)
        for k, c in enumerate(own):
            flags = np.zeros(width, bool)
            flags[c[(c >= at) & (c < at + width)] - at] = True
            bits[k, : -(-width // 8)] = np.packbits(flags)
        words = bits.view(np.uint64)
        for k in range(len(sets)):
            for pairs in np.array_split(order[first[k] : first[k + 1]], 1 + (first[k + 1] - first[k]) * words.shape[1] // (1 << 21)):
                out[pairs] += np.bitwise_count(words[k] & words[j[pairs]]).sum(1, dtype=np.int64)
    return out


def _confirmed(forest: Forest) -> Callable:
    """Links inside a cluster, on full sets: a tree of confirmed links over each component."""

    def take(rows: list[tuple]) -> Iterator[tuple]:
        own: dict[int, tuple[np.ndarray, bytes]] = {}
        for *_, node, sketch, text in rows:
            if node not in own:
                own[node] = (shingles(text, forest.width), sketch)
        nodes = sorted(own)
        if len(nodes) < 2:
            return
        sets = [own[k][0] for k in nodes]
        size = np.array([len(s) for s in sets])
        same = _agreement(np.frombuffer(b"".join(own[k][1] for k in nodes), np.uint8).reshape(len(nodes), -1))
        i, j = np.nonzero(np.triu(same >= forest.near, 1))
        fits = 100 * np.minimum(size[i], size[j]) >= forest.percent * np.maximum(size[i], size[j])
        i, j = i[fits], j[fits]
        order = np.argsort(-same[i, j], kind="stable")
        i, j = i[order], j[order]
        united, missed, at = _Union(len(nodes)), 0, 0
        # Where most are alike, a few comparisons join all; where they are not, the rest is compared in bulk.
        while at < len(i) and missed <= 4 * len(nodes):
            a, b = int(i[at]), int(j[at])
            at += 1
            if united.root(a) != united.root(b):
                both = np.concatenate([sets[a], sets[b]])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= forest.percent * (size[a] + size[b] - shared):
                    united.join(a, b)
                else:
                    missed += 1
        if at < len(i):
            root = np.array([united.root(k) for k in range(len(nodes))])
            i, j = i[at:], j[at:]
            apart = root[i] != root[j]
            i, j = i[apart], j[apart]
            shared = _shared_counts(sets, i, j)
            linked = 100 * shared >= forest.percent * (size[i] + size[j] - shared)
            for a, b in zip(i[linked].tolist(), j[linked].tolist(), strict=True):
                united.join(a, b)
        for k in range(len(nodes)):
            yield nodes[k], nodes[united.root(k)]

    return take


def _contracted(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (a, b): all nodes of a component have one root, a node of it.

    Randomised contraction: every node takes the smallest of itself and its neighbours, edges are
    drawn between what was taken, and so on until no edge is left; a round leaves three quarters of the nodes
    at most, on average. In the first rounds smallest means by id, which settles stars that point at their
    smallest node at once; later ones draw an order of their own, so that long chains shrink too. Minima are
    summed in parts, and what meets them is a plain join, which Spark can split at a node of very many edges.
    """
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    taken: list[DataFrame] = []
    while not taken or e.count():
        rank = F.col("b") if len(taken) < 2 else F.xxhash64("b", F.lit(len(taken)))
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).union(e.select("a", F.col("a").alias("b"))).union(e.select(F.col("b").alias("a"), "b"))
        up = materialize(both.groupBy("a").agg(F.min_by("b", rank).alias("up")), "taken")
        taken.append(up.withColumnRenamed("a", "node"))
        drawn = e.join(up.withColumnRenamed("up", "x"), "a").join(up.select(F.col("a").alias("b"), F.col("up").alias("y")), "b").where("x <> y")
        e = materialize(drawn.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
    out = taken.pop().withColumnRenamed("up", "root")
    while taken:
        above = out.select(F.col("node").alias("up"), "root")
        out = taken.pop().join(above, "up", "left").select("node", F.coalesce("root", "up").alias("root"))
    return out


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (a, b): root is the smallest node that it can reach."""
    found = materialize(_contracted(edges), "contracted")
    return found.join(found.groupBy("root").agg(F.min("node").alias("least")), "root").select("node", F.col("least").alias("root"))


def _clusters(nodes: DataFrame, forest: Forest) -> DataFrame:
    """node, root of all clusters of two nodes or more: what the regions of the trees join and then, for nodes of
    crowded runs of more clusters than one, what those of the further orders join besides."""

    def joined(regions: DataFrame, known: DataFrame) -> DataFrame:
        told = regions.select("key", "node").join(known, "node").select("key", "node", "sketch", "root")
        return told.repartition("key").sortWithinPartitions("key").mapInArrow(_grouped(1, _neighbours(forest.near), _EDGE), "a long, b long")

    found = materialize(_sorted_regions(nodes, forest.orders(), min(forest.depths), forest.crowd), "regions")
    clusters = materialize(_contracted(joined(found, nodes.select("node", "sketch", F.col("node").alias("root")))), "clusters")
    crowded = found.where("run is not null").select("run", "node")
    if crowded.limit(1).count() == 0:
        return clusters
    # A crowded run that is of one cluster has nothing left to join.
    in_run = materialize(crowded.distinct().join(clusters, "node", "left").select("run", "node", F.coalesce("root", "node").alias("root")), "crowded")
    mixed = in_run.groupBy("run").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("run")
    unsettled = in_run.join(mixed, "run", "left_semi").select("node").distinct()
    dense = nodes.select("node", "signature", "sketch").join(unsettled, "node").join(clusters.select("node", F.col("root").alias("own")), "node", "left")
    dense = materialize(dense.withColumn("root", F.coalesce("own", "node")), "dense")
    more = _sorted_regions(dense, forest.more_orders(), min(6, forest.dense_depth), max(8, forest.crowd // 4))
    apart = materialize(joined(more, dense.select("node", "sketch", "root")), "apart")
    if not apart.count():
        return clusters
    above = materialize(_contracted(apart).select(F.col("node").alias("root"), F.col("root").alias("top")), "above")
    alone = dense.where("own is null").select("root").join(above, "root").select(F.col("root").alias("node"), F.col("top").alias("root"))
    return materialize(clusters.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root")).union(alone), "clusters")


def near_duplicates(docs: DataFrame, forest: Forest = Forest()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_key, first for every row of docs (doc_id, text).

    Two documents are linked if their shingle sets are at least `percent` similar; component_id is
    the smallest doc_id reachable over links, kept is doc_id = component_id. Null and empty texts
    have no shingles and are linked with nothing; rows with a null id are components of their own,
    with a null id, and kept. Repeated rows have one set, thus one component. Texts are taken whole, however
    long; of ties there are none, for component_id is a minimum. Other columns of docs are not read.
    text_key is a hash of the text; first tells whether (doc_id, text_key) stands for its component: it does for
    one of them in every component (several rows, if they repeat).

    Documents travel as signatures; texts are read again only for clusters. Groups of equal sets
    are one node from the first aggregation on, which is summed in parts. One range sort puts all orders of the
    forest side by side, in partitions of even size whatever is crowded. A region has at most twice `crowd` nodes.
    Crowded clusters are cut in parts that share their first node, and what is not joined to that node
    afterwards meets every part, so no link inside a cluster is skipped.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(F.col("text")).alias("text_key"))
    rows = materialize(read.mapInArrow(_signed(forest), _SIGNED_TYPES), "signed")
    nodes = materialize(rows.where("node is not null and doc_id is not null").groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("doc"), F.first("signature").alias("signature"), F.first("sketch").alias("sketch")), "nodes")
    labels = _linked(read, nodes, _clusters(nodes, forest), forest)
    joined = nodes.select("node", "doc").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = joined.groupBy("root").agg(F.min("doc").alias("lowest"))
    named = joined.join(lowest, "root").select("node", "lowest")
    out = rows.select("doc_id", "text_key", "n_shingles", "node").join(named, "node", "left")
    no_id = F.col("doc_id").isNull()
    component = F.when(no_id, None).otherwise(F.coalesce("lowest.doc_id", "doc_id"))
    first = no_id | F.col("lowest").isNull() | (F.struct("doc_id", "text_key") == F.col("lowest"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), "text_key", first.alias("first"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))).select("doc_id", "n_shingles", "component_id", "kept", "text_key", "first")


def _linked(docs: DataFrame, nodes: DataFrame, clusters: DataFrame, forest: Forest) -> DataFrame:
    """node, root of the confirmed components inside clusters (node, root)."""
    # Crowded clusters only, at most one per `crowd` nodes: as a table, so that Spark knows its size when it joins.
    sizes = clusters.groupBy(F.col("root").alias("cluster")).agg(F.count("*").alias("n")).where(F.col("n") > forest.crowd)
    sizes = materialize(sizes.select("cluster", F.ceil(F.col("n") / forest.crowd).alias("parts")), "sizes")
    placed = clusters.withColumnRenamed("root", "cluster").join(sizes, "cluster", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    # The texts of clustered nodes alone, taken from all documents once; of repeated rows one.
    full = nodes.select("node", "doc.*", "sketch").join(clusters.select("node"), "node").join(docs, ["doc_id", "text_key"])
    full = materialize(full.groupBy("node").agg(F.first("sketch").alias("sketch"), F.first("text").alias("text")), "texts")

    def confirm(members: DataFrame, keys: list[str]) -> DataFrame:
        got = members.join(full, "node").select(*keys, "node", "sketch", "text")
        return got.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_grouped(len(keys), _confirmed(forest), _EDGE), "a long, b long")

    heads = sizes.select("cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("cluster").alias("node"))
    links = materialize(confirm(placed.select("cluster", "part", "node").union(heads).distinct(), ["cluster", "part"]), "links")
    if not sizes.count():
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # What one task confirmed is final for the clusters that it had whole.
    crowded = materialize(placed.where("parts > 1"), "crowded")
    parted = materialize(links.join(crowded.select(F.col("node").alias("a")), "a"), "parted")
    settled = links.join(crowded.select(F.col("node").alias("a")), "a", "left_anti").select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = materialize(_contracted(parted), "linked")
    head = sizes.select(F.col("cluster").alias("node")).join(found, "node").select(F.col("node").alias("cluster"), F.col("root").alias("main"))
    rest = crowded.join(found, "node", "left").join(head, "cluster", "left").where(~F.col("root").eqNullSafe(F.col("main")) | F.col("main").isNull()).select("cluster", "parts", "node")
    rest = materialize(rest, "rest")
    if not rest.count():
        return settled.union(found)
    many = materialize(rest.groupBy("cluster").agg(F.ceil(F.count("*") / forest.crowd).alias("blocks")), "many")
    against = crowded.join(many, "cluster").select("cluster", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "node")
    other = rest.join(many, "cluster").select("cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).alias("block"), "node")
    more = materialize(confirm(against.union(other).distinct(), ["cluster", "part", "block"]), "links")
    # Only what joins components that the parts found apart is left to contract.
    root = found.select(F.col("node").alias("a"), F.col("root").alias("x"))
    apart = more.where("a <> b").join(root, "a", "left").join(root.select(F.col("a").alias("b"), F.col("x").alias("y")), "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
    above = _contracted(apart).select(F.col("node").alias("root"), F.col("root").alias("top"))
    whole = crowded.select("node").join(found, "node", "left").withColumn("root", F.coalesce("root", "node")).join(above, "root", "left")
    return settled.union(whole.select("node", F.coalesce("top", "root").alias("root")))
