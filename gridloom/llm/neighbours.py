"""Approximate nearest neighbours by a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample: each node's rows are split by k-means into at most FAN children until LEAF rows
or fewer are left. Every row goes down to the leaf of the nearest centre at each node. A query goes down likewise and
puts the children that it passes by into a priority queue, nearest centre first; it then goes down from the nearest
of these, and so on, until it has visited enough leaves. How many are enough is calibrated: the visits widen until
the true neighbours of a sample of rows, found by brute force over all rows, lie in visited leaves as often as asked.

Equal vectors are one point with the least of their ids, as many as a query could need, so no number of copies makes
a crowded leaf. Leaves that lie together in the tree are bundled to pieces of PIECE points, larger leaves are split
into such; a query travels once to each piece that it visits, and the queries of a piece are searched in blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import importable, row_key, stored, table

#: Children of a node, points of a leaf, most points that the tree is fitted on (64 MB at 64 components), k-means rounds.
FAN, LEAF, MOST_SAMPLE, ROUNDS = 16, 128, 131_072, 6
#: Points of the sample in a leaf at least; so a tree has no more than MOST_SAMPLE / LEAST_LEAF leaves or so.
LEAST_LEAF = 8
#: Rows that the visits are calibrated on, and the share of their true neighbours that must lie in visited leaves.
CALIBRATED, RECALL = 256, 0.95
#: Points of a piece, queries of a block, numbers of a table of differences.
PIECE, BLOCK, CELLS = 4096, 1024, 4_000_000
SEED = 11


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to rows of c but for what is equal for all c."""
    with np.errstate(all="ignore"):
        return np.nan_to_num((c * c).sum(1) - 2 * (x @ c.T), nan=np.inf)


def _means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Centres of k-means; none is without a row of its own."""
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        near = _squares(x, c).argmin(1)
        order = np.argsort(near, kind="stable")
        own, first = np.unique(near[order], return_index=True)
        c = np.add.reduceat(x[order], first) / np.diff(np.append(first, len(x)))[:, None]
    return c[np.unique(_squares(x, c).argmin(1))]


@dataclass
class Tree:
    """Nodes by number, 0 the root: the centre of each, and its children's first number and count (0: a leaf)."""

    centres: np.ndarray
    first: np.ndarray
    count: np.ndarray

    @staticmethod
    def fit(sample: np.ndarray, leaf: int, fan: int = FAN, seed: int = SEED) -> Tree:
        rng = np.random.default_rng(seed)
        centres, first, count = [np.zeros((1, sample.shape[1]))], [0], [0]
        level = [(0, np.arange(len(sample)))]
        while level:
            below = []
            for node, rows in level:
                if len(rows) <= leaf:
                    continue
                x = sample[rows]
                c = _means(x, min(fan, -(-2 * len(rows) // leaf), len(rows)), rng)
                if len(c) < 2:
                    continue
                near = _squares(x, c).argmin(1)
                first[node], count[node] = len(first), len(c)
                below += [(len(first) + j, rows[near == j]) for j in range(len(c))]
                centres.append(c)
                first += [0] * len(c)
                count += [0] * len(c)
            level = below
        return Tree(np.concatenate(centres), np.array(first), np.array(count))

    def children(self, node: int) -> np.ndarray:
        return self.centres[self.first[node] : self.first[node] + self.count[node]]

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of x."""
        at = np.zeros(len(x), np.int64)
        while True:
            open_ = np.flatnonzero(self.count[at])
            if not len(open_):
                return at
            for node in np.unique(at[open_]):
                rows = open_[at[open_] == node]
                at[rows] = self.first[node] + _squares(x[rows], self.children(node)).argmin(1)

    def visited(self, v: np.ndarray) -> Iterator[int]:
        """All leaves, best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            while self.count[node]:
                with np.errstate(all="ignore"):
                    off = np.nan_to_num(((self.children(node) - v) ** 2).sum(1), nan=np.inf)
                best, first = int(off.argmin()), int(self.first[node])
                for j, d in enumerate(off.tolist()):
                    if j != best:
                        heapq.heappush(queue, (d, first + j))
                node = first + best
            yield node

    def in_order(self) -> list[int]:
        """The leaves from left to right, so that those of one branch lie together."""
        out, stack = [], [0]
        while stack:
            node = stack.pop()
            if self.count[node]:
                stack += range(self.first[node] + self.count[node] - 1, self.first[node] - 1, -1)
            else:
                out.append(node)
        return out


def matrix(column, dims: int) -> np.ndarray:
    """The vectors of an Arrow column in double precision; none is null or of another length."""
    chunks = column.chunks if hasattr(column, "chunks") else [column]
    parts = [c.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims) for c in chunks]
    return np.concatenate(parts) if parts else np.zeros((0, dims))


def usable(vector: Column, dims: int) -> Column:
    """Whether it has dims components, none null or non-finite, and not all zero."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) == dims) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows of q to rows of x."""
    out = np.empty((len(q), len(x)))
    step = max(1, CELLS // max(1, x.size))
    with np.errstate(all="ignore"):
        for a in range(0, len(q), step):
            off = q[a : a + step, None] - x[None]
            out[a : a + step] = np.sqrt(np.einsum("ijk,ijk->ij", off, off))
    return out


def _nearest(d: np.ndarray, own: np.ndarray, ids: np.ndarray, bounds: np.ndarray, k: int, need: int) -> tuple:
    """Row, id, distance and point of the k nearest ids of each row of distances, its own id left out.

    ids[bounds[j]:bounds[j+1]] are the ids of point j. Of a row's points the need nearest count, and all as near as these;
    points at no distance (NaN) don't.
    """
    if d.shape[1] > need:
        last = np.partition(np.where(np.isnan(d), np.inf, d), need - 1, 1)[:, need - 1 : need]
        d = np.where(d <= last, d, np.nan)
    row, point = np.nonzero(~np.isnan(d))
    many = np.diff(bounds)[point]
    at = np.repeat(bounds[point], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    row, point = np.repeat(row, many), np.repeat(point, many)
    id_, far = ids[at], d[row, point]
    other = id_ != own[row]
    row, id_, far, point = row[other], id_[other], far[other], point[other]
    order = np.lexsort((id_, far, row))
    row, id_, far, point = row[order], id_[order], far[order], point[order]
    first = np.searchsorted(row, row)
    keep = np.arange(len(row)) - first < k
    return row[keep], id_[keep], far[keep], point[keep]


@dataclass
class Leaves:
    """The tree, and by leaf its points, first piece and number of pieces; visits is how many leaves a query sees."""

    tree: Tree
    sizes: np.ndarray
    piece: np.ndarray
    pieces: np.ndarray
    visits: int = 0

    @staticmethod
    def of(tree: Tree, counts: list[tuple[int, int]]) -> Leaves:
        sizes, piece = np.zeros((2, len(tree.first)), np.int64)
        for leaf, many in counts:
            sizes[leaf] = many
        order, total = tree.in_order(), int(sizes.sum())
        level = max(1, -(-total // max(1, -(-total // PIECE))))
        piece[order] = (np.cumsum(sizes[order]) - sizes[order]) // level
        return Leaves(tree, sizes, piece, np.maximum(1, -(-sizes // PIECE)))

    def widen(self, v: np.ndarray, need: int) -> list[int]:
        """Leaves that a query visits: the calibrated number, and more while these hold fewer than need points."""
        out, held = [], 0
        for leaf in self.tree.visited(v):
            if len(out) >= self.visits and held >= need:
                break
            out.append(leaf)
            held += int(self.sizes[leaf])
        return out


@dataclass
class Index:
    """points (leaf, v and ids) in the shared folder, what is known of the leaves, components of a vector, rows indexed."""

    points: DataFrame
    leaves: Leaves
    dims: int
    rows: int


def _valid(df: DataFrame, dims: int, id_: str, vector: str) -> DataFrame:
    return df.select(F.col(id_).cast("long").alias("id"), F.col(vector).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v"), dims))


def _sampled(rows: DataFrame, share: float, seed: int) -> DataFrame:
    """Distinct rows whose hash is low: about that share of them or less, the same ones on a retry, however often one id or row occurs."""
    return rows.where(F.pmod(F.xxhash64(F.lit(seed), "id", "v"), F.lit(1 << 30)) < int(share * (1 << 30))).distinct()


def build(df: DataFrame, dims: int, keep: int, id_: str = "vec_id", vector: str = "embedding", leaf: int = LEAF, most_sample: int = MOST_SAMPLE) -> Index:
    """An index of all rows; keep ids of equal vectors, the least ones, are held.

    Vectors that are null, zero, of another number of components or hold null or non-finite ones take no part, nor
    do rows without an id. Rows alike in both count once. Other columns aren't looked at.
    """
    importable(df.sparkSession)
    rows = _valid(df, dims, id_, vector)
    n = rows.count()
    share = min(1.0, most_sample / max(n, 1))
    sample = matrix(_sampled(rows, share, SEED).select("v").toArrow().column("v"), dims)
    sample = np.unique(sample, axis=0)
    tree = Tree.fit(sample, max(LEAST_LEAF, int(leaf * share))) if len(sample) else Tree(np.zeros((1, dims)), np.zeros(1, int), np.zeros(1, int))
    copies = Window.partitionBy("h", "v").orderBy("id")
    few = rows.distinct().withColumn("h", F.xxhash64("v")).withColumn("nth", F.row_number().over(copies)).where(F.col("nth") <= keep)
    points = few.groupBy("h", "v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select("v", "ids")
    kind = dict(points.dtypes)["v"]

    def down(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(tree.leaf_of(matrix(b.column("v"), dims)), pa.int32()), *b.columns], names=["leaf", "v", "ids"])

    points = stored(points.mapInArrow(down, f"leaf int, v {kind}, ids array<bigint>"), "points")
    counts = points.groupBy("leaf").count().collect()  # one row a leaf
    return Index(points, Leaves.of(tree, counts), dims, n)


def _placed(index: Index) -> DataFrame:
    """Points with the numbers of their piece and, where a leaf has several, of their part of it."""
    leaves = index.leaves
    rows = [(leaf, int(leaves.piece[leaf]), int(leaves.pieces[leaf])) for leaf in leaves.tree.in_order()]
    by_leaf = index.points.sparkSession.createDataFrame(rows, "leaf int, piece long, parts long")
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("v"), "parts")).otherwise(F.lit(-1))
    return index.points.join(F.broadcast(by_leaf), "leaf").withColumn("part", part).drop("parts")


def _true_neighbours(index: Index, ids: np.ndarray, v: np.ndarray, k: int) -> DataFrame:
    """q (the place in ids), id, score and leaf of the k nearest of each of a bounded number of queries, over all points."""
    dims = index.dims

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        best = [np.zeros(0, t) for t in (np.int64, np.int64, float, np.int64)]
        for b in batches:
            if not b.num_rows:
                continue
            flat, bounds = _lists(b.column("ids"))
            row, id_, far, point = _nearest(_distances(v, matrix(b.column("v"), dims)), ids, flat, bounds, k, k + 1)
            best = [np.append(a, x) for a, x in zip(best, (row, id_, far, b.column("leaf").to_numpy()[point]), strict=True)]
            order = np.lexsort((best[1], best[2], best[0]))
            best = [x[order] for x in best]
            nth = np.arange(len(order)) - np.searchsorted(best[0], best[0])
            best = [x[nth < k] for x in best]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], names=["q", "id", "score", "leaf"])

    found = index.points.select("v", "ids", "leaf").mapInArrow(run, "q long, id long, score double, leaf long")
    w = Window.partitionBy("q").orderBy("score", "id")
    return found.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k)


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow column of lists as one flat array and the bounds of each list in it."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(sizes)).astype(np.int64)


def calibrate(index: Index, df: DataFrame, k: int, recall: float = RECALL, rows: int = CALIBRATED, id_: str = "vec_id", vector: str = "embedding") -> float:
    """Widens index.leaves.visits until about so many rows of df find that share of their true neighbours; the share found."""
    valid = _valid(df, index.dims, id_, vector)
    asked = _sampled(valid, min(1.0, rows / max(index.rows, 1)), SEED + 1).toArrow()
    v, leaves = matrix(asked.column("v"), index.dims), index.leaves
    true = _true_neighbours(index, asked.column("id").to_numpy(), v, k).select("q", "leaf").toArrow() if len(v) else None
    every = len(leaves.tree.in_order())
    if not true or not true.num_rows:
        leaves.visits = every
        return 1.0
    place = np.zeros((len(v), len(leaves.sizes)), np.int64)
    for own, q in zip(place, v, strict=True):
        own[[*leaves.tree.visited(q)]] = np.arange(every)
    needed, leaves.visits = place[true.column("q").to_numpy(), true.column("leaf").to_numpy()], 1
    while (needed < leaves.visits).mean() < recall:
        leaves.visits = min(every, leaves.visits + 1 + leaves.visits // 16)
    return float((needed < leaves.visits).mean())


def search(index: Index, queries: DataFrame, k: int, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance) of the k nearest points found, ties to the smaller vec_id.

    A query isn't its own neighbour, nor is another vector of its id. Queries that build() would leave out give no
    rows; rows alike in id and vector are one query. Where fewer than k others are indexed all are found.
    """
    asked = _valid(queries, index.dims, id_, vector).distinct()
    own = asked.groupBy("id").agg(F.count("*").alias("own"))
    asked = stored(asked.join(own, "id").select(row_key().alias("q"), "id", "v", "own"), "asked")
    kind, leaves, dims = dict(asked.dtypes)["v"], index.leaves, index.dims

    def visits(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            at, piece, part, seen_at = [], [], [], []
            for row, (v, many) in enumerate(zip(matrix(b.column("v"), dims), b.column("own").to_pylist(), strict=True)):
                seen: dict[tuple[int, int], list[int]] = {}
                for leaf in leaves.widen(v, k + many):
                    parts = int(leaves.pieces[leaf])
                    for p in range(parts) if parts > 1 else (-1,):
                        seen.setdefault((int(leaves.piece[leaf]), p), []).append(leaf)
                at += [row] * len(seen)
                piece += [key[0] for key in seen]
                part += [key[1] for key in seen]
                seen_at += seen.values()
            own = b.take(pa.array(at, pa.int64()))
            made = [pa.array(piece, pa.int64()), pa.array(part, pa.int64()), pa.array(seen_at, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*own.columns, *made], names=[*b.schema.names, "piece", "part", "leaves"])

    tasks = max(asked.sparkSession.sparkContext.defaultParallelism, -(-asked.count() // BLOCK))  # few rows, much work
    met = stored(asked.repartition(tasks).mapInArrow(visits, f"q long, id long, v {kind}, own long, piece long, part long, leaves array<int>"), "visits")
    blocks = met.groupBy("piece", "part").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    left = met.join(blocks, ["piece", "part"]).withColumn("block", F.pmod(F.xxhash64("q"), "blocks"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    right = _placed(index).join(blocks.toDF("piece", "part", "blocks"), ["piece", "part"]).withColumn("block", every)

    def near(left, right):
        import pyarrow as pa

        q, x = matrix(left.column("v"), dims), matrix(right.column("v"), dims)
        d = np.full((len(q), len(x)), np.nan)
        flat, bounds = _lists(left.column("leaves"))
        row, leaf = np.repeat(np.arange(len(q)), np.diff(bounds)), right.column("leaf").to_numpy()
        for one in np.unique(leaf):
            rows, points = row[flat == one], np.flatnonzero(leaf == one)
            d[np.ix_(rows, points)] = _distances(q[rows], x[points])
        own = left.column("id").to_numpy()
        most = max(left.column("own").to_pylist(), default=0)
        at, id_, far, _ = _nearest(d, own, *_lists(right.column("ids")), k, k + most)
        return pa.table({"q": left.column("q").to_numpy()[at], "query_id": own[at], "vec_id": id_, "score": far})

    key = ["piece", "part", "block"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(near, "q long, query_id long, vec_id long, score double")
    w = Window.partitionBy("q").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_neighbours(spark, sf_dir: str, k: int = 10, every: int = 100, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of each row whose vec_id is divisible by every, against all rows.

    Embeddings that are null, zero, not of 64 components, or hold null or non-finite ones take no part; an empty
    table gives no rows.
    """
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index = build(rows, 64, k + 1)
    calibrate(index, rows, k, recall)
    return search(index, rows.where(F.col("vec_id") % every == 0), k)
