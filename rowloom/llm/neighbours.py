"""Approximate nearest neighbours by largest inner product: a vantage-point tree per shard of the vectors."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

#: Vectors of a shard, of a leaf, and of the sample that gives every search its first bound.
SHARD, LEAF, SEEDS = 4096, 64, 2048
#: Queries that are broadcast at a time (8 bytes a component each).
QUERIES = 65_536
#: What the distance that a subtree must beat is multiplied by; at 1 nothing that could be among the nearest is passed over.
FACTOR = 0.16


def usable(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>): rows with an id and a vector that is not zero and has finite components only."""
    x = F.col("v")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & F.coalesce(fine & F.exists(x, lambda c: c != 0), F.lit(False)))


def matrix(column: pa.ChunkedArray | pa.Array, width: int, kind=np.float64) -> np.ndarray:
    """A list column as rows of ``width`` numbers, shorter vectors padded with zeros."""
    col = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.asarray(col.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    out = np.zeros((len(size), width), kind)
    out[np.arange(width) < size[:, None]] = col.flatten().to_numpy(zero_copy_only=False)
    return out


class VantageTree:
    """A vantage-point tree over a shard's different vectors.

    A vector x of length |x| gets one more component sqrt(M^2 - |x|^2), M the greatest length of all vectors; then the
    vectors of largest inner product with a query are those of least Euclidean distance. A node parts its points by
    their distance from a vantage point at the median and keeps the range of distances of either part.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float, keep: int):
        self.longest = longest
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        new = np.r_[True, (vectors[1:] != vectors[:-1]).any(1)]
        group = np.cumsum(new) - 1
        # Of equal vectors, 2 keep rows suffice: an id of its own has at most ``keep`` of them, so ``keep`` are left without it.
        nth_of_id = nth_of(group, ids)
        some = nth_of_id < keep
        ids, group = ids[some], group[some]
        some = nth_of(group) < 2 * keep
        self.ids, self.start = ids[some], np.searchsorted(group[some], np.arange(new.sum() + 1))
        self.points = vectors[new]
        rest = np.sqrt(np.maximum(longest**2 - (self.points**2).sum(1), 0))
        self.place = np.arange(len(self.points))
        self.nodes: list[tuple] = []
        self._build(np.c_[self.points, rest], 0, len(self.points))
        self.points = np.ascontiguousarray(self.points[self.place])

    def dump(self) -> bytes:
        return pickle.dumps(self.__dict__)

    @classmethod
    def of(cls, blob: bytes) -> "VantageTree":
        out = cls.__new__(cls)
        out.__dict__.update(pickle.loads(blob))
        return out

    def _build(self, full: np.ndarray, lo: int, hi: int) -> int:
        """Nodes over places lo to hi: (vantage point, ranges of the parts, parts), or a leaf (None, lo, hi)."""
        at = len(self.nodes)
        self.nodes.append((None, lo, hi))
        mine = full[self.place[lo:hi]]
        if hi - lo > LEAF:
            centre = mine.mean(0)
            point = mine[int(((mine - centre) ** 2).sum(1).argmax())]
            far = np.sqrt(((mine - point) ** 2).sum(1))
            order, mid = np.argsort(far, kind="stable"), (hi - lo) // 2
            self.place[lo:hi] = self.place[lo:hi][order]
            far = far[order]
            parts = self._build(full, lo, lo + mid), self._build(full, lo + mid, hi)
            self.nodes[at] = (point, ((far[0], far[mid - 1]), (far[mid], far[-1])), parts)
        return at

    def search(self, q: "Search") -> None:
        """Better what ``q`` has found by this shard's points."""
        q.load(self)
        self._visit(0, np.arange(len(q.ids)), q)

    def _visit(self, node: int, act: np.ndarray, q: "Search") -> None:
        point, ranges, parts = self.nodes[node]
        if point is None:
            q.leaf(self, act, ranges, parts)
            return
        far = np.sqrt(np.maximum(q.square[act] + (point**2).sum() - 2 * (q.vectors[act] @ point[:-1]), 0))
        near = far <= (ranges[0][1] + ranges[1][0]) / 2
        for part, who in ((0, near), (1, ~near), (1, near), (0, ~near)):
            lo, hi = ranges[part]
            least = np.maximum(far[who] - hi, lo - far[who])
            left = act[who][least <= q.bound(act[who])]
            if len(left):
                self._visit(parts[part], left, q)


def nth_of(*keys: np.ndarray) -> np.ndarray:
    """Place of each entry among those with its keys (which stand together)."""
    n = len(keys[0])
    first = np.zeros(n, bool)
    for k in keys:
        first |= np.r_[True, k[1:] != k[:-1]][:n]
    return np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))


class Search:
    """A block of queries and the ``k`` best entries found for each so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, floor: np.ndarray, k: int, factor: float):
        self.ids, self.vectors, self.k, self.factor = ids, vectors, k, factor
        self.score, self.found = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
        self.floor = floor  # a score that at least k entries are known to reach
        self.square = (vectors**2).sum(1)
        self.scored = 0

    def load(self, tree: VantageTree) -> None:
        self.longest = tree.longest

    def least(self, act: np.ndarray) -> np.ndarray:
        """The score that an entry must reach. Until k entries are found any will do, so that every query gets k."""
        last = self.score[act, -1]
        return np.where(last > -np.inf, np.maximum(last, self.floor[act]), -np.inf)

    def bound(self, act: np.ndarray) -> np.ndarray:
        """How far a point may be that matters, times the factor, and a little for rounding."""
        far = np.sqrt(np.maximum(self.square[act] + self.longest**2 - 2 * self.least(act), 0))
        # an infinite distance until k entries are found
        return self.factor * far + 1e-9 * (self.longest + np.sqrt(self.square[act]))

    def leaf(self, tree: VantageTree, act: np.ndarray, lo: int, hi: int) -> None:
        rough = self.vectors[act] @ tree.points[lo:hi].T
        self.scored += rough.size
        slack = 1e-12 * tree.longest * np.sqrt(self.square[act])
        r, c = np.nonzero(rough >= (self.least(act) - slack)[:, None])
        if not len(r):
            return
        # Row sums of products are the same wherever the vectors stand, so that equal vectors tie.
        score = (self.vectors[act[r]] * tree.points[lo + c]).sum(1)
        first, last = tree.start[tree.place[lo + c]], tree.start[tree.place[lo + c] + 1]
        many = last - first
        at = np.repeat(first - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
        self.merge(np.repeat(act[r], many), tree.ids[at], np.repeat(score, many))

    def merge(self, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        other = ids != self.ids[row]
        row, ids, score = row[other], ids[other], score[other]
        rows = np.unique(row)
        row = np.r_[row, np.repeat(rows, self.k)]
        ids, score = np.r_[ids, self.found[rows].ravel()], np.r_[score, self.score[rows].ravel()]
        order = np.lexsort((ids, -score, row))
        order = order[(n := nth_of(row[order])) < self.k]
        n = n[n < self.k]
        self.score[row[order], n], self.found[row[order], n] = score[order], ids[order]


def build_index(vectors: DataFrame, keep: int, shard: int = SHARD) -> DataFrame:
    """(shard, tree) of usable() rows, written to the shared folder; every row is in one shard, by a hash of its id."""
    n, width, longest = vectors.agg(F.count("*"), F.max(F.size("v")), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)))).first()
    many = max(1, -(-n // shard))

    def build(key, table):
        tree = VantageTree(table.column("vec_id").to_numpy(), matrix(table.column("v"), width), longest, keep)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "tree": pa.array([tree.dump()], pa.binary())})

    placed = vectors.select(F.pmod(F.xxhash64("vec_id"), F.lit(many)).cast("int").alias("shard"), "vec_id", "v")
    index = stash(placed.groupBy("shard").applyInArrow(build, "shard int, tree binary"), "trees")
    index.width = width or 0
    return index


def nearest(df: DataFrame, is_query: Column, k: int = 20, factor: float = FACTOR, id_col: str = "vec_id", vec_col: str = "embedding", shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): for every query row the ``k`` other rows of largest inner product that the trees
    give, ties to the smaller id; ``is_query`` is a condition on ``vec_id``.

    A subtree is passed over when no point of it can be nearer than ``factor`` times the distance of the k-th entry
    found so far (triangle inequality); factor 1 gives the exact answer. The first such distance is that of the k-th
    best of a sample of SEEDS vectors, which is never less than the true one. The trees stay where they were built; queries come
    to them as broadcasts of at most QUERIES. What a task has found in one shard bounds its search of the next.

    Defined cases: rows with a null id and vectors that are null, empty, zero or hold null or non-finite components take
    no part; shorter vectors are padded with zeros; rows that repeat an id are all candidates, and of those that are
    queries the smallest vector is the query; rows of the query's own id are no candidates of it; fewer candidates
    give fewer rows; other columns play no part; an empty table gives an empty result.
    """
    spark = df.sparkSession
    vectors = usable(df, id_col, vec_col)
    index = build_index(vectors, k, shard)
    width = index.width
    asked = vectors.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    seeds = vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SEEDS).toArrow()
    sample = spark.sparkContext.broadcast((seeds.column("vec_id").to_numpy(), matrix(seeds.column("v"), width)))

    def first_bounds(batches):
        ids, points = sample.value
        for b in batches:
            own, q = b.column(0).to_numpy(), matrix(b.column(1), width)
            floor = np.full(len(own), -np.inf)
            if len(ids) > k:
                for at in range(0, len(own), 256):
                    s = np.where(own[at : at + 256, None] == ids, -np.inf, q[at : at + 256] @ points.T)
                    floor[at : at + 256] = np.partition(s, -k, axis=1)[:, -k]
                floor -= 1e-9 * np.abs(floor)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(floor)], names=["vec_id", "v", "floor"])

    queries = stash(asked.mapInArrow(first_bounds, "vec_id long, v array<double>, floor double"), "queries")
    blocks = max(1, -(-queries.count() // QUERIES))
    found = None
    for n in range(blocks):
        mine = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == n).toArrow()
        sent = spark.sparkContext.broadcast((mine.column("vec_id").to_numpy(), matrix(mine.column("v"), width), mine.column("floor").to_numpy()))

        def search(batches, sent=sent):
            q = Search(*sent.value, k, factor)
            for b in batches:
                for blob in b.column("tree"):
                    VantageTree.of(blob.as_py()).search(q)
            row, n = np.nonzero(q.score > -np.inf)
            for at in range(0, len(row), 100_000):
                r, c = row[at : at + 100_000], n[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(q.ids[r]), pa.array(q.found[r, c]), pa.array(q.score[r, c])], names=["query_id", "vec_id", "score"])

        part = index.select("tree").mapInArrow(search, "query_id long, vec_id long, score double")
        if blocks > 1:
            part = stash(part, "found")
            sent.unpersist()
        found = part if found is None else found.union(part)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_vantage_point_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
