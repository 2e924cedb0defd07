"""Exact top-k inner products by a three-phase uniform threshold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash
from .neighbours import matrix, nth_of

#: Vectors and queries that are multiplied at a time; queries that are broadcast at a time (8 bytes a component each).
VECTORS, QUERIES, SENT = 2048, 256, 16_384
#: Below every score.
LEAST = -(1 << 62)


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, v array<long>) of usable rows, every row by itself."""
    x = F.col("v0")
    ok = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return (
        df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v0"))
        .where(F.col("vec_id").isNotNull() & F.coalesce(ok, F.lit(False)))
        .select("vec_id", F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))
    )


class Cutoffs:
    """The ``k`` best totals that a task has seen for each query; the k-th is a safe local cutoff."""

    def __init__(self, queries: int, k: int):
        self.k, self.best = k, np.full((queries, k), LEAST, np.int64)

    def see(self, at: slice, first: np.ndarray, second: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Totals of the heads of both lists (the k + 1 best partial scores) are seen; the cutoffs afterwards."""
        heads = []
        for p in (first, second):
            m = min(p.shape[1], self.k + 1)
            heads.append(np.argpartition(-p, m - 1, axis=1)[:, :m])
        heads = np.sort(np.concatenate(heads, 1), 1)
        total = (np.take_along_axis(first, heads, 1) + np.take_along_axis(second, heads, 1)).astype(np.int64)
        again = np.zeros(heads.shape, bool)
        again[:, 1:] = heads[:, 1:] == heads[:, :-1]
        total[again | np.take_along_axis(own, heads, 1)] = LEAST
        self.best[at] = np.sort(np.concatenate([self.best[at], total], 1), 1)[:, -self.k :]
        return self.best[at][:, 0]


def exact_top_k(df: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """For every query row the k other rows of highest integer inner product, ties to the smaller id; ``is_query`` is a
    condition on ``vec_id``.

    Vectors are read where they are and never shuffled; queries come to them as broadcasts of at most SENT. A task holds
    two lists per query, the partial scores over either half of the components. Phase 1: the totals of the k best
    entries of either list give a local cutoff, which rises as the task goes on; an entry whose two partial scores are
    both below half of it cannot reach it, and the lists end there. What is left of them is written (of entries that
    tie, k of a block suffice). Phase 2: the k-th best total over all tasks is a safe cutoff; the lists are read up to
    half of it. Phase 3: the totals of those entries are resolved, those below the cutoff go, the others are ranked.

    Defined cases: a null id, null vector or one with a null or non-finite component takes no part; shorter vectors
    count as padded with zeros; rows that repeat an id are all candidates, and of those that are queries the smallest
    vector is the query; rows of the query's own id are no candidates of it; fewer than k candidates give fewer rows;
    an empty table gives none. Scores must fit 62 bits.
    """
    spark = df.sparkSession
    vectors = integer_vectors(df, id_col, vec_col, scale)
    width, largest = vectors.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    width, exact = width or 0, (width or 0) * float(largest or 0) ** 2 < 2.0**53
    half, kind = (width + 1) // 2, np.float64 if exact else np.int64  # sums of whole numbers stay exact in doubles
    queries = stash(vectors.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    blocks, lists = max(1, -(-queries.count() // SENT)), None
    for n in range(blocks):
        mine = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == n).toArrow()
        sent = spark.sparkContext.broadcast((mine.column("vec_id").to_numpy(), matrix(mine.column("v"), width, kind)))

        def local(batches, sent=sent):
            asked, q = sent.value
            cutoffs = Cutoffs(len(asked), k)
            for b in batches:
                ids, v = b.column(0).to_numpy(), matrix(b.column(1), width, kind)
                for at in range(0, len(ids), VECTORS):
                    own_ids, part = ids[at : at + VECTORS], v[at : at + VECTORS]
                    for lo in range(0, len(asked), QUERIES):
                        some = slice(lo, lo + QUERIES)
                        first, second = q[some, :half] @ part[:, :half].T, q[some, half:] @ part[:, half:].T
                        own = asked[some, None] == own_ids
                        cut = cutoffs.see(some, first, second, own)
                        least = -(-cut // 2)[:, None]
                        r, c = np.nonzero(((first >= least) | (second >= least)) & ~own)
                        a, z = first[r, c].astype(np.int64), second[r, c].astype(np.int64)
                        keep = a + z >= cut[r]
                        r, c, a, z = r[keep], c[keep], a[keep], z[keep]
                        order = np.lexsort((own_ids[c], -(a + z), r))
                        order = order[nth_of(r[order]) < k]
                        yield pa.RecordBatch.from_arrays([pa.array(asked[some][r[order]]), pa.array(own_ids[c[order]]), pa.array(a[order]), pa.array(z[order])], names=["query_id", "vec_id", "first", "second"])

        part = stash(vectors.mapInArrow(local, "query_id long, vec_id long, first long, second long"), "lists")
        sent.unpersist()
        lists = part if lists is None else lists.union(part)
    top = lambda c: F.slice(F.sort_array(c, asc=False), 1, k)
    cut = (
        lists.groupBy("query_id", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("g"))
        .agg(top(F.collect_list(F.col("first") + F.col("second"))).alias("s"))
        .groupBy("query_id")
        .agg(top(F.flatten(F.collect_list("s"))).alias("s"))
        .select("query_id", F.coalesce(F.get("s", F.lit(k - 1)), F.lit(LEAST)).alias("cut"))
    )
    enough = F.shiftright(F.col("cut") + 1, 1)
    found = lists.join(cut, "query_id").where((F.col("first") >= enough) | (F.col("second") >= enough))
    found = found.select("query_id", "vec_id", (F.col("first") + F.col("second")).alias("score"), "cut").where("score >= cut")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_exact_top_k(spark, sf_dir: str) -> DataFrame:
    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


#: The same rows where the ids of queries are unique; of a repeated one exact_top_k asks with the smallest vector.
OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
