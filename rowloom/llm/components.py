"""Connected components: each task contracts what it has of the links, then alternating star contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keyed_join, stash, tidy


#: Links that a task contracts at a time, about (16 bytes each).
LOCAL = 500_000


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links -> (node, least node that these links reach from it), for the nodes of which it is another."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = np.split(ends.ravel(), 2)
    label = np.arange(len(nodes))
    while True:
        new, least = label.copy(), np.minimum(label[a], label[b])
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            moved = np.flatnonzero(label != np.arange(len(label)))
            return nodes[moved], nodes[label[moved]]
        label = new


def contract(batches):
    """mapInArrow: all links of a task, contracted."""
    held = [pa.Table.from_batches([b]) for b in batches]
    if held:
        links = pa.concat_tables(held)
        u, v = contracted(links.column(0).to_numpy(), links.column(1).to_numpy())
        yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a long, b long) links -> (node, component), component the smallest node reachable.

    Nodes without links do not appear; self links and repeated links are harmless; null ends are dropped; an empty
    table gives an empty result. First each of the tasks, one for about LOCAL links, contracts its own to stars; where
    one task has them all, that is the answer. Else each round is two star contractions (large, then small); the loop
    ends when the edge set no longer changes, and raises if ``rounds`` were not enough.
    """
    e = stash(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    tasks = max(1, -(-e.count() // LOCAL))
    e = stash(e.coalesce(tasks).mapInArrow(contract, "u long, v long"), "stars")
    if tasks == 1:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v"))).distinct()
    e = stash(e.distinct(), "edges")
    before, old = e.count(), None
    for _ in range(rounds):
        if before == 0 or old is not None and e.join(old, ["u", "v"], "left_anti").isEmpty():
            tidy(e.sparkSession)
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v"))).distinct()
        # Large star: every edge's upper end goes to the least neighbour of its lower end.
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("c"))
        large = keyed_join(e.select(F.col("u").alias("w"), F.col("v").alias("u")), low, ["u"], before).select(F.col("w").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        done, e = e, stash(small, "edges")
        now = e.count()
        old = done if now == before else None  # as many edges, none of them new: the same edges
        if old is None:
            discard(done)
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
