"""Resharding by minimum-cost flow over block transfers."""

from __future__ import annotations

import heapq
import uuid
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from .common import fresh

#: Blocks per old shard: the smallest thing that moves. The driver holds one size per block.
BLOCKS = 1024


def min_cost_flow(supply: list[int], capacity: list[int], cost=lambda i, j: 0 if i == j else 1) -> dict[tuple[int, int], int]:
    """Bytes to send from each old shard to each new one at least cost (successive shortest paths with potentials).

    Nodes are shards, so the graph has a fixed small size whatever the data. Raises if the capacities are too small.
    """
    if sum(supply) > sum(capacity):
        raise ValueError("capacities are below the total size")
    n, m = len(supply), len(capacity)
    src, dst = n + m, n + m + 1
    graph: list[list[list]] = [[] for _ in range(n + m + 2)]

    def edge(u: int, v: int, cap: int, c: int) -> None:
        graph[u].append([v, cap, c, len(graph[v])])
        graph[v].append([u, 0, -c, len(graph[u]) - 1])

    for i, s in enumerate(supply):
        edge(src, i, s, 0)
        for j in range(m):
            edge(i, n + j, s, cost(i, j))
    for j, c in enumerate(capacity):
        edge(n + j, dst, c, 0)
    left, potential = sum(supply), [0] * len(graph)
    while left:
        best, via = {src: 0}, {}
        heap = [(0, src)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > best[u]:
                continue
            for k, (v, cap, c, _) in enumerate(graph[u]):
                if cap and (new := d + c + potential[u] - potential[v]) < best.get(v, 1 << 62):
                    best[v], via[v] = new, (u, k)
                    heapq.heappush(heap, (new, v))
        for v, d in best.items():
            potential[v] += d
        amount, v = left, dst
        while v != src:
            u, k = via[v]
            amount, v = min(amount, graph[u][k][1]), u
        v = dst
        while v != src:
            u, k = via[v]
            graph[u][k][1] -= amount
            graph[v][graph[u][k][3]][1] += amount
            v = u
        left -= amount
    return {(i, e[0] - n): graph[e[0]][e[3]][1] for i in range(n) for e in graph[i] if n <= e[0] < n + m and graph[e[0]][e[3]][1]}


def place_units(units: list[tuple[int, int]], capacity: list[int]) -> list[int]:
    """New shard of each (old shard, bytes) unit: the flow's transfers realised in whole units, largest first, then
    single units moved from the fullest shard to the emptiest while that evens the sizes out. Each such move lowers
    the sum of squared distances from the capacities, so the moves come to an end by themselves."""
    n = len(capacity)
    old_n = max([n, *(o + 1 for o, _ in units)])
    supply = [0] * old_n
    for o, b in units:
        supply[o] += b
    owe: dict[int, dict[int, int]] = defaultdict(dict)
    for (i, j), f in min_cost_flow(supply, capacity).items():
        if i != j:
            owe[i][j] = f
    to = [o for o, _ in units]
    for k in sorted(range(len(units)), key=lambda k: (-units[k][1], k)):
        o, b = units[k]
        j = max(owe[o], key=lambda j: (owe[o][j], -j), default=None)
        if j is not None and (owe[o][j] >= b or o >= n):
            owe[o][j] -= b
            to[k] = j
        elif o >= n:
            to[k] = k % n
    size, held = [0] * n, [[] for _ in range(n)]
    for k, (_, b) in enumerate(units):
        size[to[k]] += b
        held[to[k]].append(k)
    while True:
        excess = [size[j] - capacity[j] for j in range(n)]
        under = min(range(n), key=excess.__getitem__)
        for over in sorted(range(n), key=lambda j: -excess[j]):  # a shard that one large unit overfills cannot give
            gap = excess[over] - excess[under]
            fit = [k for k in held[over] if 0 < units[k][1] < gap]
            if fit:
                break
        else:
            break
        k = min(fit, key=lambda k: (abs(units[k][1] - gap // 2), k))
        held[over].remove(k)
        held[under].append(k)
        size[over] -= units[k][1]
        size[under] += units[k][1]
        to[k] = under
    return to


def row_key(id_col: str, text_col: str) -> dict[str, Column]:
    """What tells rows apart that are not alike: doc_id, size (UTF-8 bytes and 1) and text_crc32."""
    return {
        "doc_id": F.col(f"`{id_col}`").cast("long"),
        "size": (F.coalesce(F.octet_length(f"`{text_col}`"), F.lit(0)) + 1).cast("long"),
        "text_crc32": F.coalesce(F.crc32(F.col(f"`{text_col}`").cast("binary")), F.lit(0)).cast("long"),
    }


def reshard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", old_shard=None, weights: list[float] | None = None) -> DataFrame:
    """Deal rows to ``shards`` shards of near equal bytes (or bytes in proportion to ``weights``), moving least.

    Size is the text's UTF-8 bytes plus 1. ``old_shard`` is the present shard (a Column, non-negative int; by
    default a hash of the text modulo ``shards``). Rows fall into blocks (old shard, text hash); block sizes are
    summed on the executors, the driver solves a flow between shards and moves whole blocks. Rows of equal texts
    (of one old shard) share a block and stay together, whatever their number: a group of copies larger than a shard's
    share makes its shard larger, and the others share the rest.
    Slots: blocks get offsets inside their shard, rows a number inside their part of the block (by id, where a block
    has many rows), so no task numbers a whole shard or a whole group of copies.

    Defined cases: null text has size 1 and crc 0; null ids are rows as others; repeated rows get slots of their own;
    an empty table gives an empty result; extra columns are ignored.
    """
    spark = docs.sparkSession
    h = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))  # null as the empty text, which has the same size and crc
    rows = docs.select(
        *[c.alias(n) for n, c in row_key(id_col, text_col).items()],
        (F.pmod(h, F.lit(shards)) if old_shard is None else old_shard).cast("int").alias("old"),
        F.pmod(F.shiftright(h, 20), F.lit(BLOCKS)).cast("int").alias("blk"),
    )
    sizes = [tuple(r) for r in rows.groupBy("old", "blk").agg(F.sum("size"), F.count("*")).collect()]  # at most shards x BLOCKS rows
    total = sum(r[2] for r in sizes)
    share = weights or [1.0] * shards
    capacity = [int(total * w / sum(share)) for w in share]
    capacity[0] += total - sum(capacity)
    per_task = max(1000, 8 * sum(r[3] for r in sizes) // max(1, shards * BLOCKS))
    parts = {(o, b): -(-n // per_task) for o, b, _, n in sizes if n > per_task}
    split = spark.createDataFrame([(*k, n) for k, n in parts.items()], "old int, blk int, n int")
    unit = rows.join(F.broadcast(split), ["old", "blk"], "left").withColumn("sub", F.coalesce(F.pmod(F.xxhash64("doc_id", "text_crc32"), F.col("n")), F.lit(0)).cast("int")).drop("n")
    pieces = sorted(tuple(r) for r in unit.groupBy("old", "blk", "sub").agg(F.count("*")).collect()) if parts else sorted((o, b, 0, n) for o, b, _, n in sizes)
    names = sorted((o, b) for o, b, _, _ in sizes)
    bytes_of = {(o, b): size for o, b, size, _ in sizes}
    to = dict(zip(names, place_units([(u[0], bytes_of[u]) for u in names], capacity), strict=True)) if names else {}
    start, table = [0] * shards, []
    for o, b, s, n in pieces:
        j = to[o, b]
        table.append((o, b, s, j, start[j]))
        start[j] += n
    plan = spark.createDataFrame(table, "old int, blk int, sub int, shard int, first long")
    within = F.row_number().over(_by("old", "blk", "sub").orderBy("doc_id", "text_crc32"))
    return (
        unit.withColumn("at", within)
        .join(F.broadcast(plan), ["old", "blk", "sub"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("at") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("old").alias("old_shard"))
    )


def _by(*cols):
    return Window.partitionBy(*cols)


def rewrite_affected(docs: DataFrame, assigned: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", old_shard: Column | None = None) -> list[int]:
    """Write the shards that gain or lose rows under ``path`` as shard=N folders; return their numbers.

    ``assigned`` comes from reshard over the same rows. Rows meet by id, size and crc32 of the text (null ids are equal),
    and by ``old_shard`` if it is given, as it should be where alike rows lie in several old shards. Alike rows
    that go to several shards are dealt out by their number; all others, whatever their number, go where their key goes,
    so that no task numbers a group of copies. The new folders are written beside the old ones and their rows counted;
    only if each holds what ``assigned`` gives it are they put in place, else ValueError is raised and nothing is
    replaced. Shards that keep exactly their rows are left as they are; the folder of a shard that keeps no row is
    removed. ``docs`` must not read from ``path`` (ValueError). A column of ``docs`` named shard is replaced; others
    come back as they are. Ten thousand shards at most, so their numbers fit on the driver.
    """
    spark = docs.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    fs = jpath(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    root = fs.makeQualified(jpath(path)).toUri().getPath().rstrip("/") + "/"
    if any(spark._jvm.java.net.URI(f).getPath().startswith(root) for f in docs.inputFiles()):
        raise ValueError(f"the rows are read from {path}; write to another folder")
    moved = assigned.where("shard <> old_shard")
    changed = sorted(r[0] for r in moved.select(F.explode(F.array("shard", "old_shard")).alias("s")).distinct().collect())
    expected = {r[0]: r[1] for r in assigned.where(F.col("shard").isin(changed)).groupBy("shard").count().collect()}

    kept = [c for c in docs.columns if c.lower() != "shard"]
    names = row_key(id_col, text_col) | ({} if old_shard is None else {"old_shard": old_shard.cast("int")})
    key = [fresh([*kept, "shard"], "key_" + n) for n in names]
    n, several, mine = (fresh([*kept, *key, "shard"], x) for x in ("nth", "several", "mine"))
    rows = docs.withColumns(dict(zip(key, names.values(), strict=True))).select(*[F.col(f"`{c}`") for c in kept], *key)
    dealt = assigned.select(*[F.col(c).alias(k) for c, k in zip(names, key, strict=True)], F.col("shard").alias(mine), "slot")
    goes = dealt.groupBy(*key).agg(F.min(mine).alias("shard"), (F.min(mine) < F.max(mine)).alias(several))
    same = lambda a, b, more=(): F.expr(" AND ".join(f"{a}.`{k}` <=> {b}.`{k}`" for k in (*key, *more)))
    met = rows.alias("r").join(goes.alias("g"), same("r", "g")).select("r.*", "g.shard", f"g.{several}")
    numbered = lambda df, order: df.withColumn(n, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    left = numbered(met.where(several).drop("shard"), [F.col(f"`{c}`") for c in kept if not isinstance(docs.schema[c].dataType, (MapType, VariantType))] or [F.lit(0)])
    right = numbered(dealt.alias("d").join(goes.where(several).alias("g"), same("d", "g"), "left_semi"), ["slot"])
    parted = left.alias("r").join(right.alias("d"), same("r", "d", [n])).select("r.*", F.col(f"d.{mine}").alias("shard"))
    out = met.where(~F.col(several)).unionByName(parted.drop(n)).where(F.col("shard").isin(changed)).select(*[F.col(f"`{c}`") for c in kept], "shard", *key)

    new = f"{path.rstrip('/')}/_new-{uuid.uuid4().hex}"
    tasks = F.pmod(F.xxhash64(*key), F.lit(max(1, -(-max(expected.values(), default=0) // 1_000_000))))
    out.repartition("shard", tasks).sortWithinPartitions("shard", *key).drop(*key).write.partitionBy("shard").parquet(new)
    try:
        written = {r[0]: r[1] for r in spark.read.parquet(new).groupBy("shard").count().collect()} if expected else {}
        if written != expected:
            raise ValueError(f"rows of shards do not add up to the plan: {written} for {expected}; nothing was replaced")
        for shard in changed:
            fs.delete(jpath(f"{path}/shard={shard}"), True)
            if shard in expected:
                fs.rename(jpath(f"{new}/shard={shard}"), jpath(f"{path}/shard={shard}"))
    finally:
        fs.delete(jpath(new), True)
    return changed


def op2_min_cost_reshard(spark, sf_dir: str) -> DataFrame:
    return reshard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
