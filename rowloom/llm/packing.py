"""Best-fit packing of tokenized documents by bin completion with branch and bound."""

from __future__ import annotations

import bisect
import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, stash

#: Pieces of one length are numbered in parts of about this many, or of 1/20000 of all pieces where that is more.
PART, PARTS = 1000, 20_000
END = 0
#: Fillings that the search tries where the incumbent is above the lower bound; some seconds on the driver.
NODES = 1000
#: Nodes of the search whose choices are held.
KEPT = 16
#: ((length, copies), ...) of one sequence; with the number of sequences like it.
Filling = tuple[tuple[int, int], ...]
Pattern = tuple[Filling, int]


def extend_sums(sums: list[int], lengths: list[int], count: dict[int, int], capacity: int) -> None:
    """Append to ``sums`` what is missing: sums[i] has bit s set where pieces of the i shortest lengths can fill s."""
    whole = (1 << (capacity + 1)) - 1
    for x in lengths[len(sums) - 1 :]:
        reach, left, step = sums[-1], min(count[x], capacity // x), 1
        while left:  # copies in parts of 1, 2, 4, ... and the rest: every number of them is a sum of parts
            step = min(step, left)
            reach |= (reach << (step * x)) & whole
            left -= step
            step *= 2
        sums.append(reach)


def best_filling(capacity: int, lengths: list[int], count: dict[int, int], sums: list[int]) -> list[tuple[int, int]]:
    """(length, copies), longest first, that fill ``capacity`` best among all fillings with the longest length.

    ``lengths`` ascending, those with count > 0; ``sums`` as of extend_sums, for all lengths but the longest at least.
    Branches on the copies of one length, most first; the bound of a branch is the most that all shorter lengths can
    still fill. That bound is reached, not estimated, so a branch is entered only if it ends at the least waste.
    """
    n, top = len(lengths), lengths[-1]
    fills = []
    for m in range(1, min(count[top], capacity // top) + 1):
        room = capacity - m * top
        fills.append((m * top + (sums[n - 1] & ((1 << (room + 1)) - 1)).bit_length() - 1, m))
    full, m = max(fills)
    fill, rest = [(top, m)], full - m * top
    i = bisect.bisect_right(lengths, rest, 0, n - 1)
    while rest:
        i -= 1
        x = lengths[i]
        m = min(count[x], rest // x)
        while not sums[i] >> (rest - m * x) & 1:
            m -= 1
        if m:
            fill.append((x, m))
            rest -= m * x
    return fill


def greedy_bins(hist: dict[int, int], capacity: int) -> list[Pattern]:
    """The longest piece left opens a bin, its best filling completes it, and the pattern repeats as long as all its
    lengths last. Work and result are bounded by the number of distinct lengths and ``capacity``, not of pieces."""
    count = {x: n for x, n in hist.items() if n > 0}
    lengths, out = sorted(count), []
    sums = [1]
    while lengths:
        extend_sums(sums, lengths[:-1], count, capacity)
        fill = best_filling(capacity, lengths, count, sums)
        times = min(count[x] // m for x, m in fill)
        for x, m in fill:
            held = min(count[x], capacity // x)
            count[x] -= m * times
            at = bisect.bisect_left(lengths, x)
            if min(count[x], capacity // x) < held:
                del sums[at + 1 :]
            if not count[x]:
                lengths.pop(at)
        out.append((tuple(fill), times))
    return out


def best_fit_bins(hist: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit, longest first: a piece goes where the least room is left, equal bins together."""
    rooms: list[int] = []  # ascending, with the open bins of each
    held: dict[int, list[list]] = defaultdict(list)

    def put(pattern: tuple, room: int, times: int) -> None:
        if not held[room]:
            bisect.insort(rooms, room)
        held[room].append([pattern, times])

    for x in sorted((x for x, n in hist.items() if n > 0), reverse=True):
        n = hist[x]
        while n:
            at = bisect.bisect_left(rooms, x)
            room = rooms[at] if at < len(rooms) else capacity
            each = min(n, room // x)  # after the first piece this bin is the fullest that fits
            times = n // each
            pattern = ()
            if at < len(rooms):
                group = held[room][-1]
                pattern, times = group[0], min(times, group[1])
                group[1] -= times
                if not group[1]:
                    held[room].pop()
                    if not held[room]:
                        rooms.pop(at)
            put((*pattern, (x, each)), room - each * x, times)
            n -= each * times
    return [(pattern, times) for groups in held.values() for pattern, times in groups]


def least_bins(hist: dict[int, int], capacity: int) -> int:
    """A lower bound: for any a, pieces over capacity - a stand alone, others over half a bin each need a bin of their
    own, and what the room beside those cannot take of the pieces of a or more needs further bins."""
    n = np.zeros(capacity + 1, np.int64)
    for x, k in hist.items():
        n[x] += k
    many, size = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * np.arange(capacity + 1))])
    over = lambda a, lo, hi: int(a[hi + 1] - a[lo + 1])  # noqa: E731  lengths above lo, up to hi
    best = 0
    for a in range(capacity // 2 + 1):
        alone, half = over(many, capacity - a, capacity), over(many, capacity // 2, capacity - a)
        small = int(size[capacity // 2 + 1] - size[max(a, 0)])
        rest = small - (half * capacity - over(size, capacity // 2, capacity - a))
        best = max(best, alone + half + max(0, -(-rest // capacity)))
    return best


def undominated(capacity: int, lengths: list[int], count: dict[int, int], sums: list[int], most_waste) -> Iterator[Filling | None]:
    """Fillings around the longest length, least waste first, up to ``most_waste()``: exact sums by the reachable-sum
    bound. None stands for one where a piece left out could take the place of some that are in (it is dominated)."""
    top = lengths[-1]

    def exact(i: int, rest: int) -> Iterator[tuple]:
        """Ways to make ``rest`` of the i shortest lengths, long ones first."""
        if rest == 0:
            yield ()
            return
        while i and (sums[i] >> rest) & 1:
            x = lengths[i - 1]
            for m in range(min(count[x] - (x == top), rest // x), 0, -1):
                if (sums[i - 1] >> (rest - m * x)) & 1:
                    for tail in exact(i - 1, rest - m * x):
                        yield ((x, m), *tail)
            i -= 1

    room, waste = capacity - top, 0
    while waste <= min(room, most_waste()):
        for fill in exact(bisect.bisect_right(lengths, room - waste), room - waste):
            inside, reach = dict(fill), 1
            for x, m in fill:
                for _ in range(m):
                    reach |= reach << x
            worse = False
            if waste or len(fill) > 1 or any(m > 1 for _, m in fill):
                for y in lengths:
                    out_of = count[y] - inside.get(y, 0) - (y == top)
                    low = max(y - waste, 1)
                    hit = (reach >> low) & ((1 << (y - low + 1)) - 1) if out_of > 0 and y <= room else 0
                    if y in inside:  # a piece in place of its like changes nothing
                        hit &= ~(1 << (y - low))
                    if hit:
                        worse = True
                        break
            if worse:
                yield None
            else:
                yield ((top, inside.pop(top, 0) + 1), *((x, m) for x, m in fill if x != top))
        waste += 1


def complete_bins(hist: dict[int, int], capacity: int, nodes: int = NODES) -> list[Pattern]:
    """Pieces counted by length -> ((length, copies) of one sequence, how many sequences like it).

    Bin completion by depth-first branch and bound. Incumbents are greedy completion and best fit; the search ends as
    soon as the incumbent meets the lower bound. A node completes the bin of the longest piece left with an undominated
    filling (as often as it lasts, or once); a branch is cut where its waste would leave no better packing than the
    incumbent. ``nodes`` bounds the fillings tried (dominated ones included): it can leave a packing that is whole but not proven least, never one
    that misses a piece.
    """
    best = min(greedy_bins(hist, capacity), best_fit_bins(hist, capacity), key=bins)
    bound, total = least_bins(hist, capacity), sum(x * n for x, n in hist.items())
    count = {x: n for x, n in hist.items() if n > 0}
    path: list[Pattern] = []
    wasted = 0
    left = lambda: (bins(best) - 1) * capacity - total - wasted  # noqa: E731  waste that a better packing may still have

    def choices() -> Iterator[Pattern]:
        lengths, sums = sorted(x for x, n in count.items() if n), [1]
        extend_sums(sums, lengths, count, capacity)
        for fill in undominated(capacity, lengths, count, sums, left):
            if fill is None:
                yield (), 0
                continue
            most = min(count[x] // m for x, m in fill)
            yield from ((fill, n) for n in ((most, 1) if most > 1 else (1,)))

    # (choices, how many were taken): the sums of reachable fillings that a node's choices hold are some 500 KB, so only the
    # KEPT deepest nodes hold theirs; another makes them again when the search comes back to it, where ``count`` is as it was.
    open_nodes: list[tuple[Iterator[Pattern] | None, int]] = [(choices(), 0)]
    while open_nodes and nodes and bins(best) > bound:
        own, taken = open_nodes.pop()
        if own is None:
            own = itertools.islice(choices(), taken, None)
        step = next(own, None)
        open_nodes.append((own, taken + 1))
        if step is None:
            open_nodes.pop()
            if path:
                fill, n = path.pop()
                wasted -= n * (capacity - sum(x * m for x, m in fill))
                for x, m in fill:
                    count[x] += n * m
            continue
        nodes -= 1
        fill, n = step
        lost = n * (capacity - sum(x * m for x, m in fill))
        if not n or lost > left():
            continue
        path.append(step)
        wasted += lost
        for x, m in fill:
            count[x] -= n * m
        if any(count.values()):
            open_nodes.append((choices(), 0))
        else:
            best = list(path)
            open_nodes.append((iter(()), 0))
        if len(open_nodes) > KEPT:
            open_nodes[-KEPT - 1] = (None, open_nodes[-KEPT - 1][1])
    return best


def small_table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """Rows of whole numbers as a table, by Arrow: a list of tuples would go through Python workers of another daemon,
    which every executor then holds beside those of the tasks."""
    values = np.array(rows, np.int64).reshape(len(rows), len(names))
    return spark.createDataFrame(pa.table({x: pa.array(values[:, i]) for i, x in enumerate(names)}))


def bins(patterns: list[Pattern]) -> int:
    return sum(times for _, times in patterns)


def token_pieces(docs: DataFrame, capacity: int, id_col: str, text_col: str, vocabulary: str | None, ranks: str | None, keep_ids: bool) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): byte-level BPE ids with END, cut from the back into pieces of
    ``capacity``, so that only a document's first piece can be shorter."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.list_(pa.uint32()))] if keep_ids else []

    def cut(batches):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        # The same vocabulary in rank form gives the same ids in a quarter of the time.
        with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coder = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={"<|endoftext|>": 50256})

        def encode(text: str) -> np.ndarray | list[int]:
            try:
                return coder.encode_to_numpy(text, allowed_special="all")  # a quarter less time than a list
            except ValueError:  # a run of white space beyond its pattern's stack
                return Tokenizer.from_file(vocabulary or public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids

        for b in slices(batches):
            rows: list[list] = [[] for _ in fields]
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(encode(t) if t else [], END).astype("<u4")
                at, piece = 0, 0
                while at < len(ids):
                    n = (len(ids) - at) % capacity or capacity
                    part = ids[at : at + n]
                    for held, v in zip(rows, (d, piece, at, n, zlib.crc32(part.tobytes()), part if keep_ids else None), strict=False):
                        held.append(v)
                    at, piece = at + n, piece + 1
            yield pa.record_batch([pa.array(r, t) for r, (_, t) in zip(rows, fields, strict=True)], [n for n, _ in fields])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if keep_ids else "")
    if keep_ids:
        fields[-1] = ("ids", pa.list_(pa.int64()))
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(cut, schema)


def pack(docs: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, ranks: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Token sequences of at most ``capacity`` ids: one row per piece, with sequence_id and offset.

    ``vocabulary`` is the tokenizer's file, ``ranks`` the same vocabulary as ranks; both default to byte_bpe_50k.
    Piece lengths are at most ``capacity``, so their histogram is small whatever the corpus: it is counted on the
    executors, packed on the driver by complete_bins, and the patterns go back as a table by length. A piece finds
    its place from its number among the pieces of its length. A length of many pieces is numbered in parts, whose
    counts say where each begins, so no task numbers all pieces of a length; the driver holds a count for each
    length and at most 2 x PARTS for the parts.

    Defined cases: null and empty text are the single id END; null ids are packed as others; repeated rows are packed
    each; an empty table gives an empty result; extra columns are ignored. The text '<|endoftext|>' is one id, as in
    the tokenizer's own defaults.
    """
    spark = docs.sparkSession
    rows = stash(token_pieces(docs, capacity, id_col, text_col, vocabulary, ranks, keep_ids), "pieces")
    hist = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}  # at most ``capacity`` rows
    part = max(PART, sum(hist.values()) // PARTS)
    split = small_table(spark, [(x, -(-n // part)) for x, n in hist.items() if n > part], ["length", "parts"])
    bucket = F.coalesce(F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("parts")), F.lit(0)).cast("int")
    rows = rows.join(F.broadcast(split), "length", "left").withColumn("bucket", bucket).drop("parts")
    first, seen = [], dict.fromkeys(hist, 0)
    for x, b, n in sorted(tuple(r) for r in rows.where(F.col("length").isin([r for r, n in hist.items() if n > part])).groupBy("length", "bucket").count().collect()):
        first.append((x, b, seen[x]))
        seen[x] += n
    table: dict[int, list[tuple]] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    sequence = 0
    for fill, times in complete_bins(dict(hist), capacity):
        offset = 0
        for x, m in fill:
            table[x].append((taken[x], m, sequence, offset))
            taken[x] += m * times
            offset += m * x
        sequence += times
    places = {x: np.array(v, np.int64) for x, v in table.items()}

    def place(batches):
        for b in batches:
            n, at = b.column("length").to_numpy(), b.column("at").to_numpy()
            seq, off = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
            for x in np.unique(n):
                own = np.flatnonzero(n == x)
                start, m, s, o = places[int(x)][np.searchsorted(places[int(x)][:, 0], at[own], "right") - 1].T
                k = at[own] - start
                seq[own], off[own] = s + k // m, o + (k % m) * x
            keep = [c for c in b.schema.names if c != "at"]
            yield pa.record_batch([b.column(c) for c in keep] + [pa.array(seq), pa.array(off)], [*keep, "sequence_id", "offset"])

    starts = small_table(spark, first, ["length", "bucket", "first"]).withColumn("bucket", F.col("bucket").cast("int"))  # of the split lengths: at most 2 x PARTS rows
    w = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    numbered = (
        rows.withColumn("k", F.row_number().over(w)).join(F.broadcast(starts), ["length", "bucket"], "left").withColumn("at", F.coalesce("first", F.lit(0)) + F.col("k") - 1)
        .select("doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else []), "at")
    )
    ids = ", ids array<long>" if keep_ids else ""
    return numbered.mapInArrow(place, f"doc_id long, piece int, start long, length long, ids_crc32 long{ids}, sequence_id long, offset long")


def op6_bin_completion_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
