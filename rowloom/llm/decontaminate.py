"""Benchmark passages in documents: SimHash windows, multi-index Hamming search, exact verification."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordCodes, gram_codes, slices

SHINGLE, SIMILARITY = 5, 0.8
#: Fingerprints of 64 bits in 8 blocks: two that differ in at most 23 bits differ in at most 2 bits of some block.
RADIUS, BLOCKS, NEAR = 23, 8, 2
#: Bytes of a benchmark's index that a task holds at a time, about; a larger benchmark takes several passes. An item takes
#: 4 bytes in each of 8 x 37 lists, and its shingles' tables some 50 bytes a character.
PASS_BYTES, ITEM_BYTES, CHAR_BYTES = 128 << 20, 1200, 50
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_BITS = np.arange(64, dtype=np.uint64)
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def plain_words(text: str | None) -> list[bytes]:
    """Words of letters and digits; A-Z lower-cased, other ASCII characters as spaces."""
    return text.encode().translate(_PLAIN).split() if text else []


def _signs(grams: np.ndarray) -> np.ndarray:
    return (((grams[:, None] >> _BITS) & np.uint64(1)).astype(np.int8) * 2 - 1).astype(np.int32)


def fingerprint(grams: np.ndarray) -> np.uint64:
    """SimHash of a shingle multiset: a shingle weighs as often as it occurs."""
    return _pack(_signs(grams).sum(0)[None])[0]


def _pack(sums: np.ndarray) -> np.ndarray:
    return ((sums > 0).astype(np.uint64) << _BITS).sum(1, dtype=np.uint64)


class HammingIndex:
    """Multi-index hashing: one table per 8-bit block, keyed by every value within NEAR bits of an entry's block.
    Every entry within RADIUS of a query meets it in some table; all met ones are compared in full."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        near = _POP[np.arange(256)[:, None] ^ np.arange(256)[None, :]] <= NEAR
        parts = self._parts(prints)
        self.tables = []  # by block: entries in the order of the values they are near to, and where each value's begin
        for b in range(BLOCKS):
            value, entry = np.nonzero(near[:, parts[:, b]])
            self.tables.append((entry.astype(np.int32), np.searchsorted(value, np.arange(257))))

    @staticmethod
    def _parts(p: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(p).view(np.uint8).reshape(-1, BLOCKS)

    def search(self, p: np.uint64) -> np.ndarray:
        values = self._parts(np.array([p], np.uint64))[0]
        met = np.unique(np.concatenate([entry[at[v] : at[v + 1]] for (entry, at), v in zip(self.tables, values.tolist(), strict=True)]))
        return met[_POP[self._parts(self.prints[met] ^ p)].sum(1) <= RADIUS] if len(met) else met


class Benchmark:
    """Items grouped by length in words; one Hamming index per length, and a table of all their shingles."""

    def __init__(self, items: list[tuple[int, str]]):
        codes, self.ids, self.grams, self.groups, by = WordCodes(), [], [], {}, defaultdict(list)
        self.owners: dict[int, dict[int, set]] = defaultdict(lambda: defaultdict(set))
        for i, text in items:
            w = plain_words(text)
            if w and i is not None:
                k = min(SHINGLE, len(w))
                g = gram_codes(codes.codes(w), k)
                by[len(w)].append((len(self.ids), fingerprint(g)))
                self.ids.append(i)
                self.grams.append(Counter(g.tolist()))
                for x in g.tolist():
                    self.owners[k][x].add(len(w))
        self.owners = {k: dict(v) for k, v in self.owners.items()}
        for n, entries in by.items():
            self.groups[n] = ([i for i, _ in entries], HammingIndex(np.array([p for _, p in entries], np.uint64)))
        self.filters = {}
        for k, held in self.owners.items():
            f = np.zeros(1 << 20, bool)
            f[np.fromiter(held, np.uint64, len(held)) & np.uint64((1 << 20) - 1)] = True
            self.filters[k] = f

    def leaks(self, text: str | None, codes: WordCodes) -> list[tuple[int, int, int, float]]:
        """(item id, first word, words, similarity) of the best window for each id met with SIMILARITY or more; of equal
        ones the first."""
        words = plain_words(text)
        best: dict[int, tuple] = {}
        if not words:
            return []
        c = codes.codes(words)
        for k, held in self.owners.items():
            g = gram_codes(c, k)
            hits = np.flatnonzero(self.filters[k][g & np.uint64((1 << 20) - 1)]) if len(g) else []
            at: dict[int, list[int]] = defaultdict(list)
            for p in hits:  # a window without any shingle of an item has similarity 0 with all of them
                for n in held.get(int(g[p]), ()):
                    at[n].append(int(p))
            for n, places in at.items():
                span = min(n, len(words)) - k + 1  # shingles in a window
                if span < 1:
                    continue
                last = len(g) - span
                mark = np.zeros(last + 2, np.int64)
                lo, hi = np.maximum(np.array(places) - span + 1, 0), np.minimum(np.array(places), last) + 1
                np.add.at(mark, lo, 1)
                np.add.at(mark, hi, -1)
                starts = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
                for part in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
                    for run in np.array_split(part, -(-len(part) // 4096)):
                        a, b = int(run[0]), int(run[-1])
                        sums = np.vstack([np.zeros((1, 64), np.int64), np.cumsum(_signs(g[a : b + span]), 0)])
                        prints = _pack(sums[span:] - sums[: len(sums) - span])
                        entries, index = self.groups[n]
                        for s, p in zip(range(a, b + 1), prints, strict=True):
                            for j in index.search(p):
                                item, window = self.grams[entries[j]], Counter(g[s : s + span].tolist())
                                both = sum((item & window).values())
                                sim = both / (sum(item.values()) + span - both)
                                i, found = self.ids[entries[j]], (s, min(n, len(words)), sim)
                                if sim >= SIMILARITY and (i not in best or (-sim, s) < (-best[i][2], best[i][0])):
                                    best[i] = found
        return [(i, *best[i]) for i in sorted(best)]


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", out_col: str = "leaks") -> DataFrame:
    """The input's columns with leaks (``out_col``): array<struct<item_id, start, n_words, similarity>>.

    A window of as many words as an item (or the whole document, if shorter) is compared when it shares a shingle
    with an item of that length: its SimHash goes through the multi-index search, and what is within RADIUS bits is
    verified by exact weighted Jaccard (shingle counts, five words, SIMILARITY or more). Items with fewer than five
    words are one shingle. The benchmark is a stated query set: it is read in passes of about PASS_BYTES of index (or
    one item); the driver holds one pass, builds its index once, and each pass maps over the documents without a shuffle.

    Defined cases: null or empty texts have no leaks and null or empty items match nothing; null item ids are left
    out; null document ids, repeated rows and extra columns come back as they are (a column named ``out_col`` is
    replaced); items that repeat an id report once, with the best window of any of them.
    """
    spark = docs.sparkSession
    kind = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("similarity", T.DoubleType())]))
    arrow = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("n_words", pa.int64()), ("similarity", pa.float64())]))
    df = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != out_col]).withColumn(out_col, F.array().cast(kind))

    def one_pass(df: DataFrame, items: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(cloudpickle.dumps(Benchmark(items)))

        def scan(batches):
            bench, codes = cloudpickle.loads(shared.value), WordCodes()
            for b in slices(batches):
                t, n = b.schema.get_field_index(text_col), b.num_columns
                new = []
                for text, old in zip(b.column(t).to_pylist(), b.column(n - 1).to_pylist(), strict=True):
                    best = {x["item_id"]: x for x in old or []}
                    for found in bench.leaks(text, codes):
                        x = dict(zip(("item_id", "start", "n_words", "similarity"), found, strict=True))
                        if x["item_id"] not in best or x["similarity"] > best[x["item_id"]]["similarity"]:
                            best[x["item_id"]] = x
                    new.append([best[i] for i in sorted(best)])
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(new, arrow)], names=b.schema.names)

        return df.mapInArrow(scan, df.schema)

    items, size = [], 0
    for r in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        items.append((r[0], r[1]))
        size += ITEM_BYTES + CHAR_BYTES * len(r[1] or "")
        if size > PASS_BYTES:
            df, items, size = one_pass(df, items), [], 0
    return one_pass(df, items) if items else df


def op3_simhash_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.*")
