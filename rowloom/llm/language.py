"""Language identification by prediction by partial matching over bytes."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

#: Documents a language is learned from, about (taken by a hash of the id).
SAMPLE = 600
SLOTS = 20
#: Bytes scored at a time.
PART = 100_000
_LETTER = re.compile(r"[^\W\d_]")


class ContextTrees:
    """Frozen byte context trees of order 3 for several languages.

    Escape method C: with N symbols seen in a context, D of them distinct, a seen symbol costs
    -log2(n / (N + D)) bits, any other an escape of -log2(D / (N + D)) bits and then what it costs in the next shorter
    context; below order 0 every byte costs 8 bits. An unseen context costs nothing to leave. The cost of every
    (context, symbol) seen in any language is worked out for all of them beforehand.
    """

    def __init__(self, grams: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(grams)
        count = len(self.langs)
        keys = {4: np.unique(np.concatenate([grams[x][0] for x in self.langs]).astype(np.uint32))}
        low = {}
        for x in self.langs:
            g, n = grams[x]
            low[x, 4] = (g.astype(np.uint32), n.astype(np.int64))
            for k in (3, 2, 1):
                u, inv = np.unique(g & np.uint32((1 << 8 * k) - 1), return_inverse=True)
                low[x, k] = (u.astype(np.uint32), np.bincount(inv, n).astype(np.int64))
        keys[3] = np.unique(np.concatenate([low[x, 3][0] for x in self.langs] + [keys[4] >> np.uint32(8)]))
        keys[2], keys[1] = np.arange(1 << 16, dtype=np.uint32), np.arange(1 << 8, dtype=np.uint32)
        self.keys, self.cost, self.escape = keys, {}, {}
        for k in (1, 2, 3, 4):
            u = keys[k]
            cost, leave = np.zeros((len(u), count), np.float32), np.zeros((len(keys.get(k - 1, [0])), count), np.float32)
            short = np.full((len(u), count), 8.0) if k == 1 else self.cost[k - 1][self._at(k - 1, u & np.uint32((1 << 8 * (k - 1)) - 1))]
            for i, x in enumerate(self.langs):
                g, n = low[x, k]
                ctx = (g >> np.uint32(8)) if k > 1 else np.zeros(len(g), np.uint32)
                c, inv = np.unique(ctx, return_inverse=True)
                total, kinds = np.bincount(inv, n), np.bincount(inv)
                place = self._at(k - 1, c) if k > 1 else np.zeros(len(c), np.int64)
                leave[place, i] = -np.log2(kinds / (total + kinds))
                cost[:, i] = short[:, i] + leave[self._at(k - 1, u >> np.uint32(8)) if k > 1 else 0, i]
                cost[np.searchsorted(u, g), i] = -np.log2(n / (total + kinds)[inv])
            self.cost[k], self.escape[k] = cost, leave
        # Hashed positions of the order-3 keys, frequent ones last so that they win a shared slot.
        weight = np.zeros(len(keys[4]), np.int64)
        for x in self.langs:
            weight[np.searchsorted(keys[4], low[x, 4][0])] += low[x, 4][1]
        order = np.argsort(weight, kind="stable")
        self.slots = np.zeros(1 << SLOTS, np.int32)
        self.slots[self._slot(keys[4][order])] = order

    @staticmethod
    def _slot(g: np.ndarray) -> np.ndarray:
        return (g * np.uint32(2654435761)) >> np.uint32(32 - SLOTS)

    def _at(self, k: int, g: np.ndarray) -> np.ndarray:
        """Places of keys of k bytes; only for keys known to be there."""
        return g.astype(np.int64) if k <= 2 else np.searchsorted(self.keys[k], g)

    def bits(self, parts: list[bytes]) -> np.ndarray:
        """Code length of each part under each language; its first three bytes are context only, so a part of up to
        three bytes costs nothing."""
        total = np.zeros((len(parts), len(self.langs)))
        some = np.array([i for i, t in enumerate(parts) if len(t) > 3], np.int64)
        if not len(some):
            return total
        raw = np.frombuffer(b"".join(parts[i] for i in some), np.uint8).astype(np.uint32)
        g = (raw[:-3] << np.uint32(24)) | (raw[1:-2] << np.uint32(16)) | (raw[2:-1] << np.uint32(8)) | raw[3:]
        at = self.slots[self._slot(g)]
        cost = self.cost[4][at]
        miss = np.flatnonzero(self.keys[4][at] != g)
        if len(miss):
            m = g[miss]
            at = np.minimum(np.searchsorted(self.keys[4], m), len(self.keys[4]) - 1)
            cost[miss] = self.cost[4][at]
            bad = self.keys[4][at] != m
            miss, m = miss[bad], m[bad]
            cost[miss] = self._shorter(m)
        length = np.array([len(parts[i]) - 3 for i in some])
        start = np.cumsum(length + 3) - length - 3
        bounds = np.stack([start, start + length], 1).ravel()
        total[some] = np.add.reduceat(np.vstack([cost, np.zeros((1, cost.shape[1]), cost.dtype)]).astype(np.float64), bounds)[::2]
        return total

    def _shorter(self, m: np.ndarray) -> np.ndarray:
        """Costs where no language has seen the four bytes: leave the order-3 context, then order 2 and so on."""
        k3, first, last = self.keys[3], m >> np.uint32(8), m & np.uint32(0xFFFFFF)
        out = np.zeros((len(m), len(self.langs)), np.float32)
        a = np.minimum(np.searchsorted(k3, first), len(k3) - 1)
        known = k3[a] == first
        out[known] += self.escape[4][a[known]]
        a = np.minimum(np.searchsorted(k3, last), len(k3) - 1)
        known = k3[a] == last
        out[known] += self.cost[3][a[known]]
        r = ~known
        out[r] += self.escape[3][(last[r] >> np.uint32(8)).astype(np.int64)] + self.cost[2][(last[r] & np.uint32(0xFFFF)).astype(np.int64)]
        return out


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2. A null id counts as learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> ContextTrees | None:
    """Trees from about ``sample`` whole documents per language that are not held out; None without any.

    Documents are taken by a hash of their id and text, so the choice does not depend on partitioning. All four-byte
    sequences of the sample are kept: their counts are summed on the executors and come to the driver as arrays, 12
    bytes for each distinct sequence of a language, so their number is bounded by the sample.
    """
    labelled = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & (F.length("text") > 0))
    # One row per label; the driver holds far more of each label in the end, so the rows are broadcast.
    many = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.greatest(F.lit(1), F.floor(F.least(F.lit(1.0), F.lit(float(sample)) / F.col("n")) * (1 << 20)))
    take = (F.col("n") <= sample) | (F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), "text"), F.lit(1 << 20)) < share)

    def count(batches):
        for b in slices(batches):
            by: dict[str, list[bytes]] = {}
            for x, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(x, []).append(b"   " + t.lower().encode())
            for x, texts in by.items():
                g = np.concatenate([_grams(t) for t in texts])
                u, n = np.unique(g, return_counts=True)
                yield pa.record_batch([pa.array([x] * len(u)), pa.array(u.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "g", "n"])

    counts = labelled.join(F.broadcast(many), "lang").where(take).select("lang", "text").mapInArrow(count, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))
    seen = counts.toArrow().to_pandas(strings_to_categorical=True)
    if not len(seen):
        return None
    return ContextTrees({str(x): (p["g"].to_numpy().astype(np.uint32), p["n"].to_numpy()) for x, p in seen.sort_values("g").groupby("lang", observed=True)})


def _grams(t: bytes) -> np.ndarray:
    raw = np.frombuffer(t, np.uint8).astype(np.uint32)
    return (raw[:-3] << np.uint32(24)) | (raw[1:-2] << np.uint32(16)) | (raw[2:-1] << np.uint32(8)) | raw[3:]


def identify(docs: DataFrame, model: ContextTrees | None, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """The input's columns with ``lang_col`` and ``score_col`` (both replaced if there).

    The language of least code length over the whole lower-cased text; score is its share under equal priors,
    1 / sum(2 ** -(bits - least bits)). Ties go to the first name. ``und`` with score 0 for null text, text without
    letters, or without a model. Null ids, repeated rows and extra columns come back as they are; an empty table
    gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))
    keep = [c for c in docs.columns if c not in (lang_col, score_col)]
    df = docs.select(*[F.col(f"`{c}`") for c in keep])
    at = keep.index(text_col)

    def judge(batches):
        trees = cloudpickle.loads(shared.value)
        for b in slices(batches):
            texts = b.column(at).to_pylist()
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            todo = [i for i, t in enumerate(texts) if trees is not None and t and _LETTER.search(t)]
            bits = np.zeros((len(texts), len(trees.langs) if trees else 1))
            parts, owner, size = [], [], 0
            for i in todo:
                t = b"   " + texts[i].lower().encode()  # a text starts after three spaces
                for at_byte in range(0, len(t) - 3, PART):
                    parts.append(t[at_byte : at_byte + PART + 3])
                    owner.append(i)
                    size += len(parts[-1])
                    if size >= PART:
                        np.add.at(bits, owner, trees.bits(parts))
                        parts, owner, size = [], [], 0
            if parts:
                np.add.at(bits, owner, trees.bits(parts))
            for i in todo:
                lang[i] = trees.langs[int(bits[i].argmin())]
                score[i] = float(1 / np.exp2(-np.minimum(bits[i] - bits[i].min(), 1000)).sum())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*keep, lang_col, score_col])

    return df.mapInArrow(judge, T.StructType([*df.schema.fields, T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())]))


def op8_ppm_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
