"""Removal of repeated word windows with a compressed FM-index per shard."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordCodes, binary_column, gram_codes, keyed_join, map_arrow, slices, stash

#: Words of the runs by which windows are routed, level by level; an anchor is the window's run of least code.
RUNS = (6, 12)
#: An anchor with more distinct passages than this is routed again by longer runs instead of going to one index.
HOT = 2000
#: Distinct passages per index, on average.
SHARD = 4000
#: Every how many words the index keeps a place.
SAMPLED = 16


class BitPlane:
    """Bits, 64 to a word, with the number of ones before each word: 1.5 bits for each bit."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    """Symbols below 2**bits as one bit plane per level, with rank over vectors of positions."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.levels = []
        for b in range(bits - 1, -1, -1):
            ones = ((seq >> b) & 1).astype(bool)
            self.levels.append((b, BitPlane(ones), len(seq) - int(np.count_nonzero(ones))))
            seq = np.concatenate([seq[~ones], seq[ones]])
        every = np.arange(1 << bits)
        self.start = self._down(every, np.zeros(len(every), np.int64)).astype(np.int32)

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for b, plane, zeros in self.levels:
            n = plane.rank(at).astype(np.int64)
            at = np.where((symbol >> b) & 1, zeros + n, at - n)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        return self._down(symbol, at) - self.start[symbol]

    def get(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and its occurrences before."""
        symbol = np.zeros(len(at), np.int64)
        for b, plane, zeros in self.levels:
            one, n = plane.get(at).astype(np.int64), plane.rank(at).astype(np.int64)
            symbol |= one << b
            at = np.where(one == 1, zeros + n, at - n)
        return symbol, at - self.start[symbol]


class FMIndex:
    """Compressed FM-index of word sequences: BWT in a wavelet matrix, and every SAMPLED-th place of the text.

    With V distinct words it holds about 1.5 log2 V + 3.5 bits a word (some 3 bytes at 4000 passages), and 4 bytes for
    each distinct word; neither text nor suffix array stay. Sequences end in a symbol of their own, so no match runs
    across two.
    """

    def __init__(self, seqs: list[np.ndarray]):
        text = np.concatenate([*(np.append(s + 2, 1) for s in seqs), [0]]).astype(np.int64)
        n = self.n = len(text)
        rank, step = text.copy(), 1
        while True:  # prefix doubling until all suffixes differ
            nxt = np.zeros(n, np.int64)
            nxt[: n - step] = rank[step:] + 1
            key = rank * (int(nxt.max()) + 1) + nxt
            order = np.argsort(key, kind="stable")
            fresh = np.ones(n, np.int64)
            fresh[1:] = np.diff(key[order]) != 0
            rank[order] = np.cumsum(fresh) - 1
            step *= 2
            if rank[order[-1]] == n - 1:
                break
        self.bwt = WaveletMatrix(text[order - 1], max(1, int(text.max()).bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=int(text.max()) + 2))]).astype(np.int32)
        kept = order % SAMPLED == 0
        self.kept, self.places = BitPlane(kept), order[kept].astype(np.int32)

    def matching(self, stream: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of a streamed text at ``ends``: how many words before each end, up to ``most``, are found
        at two places or more, and their suffix interval. Backward search for all ends at once; a match that has one
        place left is not extended further."""
        lo, hi, length = np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64), np.zeros(len(ends), np.int64)
        live = np.arange(len(ends))
        for k in range(most):
            s = stream[ends[live] - 1 - k]
            a, b = self.before[s] + self.bwt.rank(s, lo[live]), self.before[s] + self.bwt.rank(s, hi[live])
            two = b - a > 1
            live = live[two]
            if not len(live):
                break
            lo[live], hi[live] = a[two], b[two]
            length[live] += 1
        return length, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of BWT rows: steps back to the next kept one."""
        out, at, live = np.zeros(len(rows), np.int64), rows.astype(np.int64), np.arange(len(rows))
        for back in range(SAMPLED):
            held = self.kept.get(at[live]) == 1
            done = live[held]
            out[done] = self.places[self.kept.rank(at[done])] + back
            live = live[~held]
            if not len(live):
                break
            symbol, before = self.bwt.get(at[live])
            at[live] = self.before[symbol] + before
        return out


_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def anchors(codes: np.ndarray, doc: np.ndarray, width: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive windows of one document with one anchor position, over the word codes of several documents; an
    anchor has ``run`` words.

    Returns (first window, end window, code of the anchor run, code of all words of the passage). ``doc`` gives each
    word's document; windows across two documents are left out.
    """
    z = np.empty(0, np.int64)
    if len(codes) < width:
        return z, z, z.astype(np.uint64), z.astype(np.uint64)
    least = gram_codes(codes, run)
    span = width - run + 1  # runs in a window
    pos, have = np.arange(len(least), dtype=np.int32), 1
    while have < span:
        by = min(have, span - have)
        right = least[by:] < least[: len(least) - by]  # of equal codes the left one counts
        pos = np.where(right, pos[by:], pos[: len(pos) - by])
        least = np.minimum(least[by:], least[: len(least) - by])
        have += by
    whole = doc[: len(least)] == doc[width - 1 :]
    new = np.ones(len(least), bool)
    new[1:] = (np.diff(pos) != 0) | (np.diff(doc[: len(least)]) != 0) | ~whole[:-1]
    start = np.flatnonzero(new & whole)
    edge = np.flatnonzero(np.append(new | ~whole, True))
    end = edge[np.searchsorted(edge, start, "right")]
    power = np.full(len(codes) + 1, 1, np.uint64)
    power[1:] = _BASE
    np.multiply.accumulate(power, out=power)
    back = np.full(len(codes), _BACK, np.uint64)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * back, dtype=np.uint64)])
    return start, end, least[start], (total[end + width - 1] - total[start]) * power[start] + (end - start).astype(np.uint64)


def _first_seen(width: int):
    none = pd.DataFrame({"doc_id": [], "th": [], "lo": [], "hi": []}).astype({"doc_id": "int64", "th": "int32", "lo": "int64", "hi": "int64"})

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        """Distinct passages of one shard. Out: word intervals of each passage's first occurrence that start earlier elsewhere."""
        vocab: dict[bytes, int] = {}
        seqs = [np.array([vocab.setdefault(w, len(vocab)) for w in p.split(b" ")], np.int64) for p in pdf["passage"]]
        index = FMIndex(seqs)
        # The shard's passages, each of which stands for all its copies, are streamed against the index.
        length = np.array([len(s) for s in seqs])
        head = np.concatenate([[0], np.cumsum(length + 1)[:-1]])
        many = length - width + 1
        own = np.repeat(np.arange(len(seqs)), many)
        off = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        matched, lo, hi = index.matching(np.concatenate([np.append(s + 2, 1) for s in seqs]), head[own] + off + width, width)
        twice = np.flatnonzero(matched == width)
        if not len(twice):
            return none
        # Intervals of equal length are equal or apart, so all their rows together are at most the text's words.
        rows, where = np.unique(lo[twice], return_inverse=True)
        size = np.zeros(len(rows), np.int64)
        size[where] = hi[twice] - rows[where]
        first_row = np.cumsum(size) - size
        found = index.locate(np.repeat(rows - first_row, size) + np.arange(size.sum()))
        seq = np.searchsorted(head, found, "right") - 1
        doc, start = pdf["doc_id"].to_numpy(), pdf["start"].to_numpy()
        d, s = np.concatenate([doc[seq], doc[own[twice]]]), np.concatenate([start[seq] + found - head[seq], (start[own] + off)[twice]])
        place = np.lexsort((s, d))
        age = np.empty(len(d), np.int64)  # equal for the same place in the same document
        age[place] = np.concatenate([[0], np.cumsum((np.diff(d[place]) != 0) | (np.diff(s[place]) != 0))])
        least = np.minimum.reduceat(age[: len(found)], first_row)
        late = twice[age[len(found) :] > least[where]]
        if not len(late):
            return none
        brk = np.flatnonzero((np.diff(own[late]) != 0) | (np.diff(off[late]) != 1)) + 1
        a, b = late[np.concatenate([[0], brk])], late[np.concatenate([brk - 1, [len(late) - 1]])]
        return pd.DataFrame({"doc_id": doc[own[a]], "th": pdf["th"].to_numpy()[own[a]], "lo": start[own[a]] + off[a], "hi": start[own[b]] + off[b] + width})

    return shard


def routed(found: DataFrame, width: int, *carried: str) -> tuple[DataFrame, DataFrame]:
    """(first, copies) of passages (anchor, passage, doc_id, th, start, stop): the first occurrence of each passage whose
    anchor occurs again, with ``carried``; and the word intervals of all later occurrences, which go whole."""
    total = found.count()
    again = stash(found.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1"), "anchors")
    again = stash(keyed_join(found, again, ["anchor"], total).drop("c"), "again")
    total = again.count()
    first = again.groupBy("anchor", "passage").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "start", "th", "stop", *carried)).alias("f"))
    first = stash(first.select("anchor", "passage", "c", "f.*"), "first")
    later = first.where("c > 1").select("anchor", "passage", "c", F.struct("doc_id", "start").alias("f"))
    copies = keyed_join(again.drop(*carried), later, ["anchor", "passage"], total).where(F.struct("doc_id", "start") > F.col("f"))
    return first.drop("c"), copies.select("doc_id", "th", F.col("start").cast("long").alias("lo"), (F.col("stop") + width - 1).cast("long").alias("hi"))


def dedup_substrings(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every word covered by a window of ``width`` words whose sequence also starts earlier.

    Earlier: smaller doc_id, or same document and earlier start; windows are judged on the input. Returns doc_id,
    n_words, n_removed, kept_sha256, kept (the text that is left, words joined by one space).

    1. A window is routed by its anchor, the leftmost run of RUNS[0] words of least code in it, so equal windows share
       a route. Consecutive windows with one anchor form a passage, which holds no window twice. Anchors that occur
       once are dropped.
    2. Equal passages (by a 64-bit code of all their words) have the same matches, so one of them is streamed for all:
       they collapse in a grouped minimum, and all but the first occurrence go whole.
    3. Distinct passages meet in shards of anchors. A shard builds a compressed FM-index and streams its passages
       against it: backward search gives their matching statistics, and windows that match an earlier place are reported.
    4. The passages of an anchor with more than HOT distinct ones are routed again, by runs of the next length of RUNS
       and at last of ``width`` words (there equal anchors are equal windows), so no index grows with a common phrase.
    5. Intervals go back to their documents.

    Defined cases: null or empty text has no words and an empty kept text; null ids keep all their words; rows that
    repeat an id with equal text share their places, so neither is earlier; with other text they are told apart by a
    32-bit text hash, and the places of both count. Extra columns are ignored; an empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.hash(F.col(text_col)).alias("th"))
    runs = [*(r for r in RUNS if r < width), width]

    def find(batches):
        codes = WordCodes()
        for b in slices(batches):
            ids, hashes, texts = b.column(0), b.column(2), binary_column(b, "text")
            at = 0
            while at < len(texts):
                many, size, held = [], 0, at
                while at < len(texts) and size < 100_000:
                    many.append(codes.codes(texts[at].split()))
                    size += len(many[-1])
                    at += 1
                length = np.array([len(c) for c in many])
                begin = np.cumsum(length) - length
                doc = np.repeat(np.arange(len(many)), length)
                lo, hi, anchor, passage = anchors(np.concatenate(many), doc, width, runs[0])
                own = doc[lo]
                take = pa.array(held + own)
                yield pa.record_batch(
                    [pa.array((anchor >> np.uint64(24)).astype(np.int64)), pa.array(passage.view(np.int64)), ids.take(take), hashes.take(take), pa.array((lo - begin[own]).astype(np.int32)), pa.array((hi - begin[own]).astype(np.int32))],
                    ["anchor", "passage", "doc_id", "th", "start", "stop"],
                )

    found = stash(base.where("doc_id IS NOT NULL AND length(text) > 0").mapInArrow(find, "anchor long, passage long, doc_id long, th int, start int, stop int"), "runs")
    first, copies = routed(found, width)
    gone = [copies]

    def pack(batch):
        z = zstandard.ZstdCompressor(level=1)
        return pa.record_batch([batch.column(0), batch.column(2), pa.array([None if t is None else z.compress(t) for t in binary_column(batch, "text")], pa.binary())], ["doc_id", "th", "z"])

    packed = map_arrow(base, pack, "doc_id long, th int, z binary")

    def cut(batch):
        un = zstandard.ZstdDecompressor()
        out: list[list] = [[] for _ in names]
        for d, th, z, spots in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            words = un.decompress(z).split()
            for s in spots:
                for held, v in zip(out, (s["shard"], b" ".join(words[s["start"] : s["stop"] + width - 1]), d, th, s["start"]), strict=True):
                    held.append(v)
            if len(out[0]) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=names)
                out = [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=names)

    names, kinds = ["shard", "passage", "doc_id", "th", "start"], [pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int64()]
    def shards_of(first: DataFrame) -> DataFrame:
        """``first`` with its shard: -1 for anchors that are routed again; anchors with one passage are left out."""
        load = first.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1")
        many = max(1, -(-first.count() // SHARD))
        shard = F.when(F.col("c") > HOT, -1).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(many))).cast("int")
        return keyed_join(first, load, ["anchor"], first.count()).withColumn("shard", shard)

    spots = shards_of(first).groupBy("doc_id", "th").agg(F.collect_list(F.struct("shard", "start", "stop")).alias("spots"))
    distinct = stash(map_arrow(packed.join(spots, ["doc_id", "th"]).select("doc_id", "th", "z", "spots"), cut, "shard int, passage binary, doc_id long, th int, start long"), "passages")
    out = "doc_id long, th int, lo long, hi long"
    gone.append(distinct.where("shard >= 0").groupBy("shard").applyInPandas(_first_seen(width), out))

    def again_by(run: int):
        codes = WordCodes()

        def each(batch):
            rows: list[list] = [[] for _ in range(7)]
            for text, d, th, start in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                words = text.split(b" ")
                lo, hi, anchor, passage = anchors(codes.codes(words), np.zeros(len(words), np.int64), width, run)
                for a, z, k, c in zip(lo.tolist(), hi.tolist(), anchor.view(np.int64).tolist(), passage.view(np.int64).tolist(), strict=True):
                    for held, v in zip(rows, (k, c, d, th, start + a, start + z, b" ".join(words[a : z + width - 1])), strict=True):
                        held.append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.record_batch([pa.array(v, t) for v, t in zip(rows, types, strict=True)], ["anchor", "passage", "doc_id", "th", "start", "stop", "words"])

        return each

    for run in runs[1:]:
        hot = distinct.where("shard < 0").select("passage", "doc_id", "th", "start")
        if hot.isEmpty():
            break
        found = stash(map_arrow(hot, again_by(run), "anchor long, passage long, doc_id long, th int, start long, stop long, words binary"), "runs")
        first, copies = routed(found, width, "words")
        gone.append(copies)
        if run < width:
            distinct = stash(shards_of(first).select("shard", F.col("words").alias("passage"), "doc_id", "th", "start"), "passages")
            gone.append(distinct.where("shard >= 0").groupBy("shard").applyInPandas(_first_seen(width), out))
    gone = stash(reduce(DataFrame.unionByName, gone).groupBy("doc_id", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("gone")), "gone")

    def keep(batch):
        un = zstandard.ZstdDecompressor()
        n, removed, digest, kept = [], [], [], []
        for z, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = un.decompress(z).split() if z is not None else []
            n.append(len(words))
            if gone:
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, [g["lo"] for g in gone], 1)
                np.add.at(edge, [g["hi"] for g in gone], -1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
            text = b" ".join(words)
            removed.append(n[-1] - len(words))
            digest.append(hashlib.sha256(text).hexdigest())
            kept.append(text.decode())
        return pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return map_arrow(packed.join(gone, ["doc_id", "th"], "left").select("doc_id", "z", "gone"), keep, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def op5_fm_index_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")


OP5_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i+19], ' ') AS g FROM d, unnest(range(1, len(ws) - 18)) AS r(i)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM w),
x AS (SELECT DISTINCT doc_id, i + j AS p FROM f, unnest(range(0, 20)) AS q(j) WHERE k > 1),
k AS (SELECT d.doc_id, u.p, d.ws[u.p] AS word FROM d, unnest(range(1, len(d.ws) + 1)) AS u(p)),
t AS (SELECT k.doc_id, string_agg(k.word, ' ' ORDER BY k.p) AS kept, count(*) AS n FROM k ANTI JOIN x ON k.doc_id = x.doc_id AND k.p = x.p GROUP BY 1)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(len(d.ws) - coalesce(t.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256
FROM d LEFT JOIN t ON t.doc_id = d.doc_id
"""
