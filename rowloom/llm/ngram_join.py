"""N-gram Jaccard join with a prefix tree over globally ordered shingle sets."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordCodes, binary_column, discard, fmix, gram_codes, map_arrow, relieve, stash
from .components import components

#: A key shared by more sets than this is looked at in whole sets, and what they still share so often is joined in blocks.
HOT = 128
#: Sets in one block of a cluster, and codes (8 bytes each): a block task holds two blocks.
BLOCK, BLOCK_CODES = 512, 1 << 18
#: Sets with a hot key (two numbers each) that are broadcast to find their texts; more of them meet the texts by a shuffle.
MOST_SENT = 1_000_000


def shingle_set(text: bytes | None, k: int, codes: WordCodes) -> np.ndarray:
    """Sorted distinct 64-bit codes of the k-word shingles; one code for a shorter text; none without words.

    bytes.lower() changes A-Z only and bytes.split() splits on 0x20 and 0x09-0x0D, as the contract asks.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        h = np.array([len(words)], np.uint64)
        for c in codes.codes(words):
            h = fmix(h * np.uint64(0x9E3779B97F4A7C15) + c)
        return h
    return np.unique(gram_codes(codes.codes(words), k))


class SetTrie:
    """Compressed prefix tree of sorted code arrays. A node holds a run of codes and the sizes found below it."""

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].tolist())
        # Nodes in parallel lists: codes of the run, depth after it, child nodes, ids that end there, sizes below.
        self.run, self.depth, self.kids, self.ends, self.low, self.high = [np.empty(0, np.int64)], [0], [[]], [[]], [1 << 60], [0]
        path, prev = [0], np.empty(0, np.int64)
        for i in order:
            s = sets[i]
            m = min(len(s), len(prev))
            diff = np.nonzero(s[:m] != prev[:m])[0]
            common = int(diff[0]) if len(diff) else m
            while self.depth[path[-1]] > common:
                node = path.pop()
                above = self.depth[path[-1]]
                if above < common:  # the shared part ends inside this run: split it
                    cut = common - above
                    mid = self._node(self.run[node][:cut], common)
                    self.kids[path[-1]][-1] = mid
                    self.run[node] = self.run[node][cut:]
                    self.kids[mid].append(node)
                    self.low[mid], self.high[mid] = self.low[node], self.high[node]
                    path.append(mid)
            if len(s) > self.depth[path[-1]]:
                leaf = self._node(s[self.depth[path[-1]] :], len(s))
                self.kids[path[-1]].append(leaf)
                path.append(leaf)
            self.ends[path[-1]].append(i)
            for node in path:
                self.low[node], self.high[node] = min(self.low[node], len(s)), max(self.high[node], len(s))
            prev = s

    def _node(self, run: np.ndarray, depth: int) -> int:
        for held, v in ((self.run, run), (self.depth, depth), (self.kids, []), (self.ends, []), (self.low, 1 << 60), (self.high, 0)):
            held.append(v)
        return len(self.run) - 1

    def matches(self, mask: np.ndarray, n: int, num: int, den: int) -> list[int]:
        """Ids of the sets with Jaccard >= num/den against the set of n codes marked in ``mask``.

        One overlap count is carried down each shared path; a subtree is left when even its largest set, with all
        codes still to come in common, would stay below the bound, or when no size in it fits.
        """
        found, stack = [], [(0, 0)]
        while stack:
            node, had = stack.pop()
            if self.high[node] * den < num * n or self.low[node] * num > den * n:
                continue
            depth, m = self.depth[node], self.high[node]
            had += int(np.count_nonzero(mask[self.run[node]]))
            if (num + den) * (had + min(m - depth, n - had)) < num * (n + m):
                # the bound is monotone in m up to m - depth = n - had; check that corner too
                m2 = min(m, depth + n - had)
                if (num + den) * (had + m2 - depth) < num * (n + m2):
                    continue
            for i in self.ends[node]:
                if (num + den) * had >= num * (n + depth):
                    found.append(i)
            stack.extend((k, had) for k in self.kids[node])
        return found


def _local(sets: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """The sets in small consecutive codes that keep the global order."""
    vocab, inv = np.unique(np.concatenate(sets) if sets else np.empty(0, np.uint64), return_inverse=True)
    return np.split(inv.astype(np.int64), np.cumsum([len(s) for s in sets])[:-1]) if sets else [], len(vocab)


def _linker(num: int, den: int):
    def hub(pdf: pd.DataFrame) -> pd.DataFrame:
        """One hub and a part of its candidates. Rows out: links, with the partners' weights."""
        sets, size = _local([np.frombuffer(b, np.uint64) for b in pdf["grams"]])
        at = int(np.flatnonzero((pdf["member"] == pdf["cluster"]).to_numpy())[0])
        mask = np.zeros(size, bool)
        mask[sets[at]] = True
        rest = [i for i in range(len(sets)) if i != at]
        hits = [rest[i] for i in SetTrie([sets[i] for i in rest]).matches(mask, len(sets[at]), num, den)]
        ids, w = pdf["member"].to_numpy(), pdf["w"].to_numpy()
        return pd.DataFrame({"a": [ids[at]] * len(hits) + [ids[i] for i in hits], "b": [ids[i] for i in hits] + [ids[at]] * len(hits), "n_links": [w[i] for i in hits] + [w[at]] * len(hits)}, columns=["a", "b", "n_links"]).astype("int64")

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        """Two blocks of a cluster (or one with itself): degrees of all links, and links enough to connect them.

        Two sets of the same hot cluster are left to the blocks of that cluster.
        """
        sets, size = _local([np.frombuffer(b, np.uint64) for b in pdf["grams"]])
        ids, w, side, hot = (pdf[c].to_numpy() for c in ("member", "w", "blk", "hot"))
        lo = pdf["bi"].iloc[0]
        same = pdf["bi"].iloc[0] == pdf["bj"].iloc[0]
        base = np.flatnonzero(side == lo)
        probes = base if same else np.flatnonzero(side != lo)
        trie = SetTrie([sets[i] for i in base])
        root, degree, out = list(range(len(ids))), np.zeros(len(ids), np.int64), []

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        mask = np.zeros(size, bool)
        for p in probes:
            mask[sets[p]] = True
            for j in trie.matches(mask, len(sets[p]), num, den):
                j = int(base[j])
                if j == p or hot[p] == hot[j] != -1:
                    continue
                degree[p] += w[j]
                if not same:
                    degree[j] += w[p]
                a, b = find(p), find(j)
                if a != b:
                    root[a] = b
                    out.append((ids[p], ids[j], 0))
            mask[sets[p]] = False
        out += [(ids[i], ids[i], int(degree[i])) for i in np.flatnonzero(degree)]
        return pd.DataFrame(out, columns=["a", "b", "n_links"]).astype("int64")

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("member", ignore_index=True)  # rows that repeat the class's id and text
        return hub(pdf) if pdf["kind"].iloc[0] == "list" else block(pdf)

    return verify


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, num: int = 9, den: int = 10, slack: float = 0.5) -> DataFrame:
    """Documents whose k-word shingle sets have Jaccard >= num/den, as components.

    Returns one row per input row: doc_id, n_shingles, component_id (smallest id reachable by links, itself
    included), n_links (other documents linked directly), text_hash (xxhash64 of the text) and link_group (equal for
    rows that links connect; null without a set). Sets are compared by 64-bit shingle codes. ``slack`` (l as a share
    of the plain prefix length) trades sample size against the strength of step 2; it never changes the result.

    1. Equal sets form a class, known by a 64-bit hash of the set; only one set per class goes on.
    2. Global order 1 (by code): of a set of n codes the first n - ceil(t n) + l hold at least min(l_a, l_b) codes in
       common with any partner. Codes found in one sample only are dropped, and then samples that have too few
       codes left, twice; this leaves sets that share text with others.
    3. Global order 2 (rarest first, then code) over what is left gives each set the keys of which it must share one.
    4. Sets that share a key become candidates if what their samples share leaves the bound in reach. Candidates that
       hang together form a cluster, whose whole sets are joined with a prefix tree block by block; a block task reports
       degrees and a spanning set of links. Clusters too large and thin for that have a prefix tree per part of a candidate list.
    5. Keys shared by more than HOT sets never expand into pairs: the whole sets that have one are ordered rarest first
       among themselves, and only those that share a code of their prefixes there go on, as most sets with a common
       passage have codes enough of their own. Codes still shared by more than HOT of them make clusters from the start. Blocks of
       a cluster hold sets of one size class (powers of den/num) and meet blocks of the same and the next class only.

    Defined cases: null or empty text, or text without words: n_shingles 0, own component, no links. Null ids: the
    row comes back with component_id null and takes no part. Repeated rows are documents of their own (equal
    sets link), also with different texts. Extra columns are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    codes = WordCodes()  # each task has its own

    def sample(n: int) -> int:
        p = n + 1 + (-num * n // den)
        return min(n, p - 1 + max(1, int(p * slack)))

    def samples(batch):
        n, digest, part = [], [], []
        for t in binary_column(batch, "text"):
            s = shingle_set(t, k, codes)
            n.append(len(s))
            digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            part.append((s[: sample(len(s))] >> np.uint64(1)).astype(np.int64))
        return pa.record_batch(
            [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(part, pa.list_(pa.int64()))],
            ["doc_id", "text_hash", "n", "digest", "part"],
        )

    def whole(batch):
        """Whole sets of the texts that have the set of their class, one for each class; other texts of the id go."""
        grams, keep, done = [], [], set()
        for i, z, want in zip(batch.column("member").to_pylist(), binary_column(batch, "text"), binary_column(batch, "digest"), strict=True):
            s = b"" if i in done else shingle_set(zstandard.ZstdDecompressor().decompress(z), k, codes).tobytes()
            keep.append(hashlib.blake2b(s, digest_size=16).digest() == want)
            if keep[-1]:
                done.add(i)
            grams.append(s)
        out = batch.select(["member", "w", "goes"])
        return pa.record_batch([*out.columns, pa.array(grams, pa.binary())], [*out.schema.names, "grams"]).filter(pa.array(keep, pa.bool_()))

    def codes_of(batch):
        n, digest, part, zipped = [], [], [], pa.types.is_binary(batch.schema.field("text").type)
        for t in binary_column(batch, "text"):
            s = shingle_set(zstandard.ZstdDecompressor().decompress(t) if zipped else t, k, codes)
            n.append(len(s))
            digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            part.append(s.view(np.int64))
        return pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(part, pa.list_(pa.int64()))], ["rep", "n", "digest", "part"])

    def pack(batch):
        z = zstandard.ZstdCompressor(level=1)
        return pa.record_batch([batch.column(0), pa.array([z.compress(t) for t in binary_column(batch, "text")], pa.binary())], ["doc_id", "text"])

    packed = map_arrow(base.where("doc_id IS NOT NULL AND length(text) > 0").select("doc_id", "text"), pack, "doc_id long, text binary")
    sampled = stash(map_arrow(base, samples, "doc_id long, text_hash long, n long, digest binary, part array<long>"), "samples")
    # l(ceil(t n)): the least number of sampled codes shared with any partner
    need = F.expr(f"CAST(-floor(-{num} * n / {den}D) AS BIGINT)")
    p_of = lambda x: x + 1 - F.floor((x * num + (den - 1)) / F.lit(den)).cast("long")
    least = F.greatest(F.lit(1).cast("long"), F.floor(p_of(need) * F.lit(slack)).cast("long"))
    full = (
        sampled.where("n > 0 AND doc_id IS NOT NULL")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.count("*").alias("w"), F.first("part").alias("part"), F.first(F.element_at("part", -1)).alias("top"))
        .withColumn("rep", F.xxhash64("digest"))
    )
    full = stash(full, "full-classes")
    rows = stash(sampled.select("doc_id", "text_hash", "n", "digest"), "sets")
    discard(sampled)

    def shared(held: DataFrame, least: Column) -> DataFrame:
        """(rep, n, c) with only codes that two or more of the sets hold, rarest first; sets that keep too few are gone."""
        each = held.select("rep", "n", F.explode("part").alias("g"))
        twice = each.groupBy("g").agg(F.count("*").alias("df")).where("df > 1")
        kept = each.join(twice, "g").groupBy("rep", "n").agg(F.collect_list(F.struct("df", "g")).alias("c"))
        return kept.where(F.size("c") >= least).select("rep", "n", F.sort_array("c").alias("c"))

    once = stash(shared(full.select("rep", "n", "part"), least).select("rep", "n", F.col("c.g").alias("part")), "shared")
    active = stash(shared(once, least), "active")
    classes = stash(full.drop("part"), "classes")
    discard(full)
    relieve(docs.sparkSession)
    keys = active.select("rep", "n", F.explode(F.slice("c", F.lit(1), (F.size("c") - least + 1).cast("int"))).alias("c")).select("rep", "n", F.col("c.df").alias("df"), F.col("c.g").alias("g"))
    fits = lambda x, y: (F.least(x["n"], y["n"]) * den >= F.greatest(x["n"], y["n"]) * num) & (x["rep"] < y["rep"]) & F.when(x["n"] <= y["n"], x["early"]).otherwise(y["early"])

    def meet(keys: DataFrame) -> DataFrame:
        """Pairs (a, b) of sets (rep, n, early) with a key g in common that is early in the smaller one."""
        return (
            keys.groupBy("g")
            .agg(F.collect_list(F.struct("rep", "n", "early")).alias("m"))
            .where("size(m) > 1")
            .select(F.explode(F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: fits(x, y)), lambda y: F.struct(x["rep"].alias("a"), y["rep"].alias("b")))))).alias("p"))
            .select("p.a", "p.b")
        )

    def whole_codes(hot: DataFrame) -> DataFrame:
        """(rep, n, part) with all codes of each set of ``hot`` (rep)."""
        want = classes.join(hot, "rep").select(F.col("first_id").alias("doc_id"), "rep")
        if hot.count() <= MOST_SENT:
            texts = base.where("length(text) > 0").join(F.broadcast(want), "doc_id").select("rep", "text")
        else:
            texts = packed.join(want.hint("merge"), "doc_id").select("rep", "text")
        sets = map_arrow(texts, codes_of, "rep long, n long, digest binary, part array<long>")
        # One row for each class: other texts of the id go, and rows that repeat its id and text.
        return sets.where(F.col("rep") == F.xxhash64("digest")).groupBy("rep").agg(F.first("n").alias("n"), F.first("part").alias("part"))

    pairs, star = meet(keys.where(f"df <= {HOT}").withColumn("early", F.lit(True))), None
    hot = stash(keys.where(f"df > {HOT}").select("rep").distinct(), "hot")
    if not hot.isEmpty():
        # Linked sets have t n codes in common at least, the smaller one 2 t n / (1 + t), so in any one order they share a code
        # of the first n - ceil(t n) + 1 and of the smaller one's first n - ceil(2 t n / (1 + t)) + 1 ("early"). Codes that no
        # other set has come first; shared() leaves them out, so the rest is that much shorter.
        ceil = lambda x, y: F.floor((F.col("n") * x + (y - 1)) / F.lit(y)).cast("int")
        held = shared(whole_codes(hot), ceil(num, den))
        first = held.select("rep", "n", (F.size("c") - ceil(2 * num, num + den) + 1).alias("early"), F.slice("c.g", F.lit(1), F.size("c") - ceil(num, den) + 1).alias("c"))
        first = stash(first.select("rep", "n", "early", F.posexplode("c").alias("at", "g")).select("rep", "n", "g", F.expr("at < early").alias("early")), "hot-keys")
        met = first.groupBy("g").agg(F.count("*").alias("m"), F.min("rep").alias("a")).where("m > 1")
        pairs = pairs.union(meet(first.join(met.where(f"m <= {HOT}").select("g"), "g")))
        star = stash(first.join(met.where(f"m > {HOT}").select("g", "a"), "g").select("a", F.col("rep").alias("b")).distinct(), "hot-stars")
    pairs = pairs.distinct()
    # What two samples share bounds the overlap: with the sample that ends first (of s of its n codes, up to code top)
    # all common codes up to there are known, and at most n - s can follow.
    size = F.least(F.col("n"), p_of(F.col("n")) - 1 + F.greatest(F.lit(1).cast("long"), F.floor(p_of(F.col("n")) * F.lit(slack)).cast("long")))
    ends = active.join(classes.select("rep", "top"), "rep").select("rep", "n", "top", (F.col("n") - size).alias("rest"), F.col("c.g").alias("held"))
    side = lambda x: ends.select(*[F.col(c).alias(c if c == "rep" else x + c) for c in ends.columns]).withColumnRenamed("rep", x)
    known = F.size(F.array_intersect("aheld", "bheld")) + F.when(F.col("atop") <= F.col("btop"), F.col("arest")).otherwise(F.col("brest"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").where(known * (num + den) >= (F.col("an") + F.col("bn")) * num).select("a", "b")

    kinds = []

    size_class = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num) + 1e-9)).cast("int")

    def blocks(member: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
        """(rows, sent) for ``member`` (cluster, member, hot): each member once for every pair of blocks that it belongs
        to, and the number of those rows by cluster. A block is named 2**32 * size class + number."""
        held = member.join(classes.select(F.col("rep").alias("member"), "n"), "member").withColumn("s", size_class)
        held = stash(held.select("cluster", "member", "hot", "n", "s"), "members")
        most = F.greatest(F.ceil(F.sum("m") / BLOCK), F.ceil(F.sum("codes") / BLOCK_CODES)).cast("int")
        sizes = held.groupBy("cluster", "s").agg(F.count("*").alias("m"), F.sum("n").alias("codes"))
        every = sizes.groupBy("cluster").agg(most.alias("all"), F.sum("m").alias("members"))
        # A cluster that fits one block is one block, whatever its size classes.
        small = stash(every.where("`all` = 1").select("cluster", F.col("members").alias("sent")), "small")
        by_class = sizes.join(small, "cluster", "left_anti").groupBy("cluster", "s").agg(F.sum("m").alias("m"), most.alias("nb"))
        by_class = stash(by_class, "blocks")
        meets = by_class.withColumn("to_s", F.explode(F.array(F.col("s") - 1, F.col("s"), F.col("s") + 1)))
        meets = stash(meets.join(by_class.select("cluster", F.col("s").alias("to_s"), F.col("nb").alias("to_nb")), ["cluster", "to_s"]), "meets")
        sent = small.union(meets.groupBy("cluster").agg(F.sum(F.col("m") * F.col("to_nb")).alias("sent")))
        name = lambda c, b: F.shiftleft(F.col(c).cast("long"), 32) + F.col(b)
        large = (
            held.join(meets.select("cluster", "s", "nb", "to_s", "to_nb"), ["cluster", "s"])
            .withColumn("at", F.pmod(F.xxhash64("member"), "nb"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("to_nb") - 1)))
            .select("member", "cluster", name("s", "at").alias("blk"), name("to_s", "other").alias("other"), "hot")
            .select("member", "cluster", F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"), "blk", "hot")
        )
        zero = F.lit(0).cast("long")
        whole_of = held.join(small, "cluster", "left_semi").select("member", "cluster", zero.alias("bi"), zero.alias("bj"), zero.alias("blk"), "hot")
        return large.union(whole_of).withColumn("kind", F.lit(kind)), sent

    pairs, member = pairs.select("*", F.lit(-1).cast("long").alias("x"), F.lit(-1).cast("long").alias("y")), None
    if star is not None and not star.isEmpty():
        member = stash(components(star), "hot-clusters")
        pairs = (
            pairs.select("a", "b")
            .join(member.select(F.col("node").alias("a"), F.col("component").alias("x")), "a", "left")
            .join(member.select(F.col("node").alias("b"), F.col("component").alias("y")), "b", "left")
            .where("x IS NULL OR y IS NULL OR x <> y")
            .select("a", "b", F.coalesce("x", F.lit(-1)).alias("x"), F.coalesce("y", F.lit(-1)).alias("y"))
        )
        kinds.append(blocks(member.select(F.col("component").alias("cluster"), F.col("node").alias("member"), F.lit(-1).cast("long").alias("hot")), "hot")[0])
    pairs = stash(pairs, "pairs")
    # The other pairs form clusters too. One that fits a block sends each of its sets once; so do larger ones, to each
    # of their pairs of blocks, where that is less than a list of candidates for each set.
    near = stash(components(pairs.select("a", "b")), "near")
    edges = stash(pairs.join(near.select(F.col("node").alias("a"), F.col("component").alias("cluster")), "a"), "clustered")
    ends_of = edges.select("cluster", F.col("a").alias("member"), F.col("x").alias("hot")).union(edges.select("cluster", "b", "y")).distinct()
    near_blocks, sent = blocks(ends_of, "near")
    dense = sent.join(edges.groupBy("cluster").agg(F.count("*").alias("e"), F.countDistinct("a").alias("hubs")), "cluster").select("cluster", (F.expr("sent <= e + hubs + 1")).alias("dense"))
    dense = stash(dense, "dense")
    kinds.append(near_blocks.join(dense.where("dense"), "cluster", "left_semi"))
    sparse = edges.join(dense.where("NOT dense"), "cluster", "left_semi")
    # A hub's list is split as blocks are: its candidates are of at most den/num times its size.
    parts = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("m") * F.col("n") * (den / num) / BLOCK_CODES)).cast("int")
    hubs = sparse.groupBy("a").agg(F.count("*").alias("m")).join(classes.select(F.col("rep").alias("a"), "n"), "a").select("a", parts.alias("parts"))
    hubs = stash(hubs, "hubs")
    lists = sparse.join(hubs, "a").select(F.col("a").alias("hub"), F.col("b").alias("member"), F.pmod(F.xxhash64("b"), "parts").alias("bi"))
    lists = lists.union(hubs.select("a", "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))).withColumn("bi", F.col("bi").cast("long"))
    kinds.append(lists.select("member", F.lit("list").alias("kind"), F.col("hub").alias("cluster"), "bi", *[F.lit(0).cast("long").alias(c) for c in ("bj", "blk")], F.lit(-1).cast("long").alias("hot")))
    goes = reduce(DataFrame.unionByName, kinds).groupBy("member").agg(F.collect_list(F.struct("kind", "cluster", "bi", "bj", "blk", "hot")).alias("goes"))
    wanted = stash(classes.select(F.col("rep").alias("member"), "first_id", "digest", "w").join(goes, "member"), "wanted")
    relieve(docs.sparkSession)
    # Always by a shuffle: beside a broadcast, packing and unpacking would share a stage and hold two workers a task.
    texts = packed.join(wanted.hint("merge"), F.col("doc_id") == F.col("first_id"))
    shape = "array<struct<kind:string,cluster:long,bi:long,bj:long,blk:long,hot:long>>"
    links = (
        map_arrow(texts.select("text", "digest", "member", "w", "goes"), whole, f"member long, w long, goes {shape}, grams binary")
        .select("member", "w", "grams", F.explode("goes").alias("to"))
        .select("member", "w", "grams", "to.*")
        .groupBy("kind", "cluster", "bi", "bj")
        .applyInPandas(_linker(num, den), "a long, b long, n_links long")
    )
    links = stash(links, "links")
    comp = stash(components(links.select("a", "b")), "components")
    least_id = comp.join(classes.select("rep", "first_id"), F.col("rep") == F.col("node")).groupBy("component").agg(F.min("first_id").alias("least_id"))
    degree = links.groupBy("a").agg(F.sum("n_links").alias("more"))
    known = (
        classes.select("digest", "rep", "first_id", "w")
        .join(comp.join(least_id, "component"), F.col("rep") == F.col("node"), "left")
        .join(degree, F.col("rep") == degree["a"], "left")
        .select(
            "digest", F.coalesce("component", "rep").alias("link_group"), F.coalesce("least_id", "first_id").alias("component"),
            (F.col("w") - 1 + F.coalesce("more", F.lit(0))).alias("links"),
        )
    )
    has_set = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    return rows.join(known, "digest", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(has_set, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(has_set, F.col("links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        "text_hash",
        F.when(has_set, F.col("link_group")).alias("link_group"),
    )


def op1_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash", "link_group")


OP1_SQL = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i+2], ' ') END AS g
  FROM w, unnest(range(1, greatest(len(ws) - 1, CASE WHEN len(ws) > 0 THEN 2 ELSE 1 END))) AS r(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 90 * (p.n + q.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
RECURSIVE_R AS (SELECT 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) AS component_id, CAST(coalesce(k.k, 0) AS BIGINT) AS n_links
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) c ON c.a = d.doc_id
LEFT JOIN (SELECT a, count(*) AS k FROM e GROUP BY a) k ON k.a = d.doc_id
"""
OP1_SQL = OP1_SQL.replace("WITH w AS", "WITH RECURSIVE w AS").replace("RECURSIVE_R AS (SELECT 1)", "reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a)")
