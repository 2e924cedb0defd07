"""Spelling variants: words one edit apart, grouped under their most frequent form."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stash

#: Different words after which a task hands on what it has counted.
HELD_WORDS = 200_000
#: Words that share a positional bigram and a length are compared in groups of at most this many on one side.
GROUP = 1000
#: Rows of the table of larger groups that are broadcast; more of them are joined by a shuffle.
MOST_SENT = 100_000
#: Latin-1 bytes: ASCII letters in lower case, U+00C0 to U+00FF as they are, all else a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 192 else 32 for c in range(256))
#: Each noised run is one of this many.
NOISE = 97


def noised(prefix: int, run: bytes) -> bytes:
    """A run (Latin-1) without one of its letters if NOISE divides the crc32 of ``<doc_id>:<run>``, else as it is;
    ``prefix`` is the crc32 up to the colon."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
    if h % NOISE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n) over whole texts: runs of letters A to Z and U+00C0 to U+00FF, ASCII in lower case, noised."""

    def count(batches):
        counts: Counter = Counter()
        fold = lambda t: t.encode("latin-1", "replace").translate(_FOLD).split()

        def hand_on():
            words = [w.decode("latin-1") for w in counts]
            yield pa.record_batch([pa.array(words, pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for b in slices(batches):
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if t:
                    prefix = zlib.crc32(f"{i}:".encode() if i is not None else b":")
                    for run, n in Counter(fold(t)).items():
                        if len(run) >= least_letters and len(w := noised(prefix, run)) >= least_letters:
                            counts[w] += n
            if len(counts) > HELD_WORDS:
                yield from hand_on()
                counts.clear()
        yield from hand_on()

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text IS NOT NULL")
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _by_length(words: list[str]):
    """(places, letters as a matrix of Latin-1 codes) for the words of each length."""
    raw = [w.encode("latin-1") for w in words]
    size = np.array([len(w) for w in raw], np.int64)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield at, np.frombuffer(b"".join(raw[i] for i in at), np.uint8).reshape(len(at), n).astype(np.int64)


def bigram_order(words: DataFrame) -> np.ndarray:
    """Rank of each bigram (first letter x 256 + second), the rarest among ``words`` first, ties by code. Words have 90
    letters at most, so that at most 8,100 counts come to the driver."""

    def count(batches):
        n = np.zeros(1 << 16, np.int64)
        for b in batches:
            for _, m in _by_length(b.column(0).to_pylist()):
                n += np.bincount((m[:, :-1] * 256 + m[:, 1:]).ravel(), minlength=1 << 16)
        g = np.flatnonzero(n)
        yield pa.record_batch([pa.array(g), pa.array(n[g])], ["g", "n"])

    seen = words.select("word").mapInArrow(count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(1 << 16, np.int64)
    n[seen.column("g").to_numpy()] = seen.column("n").to_numpy()
    rank = np.empty(1 << 16, np.int64)
    rank[np.argsort(n, kind="stable")] = np.arange(1 << 16)
    return rank


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b) for words exactly one inserted, deleted or replaced letter apart, each pair once; words of (word) have
    at least four letters, each once.

    One edit spoils at most two of a word's bigrams. So of two near words, whose bigrams stand in one global order, the
    first that they have in common is among the three first of either, at places that differ by what the edit moves:
    not at all between words of one length, by nothing or one in a word one letter longer. Words meet on (length of
    the shorter, bigram, place); an edit distance with a bound of one decides. Groups larger than GROUP are met in
    parts of that size, so that none lands in one task.
    """
    rank = bigram_order(words)

    def keys(batches):
        for b in batches:
            words = b.column(0).to_pylist()
            for at, m in _by_length(words):
                grams = m[:, :-1] * 256 + m[:, 1:]
                first = np.argsort(rank[grams], axis=1, kind="stable")[:, :3]
                g, long = np.take_along_axis(grams, first, 1), m.shape[1]
                key = lambda length, place: ((length << 40) ^ (place << 16) ^ g).ravel()
                own = pa.array(np.repeat(at, first.shape[1]))
                names = b.column(0).take(own)
                letters = np.bitwise_or.reduce(np.int64(1) << np.where(m < 128, m - 97, 26 + m % 38), axis=1)
                letters = pa.array(np.repeat(letters, first.shape[1]))
                for side, k in ((0, key(long, first)), (1, key(long - 1, first)), (1, key(long - 1, first - 1))):
                    yield pa.record_batch([names, letters, pa.repeat(pa.scalar(side, pa.int8()), len(k)), pa.array(k)], ["word", "letters", "side", "key"])

    placed = stash(words.select("word").mapInArrow(keys, "word string, letters long, side byte, key long"), "bigrams")
    left = placed.where("side = 0").select("key", F.col("word").alias("a"), F.col("letters").alias("letters_a"))
    right = placed.select("key", F.col("word").alias("b"), F.col("letters").alias("letters_b"), "side")
    large = stash(left.groupBy("key").count().where(F.col("count") > GROUP).select("key", F.ceil(F.col("count") / GROUP).cast("int").alias("parts")), "large")
    on = ["key"]
    if many := large.count():
        large = F.broadcast(large) if many <= MOST_SENT else large
        parts = F.coalesce("parts", F.lit(1))
        left = left.join(large, "key", "left").select("key", "a", "letters_a", F.pmod(F.xxhash64("a"), parts).cast("int").alias("part"))
        right = right.join(large, "key", "left").select("key", "b", "letters_b", "side", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        on = ["key", "part"]
    # One edit takes a letter away, brings one in, or both.
    alike = F.bit_count(F.col("letters_a").bitwiseXOR(F.col("letters_b"))) <= 2
    met = left.join(right, on).where(alike & ((F.col("side") == 1) | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def roots(forms: DataFrame, rounds: int = 60) -> DataFrame:
    """(word, form) -> (word, root): the last word on the way from form to form. Ways double in length each round;
    raises where they do not end."""
    at = stash(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(rounds):
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stash(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at
    raise RuntimeError(f"forms did not end in {rounds} rounds")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: float = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of at least five letters with three occurrences.

    A word's form is its near word (see near_pairs) of most occurrences, ties to the first in code-point order, if it
    has at least ``times`` as many; its root is where the forms end (itself without one).

    Defined cases: a null text has no words; the words of a row with a null id are noised as those of an empty id; a
    repeated row counts again; words without near words have n_near 0; other columns play no part; an empty table
    gives an empty result.
    """
    words = stash(word_counts(docs, id_col, text_col), "words")
    pairs = near_pairs(words)
    both = pairs.union(pairs.select("b", "a")).toDF("word", "other")
    counts = words.select(F.col("word").alias("other"), F.col("n").alias("n_other"))
    near = both.join(counts, "other").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("less"), "other")).alias("best"))
    found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.other").alias("best"), (-F.col("best.less")).alias("best_n"))
    has = F.col("best_n") >= times * F.col("n")
    found = stash(found.select("word", F.when(has, F.col("best")).alias("form"), "n", "n_near", F.when(has, F.col("best_n")).alias("form_n")), "forms")
    ends = roots(found.where("form IS NOT NULL"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH RECURSIVE crc AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) r(n)),
o AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
u AS (SELECT id, run, count(*) AS n FROM o WHERE length(run) >= 5 GROUP BY ALL),
h AS (SELECT run, n, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(id || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [(192 | (unicode(x) >> 6))::BIGINT, (128 | (unicode(x) & 63))::BIGINT] END))),
  lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h FROM u, crc),
c AS (SELECT CASE WHEN h % 97 = 0 THEN substring(run, 1, (h % length(run))::INTEGER) || substring(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM c WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
d AS (SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INTEGER AS i FROM w)),
p AS (SELECT a.word, b.word AS other, b.n FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT d.word, w.word, w.n FROM d JOIN w ON w.word = d.rest UNION SELECT w.word, d.word, d.n FROM d JOIN w ON w.word = d.rest),
b AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS best FROM p GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best >= 2 * w.n THEN other END AS form, CASE WHEN best >= 2 * w.n THEN best END AS form_n FROM w LEFT JOIN b USING (word)),
r AS (SELECT word, word AS root, 0 AS step FROM f UNION ALL SELECT r.word, f.form, step + 1 FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL),
e AS (SELECT word, last(root ORDER BY step) AS root FROM r GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN e USING (word)
"""
