"""How the sources of a language differ in their use of terms."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import binary_column, slices, stash

#: Groups (a language and a source) whose descriptions are broadcast, some 100 bytes each; more of them are joined by a shuffle.
MOST_SENT = 100_000
#: Different terms, and bytes of text, after which a task hands on what it has counted.
HELD_TERMS, HELD_TEXT = 200_000, 64 << 20
#: ASCII letters in lower case, bytes of longer code points as they are, all else a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SCHEMA = "lang string, source string, term string, n long, docs long"


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n occurrences, docs that hold it), summed by task first.

    Terms are runs of letters: ASCII letters in lower case, and any code points beyond ASCII unchanged. Every group also
    has a row of the empty term, with no occurrences, so that groups without terms are there.
    """
    cols = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))]

    def count(batches):
        counts: dict = {}
        held = size = 0

        def hand_on():
            for (lang, source), (n, d) in counts.items():
                words = [*n, b""]
                held_by = [d[w] for w in n]
                yield pa.record_batch(
                    [pa.repeat(lang, len(words)), pa.repeat(source, len(words)), pa.array(words, pa.binary()).cast(pa.string()), pa.array([*n.values(), 0], pa.int64()), pa.array([*held_by, 0], pa.int64())],
                    ["lang", "source", "term", "n", "docs"],
                )

        for b in slices(batches):
            for t, lang, source in zip(binary_column(b, "text"), b.column("lang").to_pylist(), b.column("source").to_pylist(), strict=True):
                n, d = counts.get((lang, source)) or counts.setdefault((lang, source), (Counter(), Counter()))
                words, before = t.translate(_FOLD).split(), len(n)
                n.update(words)
                d.update(set(words))
                held += len(n) - before
                size += len(t)
            if held > HELD_TERMS or size > HELD_TEXT:
                yield from hand_on()
                counts, held, size = {}, 0, 0
        yield from hand_on()

    return docs.select(*cols).mapInArrow(count, _SCHEMA).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 terms)), exact: in 64 bits while the product fits, else in decimals."""
    wide = lambda c: c.cast("decimal(20,0)")
    div = lambda a, b: F.call_function("div", a, b)
    bottom = total + 2 * terms
    return 1 + F.when(n < 9_000_000_000, div((n + 2) * 1_000_000_000, bottom)).otherwise(div(wide(n + 2) * F.lit(1_000_000_000).cast("decimal(10,0)"), wide(bottom)))


def contribution(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); both are at most 10^9 + 1, so 64 bits hold it."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, q, value, rank): part ``pair`` has every other source of the language with the divergence
    from it, part ``term`` the ``top`` terms that a source uses more than its language does.

    A language's terms are those in at least ``least_docs`` of its rows. Each becomes one wide row, an array with a
    count for each of the language's sources; higher-order functions turn it into probabilities and into one
    contribution for each pair of sources, which are summed before they are shuffled. Ranks count from 1 by value
    descending, then item in byte order.

    Defined cases: null text, language and source are the empty text, a language or source of their own; a repeated
    row counts again, whatever its id; a language without such terms has pairs of value 0 and no term rows; a single
    source has no pair rows; other columns play no part; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    counted = stash(term_counts(docs, text_col, lang_col, source_col), "terms")
    # A language's sources in byte order; their places index the wide rows.
    langs = counted.where("term = ''").groupBy("lang").agg(F.array_sort(F.collect_list("source")).alias("sources"))
    groups = stash(langs.select("lang", F.posexplode("sources").alias("at", "source"), F.size("sources").alias("many")), "groups")
    sent = F.broadcast if groups.count() <= MOST_SENT else lambda df: df
    placed = counted.where("term <> ''").join(sent(groups.select("lang", "source", "at")), ["lang", "source"])
    wide = placed.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("by"))
    wide = stash(wide.where(F.col("docs") >= least_docs).select("lang", "term", "n", "by"), "wide")

    totals = wide.select("lang", F.explode("by").alias("at", "n")).groupBy("lang", "at").agg(F.sum("n").alias("total"))
    sizes = wide.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("all"))
    known = groups.join(totals, ["lang", "at"], "left").groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("total", F.lit(0)).alias("total")))), lambda g: g["total"]).alias("totals"))
    info = stash(known.join(sizes, "lang"), "langs")

    rows = wide.join(sent(info), "lang")
    p_of = F.transform("totals", lambda total, at: probability(F.coalesce(F.try_element_at("by", at), F.lit(0)), total, F.col("terms")))
    dense = rows.select("lang", p_of.alias("p"))
    # Row i of the triangle holds the contributions of the pairs (i, j), i < j.
    triangle = F.transform("p", lambda x, i: F.transform(F.slice("p", i + 2, F.size("p")), lambda y: contribution(x, y)))
    sums = (
        dense.select("lang", F.posexplode(triangle).alias("i", "row"))
        .select("lang", "i", F.posexplode("row").alias("k", "f"))
        .groupBy("lang", "i", "k")
        .agg(F.sum("f").alias("value"))
        .select("lang", "i", (F.col("i") + F.col("k") + 1).alias("j"), "value")
    )
    names = lambda at, name: sent(groups.select("lang", F.col("at").alias(at), F.col("source").alias(name)))
    each = groups.select("lang", "source", "at", F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("other")).where("at <> other")
    each = each.select("lang", "source", "other", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"))
    pairs = each.join(sums, ["lang", "i", "j"], "left").join(names("other", "item"), ["lang", "other"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(None).cast("long").alias("q"), F.coalesce("value", F.lit(0)).alias("value"))

    used = rows.select("lang", "term", F.col("n").alias("n_all"), "all", "terms", "totals", F.explode("by").alias("at", "n"))
    used = used.select("lang", "term", "at", probability(F.col("n"), F.get("totals", F.col("at")), F.col("terms")).alias("p"), probability(F.col("n_all"), F.col("all"), F.col("terms")).alias("q"))
    more = used.where("p > q").select("lang", "at", F.col("term").alias("item"), "q", contribution(F.col("p"), F.col("q")).alias("value"))
    # Where every group's first terms of a task are kept, what is shuffled does not grow with the vocabulary.
    by_value = Window.partitionBy("lang", "at").orderBy(F.desc("value"), "item")
    best = more.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top).join(names("at", "source"), ["lang", "at"])
    best = best.select("lang", "source", F.lit("term").alias("part"), "item", "q", "value", "rank")
    by_pair = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return pairs.withColumn("rank", F.row_number().over(by_pair)).unionByName(best)


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    found = divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, kept.term, coalesce(x.n, 0) AS n, kept.n AS n_all FROM g JOIN kept USING (lang) LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL) x USING (lang, source, term)),
t AS (SELECT lang, source, sum(n)::BIGINT AS total, sum(n_all)::BIGINT AS total_all, count(*) AS v FROM c GROUP BY ALL),
p AS (SELECT lang, source, term, n, 1 + 1000000000 * (n + 2) // (total + 2 * v) AS p, 1 + 1000000000 * (n_all + 2) // (total_all + 2 * v) AS q FROM c JOIN t USING (lang, source)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q),
u AS (SELECT * FROM pairs UNION ALL SELECT * FROM terms),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""
