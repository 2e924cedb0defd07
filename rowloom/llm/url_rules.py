"""URL filtering by written rules, and by association rules mined with Spark's FP-growth."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

#: (verdict, rule): host, then path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Bytes of rules, or of decided token sets, that are broadcast for matching; more of them are joined by a shuffle.
MOST_SENT = 16 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first '://' up to '/', '?', '#' or the end, A-Z lower-cased. Path: then up to '?', '#' or the end.
    Both empty for null or without '://'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does. One CASE, longest rules first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct host labels ('h:') and path words ('p:'); words with a digit count as 'p:#'."""
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    words = F.filter(F.split(path, r"[^\p{L}0-9]+"), lambda x: x != "")
    words = F.transform(words, lambda x: F.when(x.rlike("[0-9]"), F.lit("p:#")).otherwise(F.concat(F.lit("p:"), x)))
    return F.array_distinct(F.concat(labels, words))


def sent(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` to be broadcast if the texts of its array ``columns`` (and 100 bytes a row) are at most MOST_SENT bytes."""
    size = df.agg(F.sum(sum((F.length(F.array_join(c, " ")) for c in columns), F.lit(100)))).first()[0] or 0
    return F.broadcast(df) if size <= MOST_SENT else df


def keyed(rules: DataFrame) -> DataFrame:
    """Rules with ``token``: the one of their antecedent that the fewest rules share, so that no token has most rules."""
    tokens = rules.select("antecedent", F.explode("antecedent").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("n"))
    least = tokens.join(shared, "token").groupBy("antecedent").agg(F.min(F.struct("n", "token"))["token"].alias("token"))
    return rules.join(least, "antecedent")


def frequent_tokens(labelled: DataFrame, least: int) -> list:
    """Rows (token, same, of, by) for tokens of at least ``least`` rows: ``same`` is the first of the tokens that stand
    in exactly the same rows (told by their number and three sums of row hashes), ``by`` the verdicts with their numbers.

    With ``least`` a share s of all rows they are at most 1/s times as many as a row has tokens on average, so they
    fit on the driver whatever the table's size.
    """
    sums = [F.sum(f"h{k}").alias(f"h{k}") for k in range(3)]
    rows = labelled.select("verdict", "tokens", *[F.pmod(F.xxhash64("tokens", "verdict", F.lit(k)), F.lit(1 << 31)).alias(f"h{k}") for k in range(3)])
    said = rows.select("verdict", "h0", "h1", "h2", F.explode("tokens").alias("token")).groupBy("token", "verdict").agg(F.count("*").alias("n"), *sums)
    whole = said.groupBy("token").agg(F.sum("n").alias("of"), *sums, F.collect_list(F.struct("verdict", "n")).alias("by")).where(F.col("of") >= least)
    return whole.select("token", F.min("token").over(Window.partitionBy("of", "h0", "h1", "h2")).alias("same"), "of", "by").collect()


def mine_classes(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(tokens, verdict) rows -> rules (antecedent, verdict, confidence, support) over classes of tokens, and (token,
    same). A class is named by its first token; a rule fires where a token of each of its classes is met.

    FP-growth runs over token sets with the verdict as one more item; rules with a verdict on the right stay, except
    those that a rule with fewer tokens matches in confidence (their antecedent adds nothing: wherever they fire, that
    rule fires too and goes first). What would be listed 2^n times for the n tokens of one URL shape is taken out
    before, and no rule is lost by it. Tokens that stand in the same rows are one class, for two of them are as sure as
    one. And a token that is sure of its verdict stands in no larger antecedent: none could be surer, or speak for
    another verdict.
    """
    spark, n = labelled.sparkSession, labelled.count()
    least = max(1, math.ceil(min_support * n - 1e-9))
    tokens = frequent_tokens(labelled, least)
    members = spark.createDataFrame([(r["token"], r["same"]) for r in tokens], "token string, same string")
    heads = [r for r in tokens if r["token"] == r["same"]]
    sure = spark.createDataFrame([([r["same"]], r["by"][0]["verdict"], 1.0, r["of"] / n) for r in heads if len(r["by"]) == 1], "antecedent array<string>, verdict string, confidence double, support double")
    open_heads = {r["same"] for r in heads if len(r["by"]) > 1}

    def pick(batches):
        for b in batches:
            said = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
            yield pa.record_batch([pa.array([[*open_heads.intersection(t), f"verdict={v}"] for t, v in said], pa.list_(pa.string()))], ["items"])

    sets = labelled.select("tokens", "verdict").mapInArrow(pick, "items array<string>")
    frequent = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(sets).freqItemsets
    of_verdict = F.filter("items", lambda x: x.startswith("verdict="))
    frequent = stash(frequent.select(F.array_sort(F.array_except("items", of_verdict)).alias("antecedent"), F.get(of_verdict, F.lit(0)).alias("verdict"), "freq"), "itemsets")
    whole = frequent.where("verdict IS NULL").select("antecedent", F.col("freq").alias("of"))
    rules = (
        frequent.where("verdict IS NOT NULL AND size(antecedent) > 0").join(whole, "antecedent")
        .select("antecedent", F.substring("verdict", 9, 100).alias("verdict"), (F.col("freq") / F.col("of")).alias("confidence"), (F.col("freq") / F.lit(n)).alias("support"))
        .where(F.col("confidence") >= min_confidence)
    )
    # First against the antecedents of one token less, by equality; what is left, against all smaller ones.
    fewer = rules.select(F.col("antecedent").alias("less"), "verdict", F.col("confidence").alias("as_sure"))
    larger = rules.select("antecedent", "verdict", "confidence", F.explode("antecedent").alias("token")).withColumn("less", F.array_except("antecedent", F.array("token")))
    rules = stash(rules.join(larger.join(fewer, ["less", "verdict"]).where("as_sure >= confidence").select("antecedent", "verdict"), ["antecedent", "verdict"], "left_anti"), "rules")
    fewer = keyed(rules).select("token", F.col("antecedent").alias("less"), "verdict", F.col("confidence").alias("as_sure"))
    larger = rules.select("antecedent", "verdict", "confidence", F.explode("antecedent").alias("token"))
    beaten = larger.join(fewer, ["token", "verdict"]).where("as_sure >= confidence AND size(less) < size(antecedent) AND size(array_except(less, antecedent)) = 0")
    return rules.join(beaten.select("antecedent", "verdict"), ["antecedent", "verdict"], "left_anti").unionByName(sure), members


def mine_rules(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.8) -> DataFrame:
    """(tokens, verdict) rows -> (antecedent, verdict, confidence, support), every rule that can decide, spelled out in
    tokens: one for each choice of a token from each class of a rule of mine_classes."""
    rules, members = mine_classes(labelled, min_support, min_confidence)
    classes = members.groupBy("same").agg(F.collect_list("token").alias("of"))
    each = rules.withColumn("same", F.explode("antecedent")).join(classes, "same").groupBy("antecedent", "verdict", "confidence", "support").agg(F.collect_list("of").alias("classes"))
    chosen = F.aggregate("classes", F.array(F.array().cast("array<string>")), lambda sets, of: F.flatten(F.transform(sets, lambda x: F.transform(of, lambda t: F.concat(x, F.array(t))))))
    return each.select(F.explode(chosen).alias("antecedent"), "verdict", "confidence", "support").withColumn("antecedent", F.array_sort("antecedent"))


def judge_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict, mined (the antecedent that decided, where no written rule did).

    Pages under a written rule are the labels. Token sets of the other pages are matched by inverted index: mined
    antecedents by their least shared class, a rule fires when all its classes are met, the most confident (then best
    supported, shortest, first in order) one decides. Where none fires the verdict is ``default``. The written rules are
    the only labels there are for pages, so mined rules carry their verdicts over to pages of like hosts and paths.

    Defined cases: null urls or urls without '://' have empty host and path, no rule and the default verdict; null ids
    and repeated rows come back as they are; without any labelled page nothing is mined; an empty table gives an
    empty result; extra columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    base = base.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), F.array_sort(url_tokens(F.col("host"), F.col("path"))).alias("tokens"))
    labelled = base.where("ruled IS NOT NULL").select("tokens", F.col("ruled").alias("verdict"))
    if labelled.isEmpty():
        chosen = base.where("false").select("tokens", F.lit("").alias("says"), F.array(F.lit("")).alias("mined"))
    else:
        mined, members = mine_classes(labelled)
        index = sent(stash(keyed(mined), "index"), "antecedent")
        rank = F.struct(-F.col("confidence"), -F.col("support"), F.size("antecedent"), "antecedent", F.col("verdict"))
        # The classes that a token set meets, each with the first of its tokens there: what the rules' antecedents are made of.
        met = base.where("ruled IS NULL").select("tokens").distinct().select("tokens", F.explode("tokens").alias("token")).join(F.broadcast(members), "token")
        held = met.groupBy("tokens", "same").agg(F.min("token").alias("token")).groupBy("tokens").agg(F.collect_list(F.struct("same", "token")).alias("held"))
        own = lambda same: F.array_sort(F.transform(F.filter("held", lambda h: F.array_contains(same, h["same"])), lambda h: h["token"]))
        chosen = (
            held.select("tokens", "held", F.explode("held.same").alias("token"))
            .join(index, "token")
            .where(F.size(F.array_except("antecedent", "held.same")) == 0)
            .withColumn("antecedent", own(F.col("antecedent")))
            .groupBy("tokens")
            .agg(F.min(rank).alias("first"))
            .select("tokens", F.col("first.verdict").alias("says"), F.col("first.antecedent").alias("mined"))
        )
        chosen = sent(stash(chosen, "decided"), "tokens", "mined")
    return base.join(chosen, (base["tokens"] == chosen["tokens"]) & base["ruled"].isNull(), "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", "says", F.lit(default)).alias("verdict"), F.when(F.col("ruled").isNull(), F.array_join("mined", " ")).alias("mined")
    )


def op10_url_rules(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
