"""A cleaning pipeline over ``documents``: five of the corpus operators, one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowloom.llm.common import fresh, relieve, stash
from rowloom.llm.decontaminate import find_leaks
from rowloom.llm.language import identify, learn
from rowloom.llm.ngram_join import jaccard_join
from rowloom.llm.packing import pack
from rowloom.llm.secret_scan import holds_secret, train

#: Least share of the best language's posterior that keeps a document.
LEAST_SCORE = 0.5
#: Dropped documents (id and text hash, 16 bytes each) that are broadcast; more of them are joined by a shuffle of the texts.
MOST_SENT = 1_000_000


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language stay; those without letters, null and empty ones go, as do ties between
    languages (LEAST_SCORE). Null ids, repeated rows and extra columns come back as they are."""
    lang, score = fresh(docs.columns, "lang_pred"), fresh(docs.columns, "score")
    judged = identify(docs, learn(docs), lang_col=lang, score_col=score)
    return judged.where((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE)).drop(lang, score)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at Jaccard 0.8 or more, the one of smallest id stays.

    Documents without words and rows with a null id stay. Of rows that repeat an id, linked ones are one document (the
    text of least hash stays, and of equal rows the first in the order of all columns); others are documents of their own.
    An empty table gives an empty one.
    """
    relieve(spark)
    ids = jaccard_join(docs, k=5, num=4, den=5, slack=0.25).where("link_group IS NOT NULL").select("doc_id", "text_hash", "component_id", "link_group")
    ids = stash(ids, "groups")
    heads = ids.where("doc_id = component_id").groupBy("link_group", "doc_id", "text_hash").agg(F.count("*").alias("rows"))
    heads = heads.withColumn("first_hash", F.min("text_hash").over(Window.partitionBy("link_group")))
    # The rows that go are fewer than those that stay, so they are what meets the texts.
    gone = ids.where("component_id < doc_id").select("doc_id", "text_hash").union(heads.where("text_hash > first_hash").select("doc_id", "text_hash")).distinct()
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"))
    if gone.count() <= MOST_SENT:
        gone = F.broadcast(gone)
    out = docs.join(gone, (docs["doc_id"] == gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_hash"]), "left_anti")
    again = heads.where("rows > 1").select(F.col("doc_id").alias("again_id"), F.col("text_hash").alias("again_hash"))
    if again.isEmpty():
        return out
    same = (out["doc_id"] == again["again_id"]) & (F.xxhash64(out["text"]) == again["again_hash"])
    n = fresh(docs.columns, "n")
    order = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(*[F.col(f"`{c}`") for c in docs.columns])
    one = out.join(again, same, "left_semi").withColumn(n, F.row_number().over(order)).where(F.col(n) == 1).drop(n)
    return out.join(again, same, "left_anti").union(one)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none."""
    relieve(spark)
    leaks = fresh(docs.columns, "leaks")
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out_col=leaks)
    return found.where(F.size(leaks) == 0).drop(leaks)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a secret go; null and empty texts hold none."""
    relieve(spark)
    return docs.where(~holds_secret(F.col("text"), train(docs)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of 2048-token sequences; null and empty texts are one id each."""
    relieve(spark)
    return pack(docs)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: No stage's method can be said in SQL as a whole; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
