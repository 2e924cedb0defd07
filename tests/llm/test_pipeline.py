"""The corpus pipeline against plain Python on a small table."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline


def make_rows():
    r = random.Random(11)
    words = lambda s, n: ["".join(r.choice(s) for _ in range(r.randint(2, 5))) for _ in range(n)]
    a, b = ["th", "e", "ing", "ou", "r"], ["sch", "ei", "ü", "en", "k"]
    rows = [(i, words(a if i % 2 else b, 80), "en" if i % 2 else "de") for i in range(60)]
    for i in range(12):  # near copies, in chains, some with the smaller id as the copy
        w = list(rows[i][1])
        w[10 + i] = "ring" if i % 2 else "schei"
        rows.append((100 + i if i % 3 else -100 - i, w, rows[i][2]))
        rows.append((200 + i, [*w[:40], "other", *w[41:]], rows[i][2]))
    item = words(a, 20)
    rows += [(300, words(a, 30) + item + words(a, 30), "en"), (301, words(a, 9000), "en"), (302, [*words(b, 40), 'token="abcdefgh12"'], "de")]
    rows += [(None, rows[1][1], "en"), (None, words(b, 70), "de"), rows[20], rows[20]]
    near = list(rows[21][1])
    near[3] = "ouou"
    rows += [(22, words(a, 60), "en"), (21, near, rows[21][2]), (500, near, rows[21][2])]  # one id, other texts: apart and linked
    return [(i, " ".join(w), x) for i, w, x in rows] + [(400, None, "en"), (401, "", None), (402, "12 34 !!", "de")], " ".join(item)


def kept_near(rows, hash_of):
    """Of linked rows the one of least id, then least text hash; rows with a null id stay."""
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    docs = sorted({r for r in rows if r[0] is not None}, key=lambda r: (r[0], hash_of[r[1]]))
    sets, group = [grams(t) for _, t, _ in docs], list(range(len(docs)))
    for x in range(len(docs)):
        for y in range(x):
            if group[x] != group[y] and 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y]):
                old, new = max(group[x], group[y]), min(group[x], group[y])
                group = [new if g == old else g for g in group]
    return [docs[i] for i in sorted(set(group))] + [r for r in rows if r[0] is None]


@pytest.mark.parametrize("sent", [corpus_pipeline.MOST_SENT, 0])
def test_pipeline_against_plain_python(spark, tmp_path, monkeypatch, sent):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    monkeypatch.setattr(corpus_pipeline, "MOST_SENT", sent)
    rows, item = make_rows()
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    clashing = {n: F.lit(7) for n in ("score", "lang_pred", "leaks", "spans", "n_hex", "n", "gone_id", "text_hash")}
    hash_of = {r.text: r.h for r in frame.select("text", F.xxhash64("text").alias("h")).collect()}
    frame.withColumns(clashing).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    tell = lambda df: sorted(((r.doc_id, r.text, r.lang) for r in df.collect()), key=key)
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    lettered = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    steps = [("language", lettered), ("near_duplicates", kept_near(lettered, hash_of))]
    steps.append(("decontamination", [r for r in steps[-1][1] if item not in r[1]]))
    steps.append(("secrets", [r for r in steps[-1][1] if "token=" not in r[1]]))
    for name, want in steps:
        docs = stages[name](spark, docs, str(tmp_path)).cache()
        assert tell(docs) == sorted(want, key=key), name
        assert set(docs.columns) == {"doc_id", "text", "lang", *clashing} and docs.where(" OR ".join(f"`{n}` <> 7" for n in clashing)).isEmpty()
    assert [len(w) for _, w in steps] == sorted({len(w) for _, w in steps}, reverse=True)

    coder, want = Tokenizer.from_file(P.path("byte_bpe_50k.json")), []
    for i, t, _ in steps[-1][1]:
        ids, at = [*coder.encode(t, add_special_tokens=False).ids, 0], 0
        for piece in range(-(-len(ids) // 2048)):
            n = (len(ids) - at) % 2048 or 2048
            want.append((-1 if i is None else i, piece, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())))
            at += n
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_secret_stage_searches_each_text_once_for_a_pattern(spark):
    from rowloom.llm import secret_scan

    r = random.Random(3)
    parts = ["password", "Token", "api_key", "AKIA", "AKIA1", ":", "=", '"', " ", "  ", "a", "f0", "9", "deadbeef", "Zx", ".", "-", "_", "é", "x9Q", "\n", "secret"]
    key = lambda: "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=24))
    rows = [(i, "".join(r.choices(parts, k=r.randint(1, 25)))) for i in range(4000)] + [(-1, None), (-2, ""), (-3, 'secret:"token" : abcdefghij'), (-4, "token=short " + "plain words " * 20)]
    rows += [(-5, " ".join(key() for _ in range(5000))), (-6, "x" * 19 + " " + "a1" * 4 + " AKIABANANAS")]  # a text of keys alone; one of near misses
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    kept = corpus_pipeline.secret_stage(spark, docs, "")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert all(plan.count(x) == 1 for x in (secret_scan.HEX, secret_scan.ASSIGN, secret_scan.TOKEN))  # before: six times and more, partly for each word
    spans = {x.doc_id: x.spans for x in secret_scan.scan(docs, secret_scan.train(docs)).collect()}  # no filter on them
    got = {x.doc_id for x in kept.collect()}
    assert got == {i for i, s in spans.items() if not s} and {-1, -2, -3, -4, -6} <= got and -5 not in got and 500 < len(got) < 3900


@pytest.mark.parametrize("stage", ["near_duplicates", "decontamination", "secrets", "packing"])
def test_stages_begin_on_collected_heaps(spark, tmp_path, monkeypatch, stage):
    rows, item = make_rows()
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = lambda: next(b.getCollectionCount() for b in beans if b.getName() in ("G1 Old Generation", "PS MarkSweep", "MarkSweepCompact"))
    before = whole()

    def no_python(*a, **b):  # a list goes through Python workers of a second daemon
        raise AssertionError("parallelize")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", no_python)
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, str(tmp_path))
    assert whole() > before and out.count() > 0
