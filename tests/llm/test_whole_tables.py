"""The contract's columns over whole driver tables, and texts and tables at the edges, against plain Python."""

import hashlib
import os
import pickle
import random
import re
import subprocess
import sys
import time
import zlib

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from rowloom.llm import decontaminate, language, pii, queries, secret_scan, substring_dedup, url_rules

SF = "/root/testdata/sf0.001"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
PII = (("email", EMAIL), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
SECRETS = (("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+"))


def digits(s):
    return [int(c) for c in s if c in "0123456789"]


def luhn(d):
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0


def holds(kind, m):
    if kind == "ip":
        return all(int(p) <= 255 for p in m[0].split("."))
    if kind == "card":
        return 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))
    if kind == "phone":
        return 10 <= len(digits(m[0])) <= 15
    return {"assign": lambda: len(m[2]) >= 8, "access": lambda: len(m[0]) >= 16, "hex": lambda: len(m[0]) >= 32}.get(kind, lambda: True)()


def base(text, kinds):
    spans = sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(kinds) for m in re.finditer(p, text or "") if holds(k, m))
    return [f"{k}:{a}:{e}" for a, _, e, k in spans]


@pytest.mark.parametrize("name, kinds", [("op7_boosted_pii", PII), ("op9_markov_secret_scan", SECRETS)])
def test_base_spans_of_every_document(spark, name, kinds):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.QUERIES[name](spark, "/root/testdata/sf0.01").collect()}
    assert set(got) == set(texts)
    seen = 0
    for d, t in texts.items():
        want = base(t, kinds)
        seen += len(want)
        assert [got[d][f"n_{k}"] for k, _ in kinds] == [sum(w.startswith(k + ":") for w in want) for k, _ in kinds]
        assert got[d].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [s for s in got[d].spans.split(",") if s.split(":")[0] in dict(kinds)] == want
    assert seen > 10


def test_base_patterns_on_random_texts():
    r = random.Random(4)
    for _ in range(3000):
        t = "".join(r.choice("a.@-_b1 29+()é") for _ in range(r.randint(0, 40)))
        assert [f"{k}:{a}:{e}" for a, e, k in pii.base_spans(t)] == base(t, PII), t


def test_long_runs_are_read_once():
    for t in ("1" * 1_000_000, "a" * 1_000_000, "a@" * 300_000, "1." * 300_000, "+1(" * 300_000, "12 " * 300_000, "ab:" * 300_000, "a(at)" * 150_000):
        start = time.process_time()
        pii.base_spans(t)
        pii.candidates(t)
        assert time.process_time() - start < 30, t[:10]


def test_resharding_of_every_document(spark):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.QUERIES["op2_min_cost_reshard"](spark, SF).collect()
    assert {r.doc_id: (r["size"], r.text_crc32) for r in got} == {d: (len(t) + 1, zlib.crc32(t)) for d, t in texts.items()}
    home = {}
    for r in got:
        home.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert all(len(x) == 1 for x in home.values()) and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_hosts_paths_and_rules_of_every_page(spark):
    rules = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
    got = {r.page_id: r for r in queries.QUERIES["op10_url_rules"](spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        host = path = ""
        if p.url and "://" in p.url:
            m = re.match(r"([^/?#]*)([^?#]*)", p.url.split("://", 1)[1])
            host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]
        fits = [(len(x), v, x) for v, x in rules for h, _, q in [x.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + q)]
        g = got[p.page_id]
        assert (g.host, g.path, g.rule) == (host, path, max(fits)[2] if fits else None)
        assert g.verdict == max(fits)[1] if fits else g.verdict in ("allow", "block")


def test_mined_rules_decide_as_brute_force(spark):
    """Every antecedent up to the longest token set, counted in Python, gives the same decision for every open page."""
    import itertools

    pages = [(i, f"http://{'abc'[i % 3]}.{['site.org', 'shop.com', 'else.net'][i % 5 % 3]}/{['de', 'fr', 'x'][i % 7 % 3]}/{['news', 'ads'][i % 2]}") for i in range(210)]
    df = spark.createDataFrame(pages, "page_id long, url string")
    host, path = url_rules.host_and_path(F.col("url"))
    sets = {r.page_id: frozenset(r.t) for r in df.select("page_id", url_rules.url_tokens(host, path).alias("t")).collect()}
    got = {r.page_id: r for r in url_rules.judge_urls(df).collect()}
    ruled = {i: r.verdict for i, r in got.items() if r.rule}
    open_pages = [i for i, r in got.items() if not r.rule]
    of, hits = {}, {}
    for i, v in ruled.items():
        for k in range(1, len(sets[i]) + 1):
            for a in itertools.combinations(sorted(sets[i]), k):
                of[a] = of.get(a, 0) + 1
                hits[a, v] = hits.get((a, v), 0) + 1
    rules = [(-n / of[a], -n / len(ruled), len(a), list(a), v) for (a, v), n in hits.items() if n / of[a] >= 0.8 and n >= 0.002 * len(ruled)]
    for i in open_pages:
        best = min((x for x in rules if set(x[3]) <= sets[i]), default=None)
        assert got[i].verdict == (best[4] if best else "allow"), (pages[i], best)
    assert open_pages and any(got[i].mined for i in open_pages)


def test_held_out_accuracy_on_the_driver_table(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = queries.QUERIES["op8_ppm_language_id"](spark, "/root/testdata/sf0.01").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    judged = [r for r in got if r.held_out and r.lang_pred != "und" and lang[r.doc_id]]
    assert len(judged) > 200 and sum(r.lang_pred == lang[r.doc_id] for r in judged) / len(judged) > 0.99


def test_long_text_counts_as_the_sum_of_its_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "the thing with other words " * 9 if i % 2 else "das ding mit worten über " * 9, "en" if i % 2 else "de") for i in range(40)], "doc_id long, text string, lang string")
    model = language.learn(docs)
    text = spark.createDataFrame([(1, "das ding über " * 3000)], "doc_id long, text string")
    whole = language.identify(text, model).collect()
    monkeypatch.setattr(language, "PART", 700)
    assert language.identify(text, model).collect() == whole and whole[0].lang_pred == "de"


def test_models_travel_without_the_package(spark, tmp_path):
    """A worker that cannot import the package can still read what is broadcast."""
    docs = spark.createDataFrame([(i, "some english words here" if i % 2 else "ein paar deutsche worte", "en" if i % 2 else "de") for i in range(40)], "doc_id long, text string, lang string")
    models = {"language": language.learn(docs), "pii": pii.train(), "bench": decontaminate.Benchmark([(1, "a b c d e f g")])}
    (tmp_path / "m").write_bytes(pickle.dumps({k: cloudpickle.dumps(v) for k, v in models.items()}))
    code = f"import pickle, sys; m = {{k: pickle.loads(v) for k, v in pickle.load(open({str(tmp_path / 'm')!r}, 'rb')).items()}}; print(m['language'].langs, len(m['pii'][0].trees), m['bench'].ids, 'rowloom' in sys.modules)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=str(tmp_path), env=env, capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == ["['de',", "'en']", str(len(models["pii"][0].trees)), "[1]", "False"], out.stderr


def test_secrets_with_clashing_columns_and_many_matches(spark):
    key = "AKIA" + "Z9" * 8
    rows = [(1, f"x {key} y", 1, 2, 3, 4), (2, None, 1, 2, 3, 4), (3, f"é {key} " * 3000, 1, 2, 3, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _a int, found_base int, spans int, n_hex int")
    got = {r.doc_id: r for r in secret_scan.scan(df, [0.0] * 16384).collect()}
    assert [(r._a, r.found_base) for r in got.values()] == [(1, 2)] * 3 and got[1].spans == "access:2:22" and got[2].spans == ""
    assert got[3].spans.split(",") == [f"access:{23 * i + 2}:{23 * i + 22}" for i in range(3000)]
    kept = secret_scan.scan(df, [0.0] * 16384, prefix="_x_").collect()[0]
    assert (kept.spans, kept.n_hex, kept["_x_n_access"]) == (3, 4, 1)


def test_items_that_repeat_an_id(spark):
    items = spark.createDataFrame([(7, "one two three four five six"), (7, "red blue green black white pink"), (8, "red blue green black white pink")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x one two three four five six y"), (2, "red blue green black white pink"), (3, "nothing here")], "doc_id long, text string")
    for most in (1, 1 << 20):
        decontaminate.PASS_BYTES, old = most, decontaminate.PASS_BYTES
        try:
            got = {r.doc_id: [(x.item_id, x.start) for x in r.leaks] for r in decontaminate.find_leaks(docs, items).collect()}
        finally:
            decontaminate.PASS_BYTES = old
        assert got == {1: [(7, 1)], 2: [(7, 0), (8, 0)], 3: []}


def test_simhash_radius_loses_few_altered_items():
    """Windows at similarity 0.8 or more that the radius would leave out: none of some thousands of altered items."""
    r = random.Random(12)
    codes, near, lost = decontaminate.WordCodes(), 0, 0
    from collections import Counter

    for _ in range(4000):
        w = [f"w{r.randrange(3000)}".encode() for _ in range(r.randint(13, 60))]
        v = list(w)
        for _ in range(r.randint(1, 2)):
            v[r.choice([0, 1, len(v) - 2, len(v) - 1, r.randrange(len(v))])] = f"x{r.randrange(3000)}".encode()
        a, b = (decontaminate.gram_codes(codes.codes(x), 5) for x in (w, v))
        both = sum((Counter(a.tolist()) & Counter(b.tolist())).values())
        if both / (2 * len(a) - both) >= 0.8:
            near += 1
            lost += bin(int(decontaminate.fingerprint(a) ^ decontaminate.fingerprint(b))).count("1") > decontaminate.RADIUS
    assert near > 1000 and lost == 0


def test_fm_index_against_brute_force():
    r = random.Random(2)
    for words in (3, 40):
        seqs = [np.array([r.randrange(words) for _ in range(r.randint(5, 60))]) for _ in range(30)]
        index = substring_dedup.FMIndex(seqs)
        text = [x for s in seqs for x in [*(s + 2).tolist(), 1]]
        ends = np.array([i for i in range(1, len(text) + 1) if 1 not in text[max(0, i - 8) : i] and i >= 8])
        length, lo, hi = index.matching(np.array(text), ends, 8)
        for e, n, a, b in zip(ends.tolist(), length.tolist(), lo.tolist(), hi.tolist(), strict=True):
            places = lambda k: [i for i in range(len(text) - k + 1) if text[i : i + k] == text[e - k : e]]  # noqa: E731, B023
            assert n == max(k for k in range(9) if k == 0 or len(places(k)) > 1)
            if n:
                assert sorted(index.locate(np.arange(a, b)).tolist()) == places(n)
    seqs = [np.array([r.randrange(5000) for _ in range(60)]) for _ in range(1000)]
    index = substring_dedup.FMIndex(seqs)
    planes = [p for _, p, _ in index.bwt.levels] + [index.kept]
    held = sum(p.words.nbytes + p.before.nbytes for p in planes) + index.places.nbytes
    assert held / index.n < 3.5 and not hasattr(index, "text") and not hasattr(index, "sa")
