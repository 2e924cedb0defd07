"""Source divergence, spelling variants and vantage-point neighbours against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.llm import divergence, neighbours, spelling


def plain_divergence(rows, least=10):
    rows = [(t or "", x or "", s or "") for t, x, s in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(lower)) for t, _, _ in rows]
    docs, by, out = defaultdict(Counter), defaultdict(Counter), set()
    for (_, x, s), w in zip(rows, words, strict=True):
        docs[x].update(set(w))
        by[x, s].update(w)
    for lang in {x for _, x, _ in rows}:
        kept = [w for w, n in docs[lang].items() if n >= least]
        sources = sorted({s for _, x, s in rows if x == lang}, key=str.encode)
        all_of = sum((by[lang, s] for s in sources), Counter())

        def p_of(c, kept=kept):
            total = sum(c[w] for w in kept) + 2 * len(kept)
            return {w: 1 + 10**9 * (c[w] + 2) // total for w in kept}

        p, q = {s: p_of(by[lang, s]) for s in sources}, p_of(all_of)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted(((-sum(f(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in sources if o != s))
            out |= {(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(pairs)}
            terms = sorted(((-f(p[s][w], q[w]), w.encode(), w) for w in kept if by[lang, s][w] and p[s][w] > q[w]))[:10]
            out |= {(lang, s, "term", w, -v, k + 1) for k, (v, _, w) in enumerate(terms)}
    return out


@pytest.mark.parametrize("most_sent", [100_000, 0])
def test_divergence(spark, monkeypatch, most_sent):
    monkeypatch.setattr(divergence, "MOST_SENT", most_sent)
    r = random.Random(5)
    vocab = ["The", "the", "Straße", "ÉTÉ", "été", "x1y", "don't", "naïve", "日本", "a" * 3000, "zeta", "Zeta"]
    rows = [(" ".join(r.choice(vocab[: 3 + k % 10]) for _ in range(r.randint(0, 40))), r.choice(["en", "de", None]), r.choice(["s1", "s2", "É", None, "S1"])) for k in range(300)]
    rows += [(None, "en", "only null"), ("", "en", "only empty"), ("12 34 !", "en", "no letters"), ("alone here", "lonely", "one"), ("Ω the", "rare", "a"), ("Ω", "rare", "b")] + rows[:40]
    df = spark.createDataFrame([(i % 50, *x, "clash", i) for i, x in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, value int").repartition(5)
    got = [tuple(x) for x in divergence.divergence(df).select("lang", "source", "part", "item", "value", "rank").collect()]
    want = plain_divergence(rows)
    assert len(got) == len(set(got)) and set(got) == want
    assert {x[:4] for x in got if x[0] == "rare"} == {("rare", "a", "pair", "b"), ("rare", "b", "pair", "a")} and not [x for x in got if x[0] == "lonely"]
    assert divergence.divergence(df.limit(0)).count() == 0


def test_divergence_counts_beyond_64_bits(spark):
    df = spark.createDataFrame([(10**18, 2 * 10**18, 5), (3, 10, 2), (8_999_999_999, 9_000_000_001, 1), (9_000_000_000, 9_000_000_001, 1)], "n long, total long, terms long")
    got = [x[0] for x in df.select(divergence.probability(F.col("n"), F.col("total"), F.col("terms"))).collect()]
    assert got == [1 + 10**9 * (n + 2) // (t + 2 * v) for n, t, v in ((10**18, 2 * 10**18, 5), (3, 10, 2), (8_999_999_999, 9_000_000_001, 1), (9_000_000_000, 9_000_000_001, 1))]


def plain_variants(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    by = {w: [v for v in n if abs(len(v) - len(w)) < 2 and near(w, v)] for w in n}
    form = {w: min(by[w], key=lambda v: (-n[v], v)) for w in n if by[w]}
    form = {w: v for w, v in form.items() if n[v] >= 2 * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(by[w]), n[form[w]] if w in form else None))
    return out


@pytest.mark.parametrize("group,most_sent", [(1000, 100_000), (3, 100_000), (3, 0)])
def test_variants(spark, monkeypatch, group, most_sent):
    monkeypatch.setattr(spelling, "GROUP", group)
    monkeypatch.setattr(spelling, "MOST_SENT", most_sent)
    r = random.Random(9)
    base = ["".join(r.choice("aeiou" if k % 2 else "bcdßé") for k in range(r.randint(4, 9))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ababab", "bababa", "ÀÉÎÕÜ", "straße", "x" * 2000]

    def change(w):
        i = r.randrange(len(w) + 1)
        return r.choice([w, w, w[:i] + r.choice("abé") + w[i:], w[:i] + w[i + 1 :], w[:i] + r.choice("aeb") + w[i + 1 :]])

    rows = [(i, " ".join(r.choice([str.upper, str.lower, str.title])(change(change(r.choice(base)))) for _ in range(r.randint(0, 60)))) for i in range(250)]
    rows += [(None, "aaaaa bababa aaaaa"), (5, None), (6, ""), (7, "日本語 ××÷÷×÷ ÷×÷×÷× naïve'naïve_naïve12naïve"), *rows[:20]]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(4)
    got = [tuple(x) for x in spelling.variants(df).collect()]
    want = plain_variants(rows)
    assert len(got) == len(set(got)) and set(got) == want
    assert any(w[1] and w[2] != w[1] for w in want) and max(w[4] for w in want) > 3
    if group == 1000:
        assert spelling.variants(df.limit(0)).count() == 0


def test_roots_of_a_long_way(spark):
    forms = spark.createDataFrame([(f"w{i:03}", f"w{i + 1:03}") for i in range(100)], "word string, form string")
    assert {tuple(x) for x in spelling.roots(forms).collect()} == {(f"w{i:03}", "w100") for i in range(100)}


def brute(rows, step, k):
    """Exact neighbours in plain Python; the smallest vector of a repeated query id is the query."""
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    width = max((len(v) for _, v in fine), default=0)
    fine = [(i, np.r_[v, np.zeros(width - len(v))]) for i, v in fine]
    ask: dict = {}
    for i, v in fine:
        if i % step == 0:
            ask[i] = min(ask.get(i, tuple(v)), tuple(v))
    return {q: sorted(((-float((np.array(v) * x).sum()), i) for i, x in fine if i != q))[:k] for q, v in ask.items()}


@pytest.mark.parametrize("shard,queries", [(4096, 65_536), (70, 7)])
def test_exact_at_factor_one(spark, monkeypatch, shard, queries):
    monkeypatch.setattr(neighbours, "QUERIES", queries)
    monkeypatch.setattr(neighbours, "LEAF", 8)
    g = np.random.default_rng(2)
    rows = [(i, g.integers(-3, 4, 6).astype(float).tolist()) for i in range(400)]  # small whole numbers: many ties
    rows += [(1000 + i, [1.0, 2.0, 3.0, 0.0, 0.0, 1.0]) for i in range(150)]  # one very common vector
    rows += [(7, [9.0] * 6), (20, [3.0, 3.0]), (20, [2.0, 3.0]), (40, rows[40][1]), (3, rows[3][1]), (8, [float("nan")] * 6), (9, [float("inf")] + [0.0] * 5), (10, None), (11, []), (12, [0.0] * 6), (None, [1.0] * 6), (13, [1.0, None, 1.0])]
    df = spark.createDataFrame([(i, v, "clash", 0) for i, v in rows], "vec_id long, embedding array<double>, score string, rank int").repartition(5)
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0, factor=1, shard=shard).collect()
    want = brute(rows, 20, 20)
    by = defaultdict(list)
    for x in sorted(got, key=lambda x: (x.query_id, x.rank)):
        by[x.query_id].append((-x.score, x.vec_id))
    assert dict(by) == want and all(x.rank == 1 + [y for y in sorted(z.rank for z in got if z.query_id == x.query_id)].index(x.rank) for x in got)
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = neighbours.nearest(df.where("vec_id in (20, 3, 4)").dropDuplicates(["vec_id"]), F.col("vec_id") % 20 == 0).collect()
    assert sorted((x.rank, x.vec_id in (3, 4)) for x in few) == [(1, True), (2, True)]


def test_recall_and_work_of_the_relaxed_search(spark):
    """Over the whole table: at least 0.9 of the true neighbours, with scores that are the inner products, in fewer comparisons."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(x.vec_id, x.embedding) for x in df.collect()]
    got = neighbours.op13_vantage_point_neighbours(spark, "/root/testdata/sf0.1").collect()
    want = brute(rows, 20, 20)
    by = defaultdict(set)
    vec = {i: np.array(v, float) for i, v in rows}
    for x in got:
        by[x.query_id].add(x.vec_id)
        assert abs(x.score - float(vec[x.query_id] @ vec[x.vec_id])) < 1e-12
    assert set(by) == set(want) and all(len(v) == 20 for v in by.values())
    assert np.mean([len(by[q] & {i for _, i in w}) / 20 for q, w in want.items()]) >= 0.93


def test_pruning_by_the_triangle_inequality():
    """Where vectors stand in clusters the exact search looks at a small part of them."""
    g = np.random.default_rng(3)
    v = (g.normal(size=(40, 16)) * 5)[g.integers(0, 40, 4000)] + g.normal(size=(4000, 16)) * 0.1
    v /= np.sqrt((v**2).sum(1))[:, None]
    ids = np.arange(4000)
    tree = neighbours.VantageTree(ids, v, 1.0, 20)
    s = neighbours.Search(ids[:100], v[:100], np.full(100, -np.inf), 20, 1.0)
    tree.search(s)
    exact = v[:100] @ v.T
    exact[ids[:100], ids[:100]] = -9
    assert (np.sort(exact, 1)[:, :-21:-1] - s.score < 1e-12).all() and s.scored < 0.35 * 100 * 4000


def test_a_url_shape_of_many_tokens(spark):
    """Thirty tokens that always stand together, sure or not, are mined in one step each; rules are those of single tokens."""
    from rowloom.llm import url_rules

    shape = "/".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(30))
    urls = [f"http://x.com/de/{shape}/{i}" for i in range(3)] + [f"http://y.com/{'de' if i % 3 else 'fr'}/both/{shape.upper()}" for i in range(9)] + ["http://z.net/waa/1", "http://z.net/WBA/both", "http://z.net/none"] + [f"http://m.com/fr/{i}" for i in range(500)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_rules.judge_urls(df).collect()}
    assert (got[12].verdict, got[12].mined) == ("block", "p:waa") and (got[13].verdict, got[13].mined) == ("allow", None)
    host, path = url_rules.host_and_path(F.col("url"))
    labelled = df.where("page_id < 3 OR page_id > 14").select(url_rules.url_tokens(host, path).alias("tokens"), F.when(F.col("page_id") < 3, "block").otherwise("allow").alias("verdict"))
    sure = {(tuple(r.antecedent), r.verdict) for r in url_rules.mine_rules(labelled).collect()}
    assert {((f"p:{w}",), "block") for w in shape.split("/")} <= sure and all(len(a) == 1 for a, _ in sure)


def test_rewrite_keeps_every_row(spark, tmp_path):
    """Null ids, repeated ids, equal rows, and alike rows of several old shards: rows in are rows out."""
    from rowloom.llm import reshard

    r = random.Random(8)
    rows = [(r.choice([None, 1, 2, i]), r.choice([None, "", "same", "t" * (i % 40)]), i % 3, i, "x") for i in range(400)] + [(None, "hot", i % 2, 5, "x") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, was int, n int, nth string").repartition(4)
    for k, old in enumerate((F.col("was"), None)):
        path = str(tmp_path / f"o{k}")
        first = reshard.reshard(df, shards=3, old_shard=F.lit(9)).cache()
        reshard.rewrite_affected(df, first, path)
        assert sorted(map(str, spark.read.parquet(path).drop("shard").collect())) == sorted(map(str, df.collect()))
        plan = reshard.reshard(df, shards=4, old_shard=F.col("was")).cache()
        reshard.rewrite_affected(df, plan, str(tmp_path / f"p{k}"), old_shard=old)
        back = spark.read.parquet(str(tmp_path / f"p{k}"))
        changed = {x.shard for x in back.select("shard").distinct().collect()}
        assert Counter(x.shard for x in back.collect()) == Counter(x.shard for x in plan.collect() if x.shard in changed)
        if len(changed) == 4:
            assert sorted(map(str, back.drop("shard").collect())) == sorted(map(str, df.collect()))
    with pytest.raises(ValueError, match="nothing was replaced"):
        reshard.rewrite_affected(df.limit(600), first, str(tmp_path / "o0"))
    assert spark.read.parquet(str(tmp_path / "o0")).count() == 700 and not list(tmp_path.rglob("_new*"))


def test_top_k_keeps_every_row_of_an_id(spark):
    """Rows that share an id are all candidates; a large group of equal vectors ties by id."""
    from rowloom.llm import topk

    rows = [(100, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [3.0, 0.0]), (2, [2.0, -1.0]), (100, [-1.0, 5.0])] + [(300 - i, [2.5, 0.0]) for i in range(150)] + [(5, [0.0, -0.001])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted((r.rank, r.vec_id, r.score) for r in topk.exact_top_k(df, F.col("vec_id") == 100, k=6).collect())
    floor = lambda v: [int(np.floor(1024 * x)) for x in v]
    q = floor([-1.0, 5.0])
    want = sorted((-sum(a * b for a, b in zip(q, floor(v), strict=True)), i) for i, v in rows if i != 100)[:6]
    assert got == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]


# Written by hand, apart from the samples that the trees learn from: (text, the personal spans in it).
HAND = [
    ("You can reach me on 415-555-2671, I am home after six.", ["415-555-2671"]), ("Our new numbers: 212 555 0147 212 555 0148 212 555 0149", ["212 555 0147", "212 555 0148", "212 555 0149"]),
    ("(415) 555-2671 is the front desk; (415) 555-2672 the kitchen", ["(415) 555-2671", "(415) 555-2672"]), ("Ring 020 7946 0958 before noon.", ["020 7946 0958"]), ("mobile: 0171 2345678", ["0171 2345678"]), ("fax 312.555.0199.", ["312.555.0199"]),
    ("send it to jane.doe(at)mail.org today", ["jane.doe(at)mail.org"]), ("bob [at] example [dot] co [dot] uk or ann (at) example (dot) com", ["bob [at] example [dot] co [dot] uk", "ann (at) example (dot) com"]), ("press_office(at)museum.de has the pictures", ["press_office(at)museum.de"]),
    ("Her SSN, 219-09-9999, was on the form", ["219-09-9999"]), ("transfer to DE89 3704 0044 0532 0130 00 by Friday", ["DE89 3704 0044 0532 0130 00"]), ("IBAN GB82WEST12345698765432, thank you", ["GB82WEST12345698765432"]), ("NL91ABNA0417164300 is the club's account", ["NL91ABNA0417164300"]),
    ("peer 2001:db8:85a3:8d3:1319:8a2e:370:7348 timed out", ["2001:db8:85a3:8d3:1319:8a2e:370:7348"]), ("We sold 12345678 units", []), ("between 1914 1918 1939 1945 nothing grew", []), ("version 10.14.6 build 18G103 of 2021-03-04", []), ("see page 123-456 of ISBN 978-3-16-148410-0", []),
    ("pi is 3.14159265358979 and e is 2.718281828", []), ("order no 4512 8874 2210", []), ("we met (at) noon, see you (at) work", []), ("it cost 1.250.000 pesos", []), ("at 12:30:45:10 the clock stopped", []), ("part DE12 3456 7890 1234 5678 90 does not exist", []),
    ("lottery 04 11 19 23 37 42", []), ("coordinates 52.520008 13.404954", []), ("10 20 30 40 50 60 70 80 90 100", []), ("serial 98765432101234567", []), ("the 2019-2020 2020-2021 seasons", []), ("scores 21-19 21-17 19-21", []),
]


def test_added_personal_data_on_hand_written_texts(spark):
    """Base and added spans together, text by text; and the misses of a greedy generator."""
    from rowloom.llm import pii

    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(HAND)], "doc_id long, text string")
    found = {r.doc_id: [HAND[r.doc_id][0][int(a) : int(e)] for _, a, e in (s.split(":") for s in r.spans.split(","))] if r.spans else [] for r in pii.find_pii(df).collect()}
    right = sum(len(set(found[i]) & set(want)) for i, (_, want) in enumerate(HAND))
    assert right >= 0.9 * sum(len(w) for _, w in HAND) and right >= 0.9 * sum(map(len, found.values())), {HAND[i][0]: found[i] for i in found if sorted(found[i]) != sorted(HAND[i][1])}


def test_personal_data_candidates():
    """Every run of groups of 7 to 19 digits, against all pairs of groups; a long list ends soon."""
    from rowloom.llm import pii

    r = random.Random(2)
    for _ in range(200):
        t = "".join(r.choice(["12", "345", "6789", "1" * 20, " ", "-", "(", ")", ".", "x", "  -"]) for _ in range(20))
        g = [m.span() for m in re.finditer("[0-9]+", t)]
        want = set()
        for i in range(len(g)):
            for j in range(i, len(g)):
                inside, digits = t[g[i][0] : g[j][1]], sum(e - a for a, e in g[i : j + 1])
                if 7 <= digits <= 19 and re.fullmatch(r"[0-9]+(?:[ ().-]{1,2}[0-9]+)*", inside):
                    want.add((g[i][0], g[j][1]))
                    if t[g[i][0] - 1 : g[i][0]] == "(" and ")" in inside:
                        want.add((g[i][0] - 1, g[j][1]))
        assert set(pii.numbers(t)) == want
    assert len(pii.candidates(" ".join(["415-555-2671"] * 10_000))) < 150_000 and len(pii.candidates("(at)" * 20_000 + "a" * 100_000)) < 10
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB83WEST12345698765432")


def test_keys_by_length_and_ordinary_identifiers(spark):
    """Recall of random keys by alphabet and length, and the share of identifiers of other words that count as keys;
    spans against a walk through the model in Python."""
    import string

    from rowloom.llm import secret_scan

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = secret_scan.train(docs)
    r = random.Random(1)
    alphabets = {"hex": "0123456789abcdef", "alnum": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/", "letters": string.ascii_letters}
    rows = [(k, n, "".join(r.choice(a) for _ in range(n))) for k, a in alphabets.items() for n in (12, 16, 24, 40) for _ in range(150)]
    names = ["getUserAccountName", "internationalisation", "customer_address_2", "order-item-2024-11", "parseHttpResponseBody", "src/main/java/Application1", "temperature_sensor_7b", "Donaudampfschifffahrtsgesellschaft", "version-2024-01-rc1", "maximum_retry_count_3"]
    names += [f"{w}_{n}" for w in ("invoice", "measure", "holiday", "station", "library", "picture") for n in ("page2", "2023", "v10", "total9")]
    df = spark.createDataFrame([(k, n, f"say {w} now", w) for k, n, w in rows] + [("name", 0, f"in {w}, or", w) for w in names], "k string, n int, text string, w string")
    got = secret_scan.scan(df, model).collect()
    hit = Counter((x.k, x.n) for x in got if x.spans)
    for k in alphabets:
        for n in (12, 16, 24, 40):
            assert hit[k, n] >= (0.85 if n == 12 else 0.95) * 150, (k, n, hit[k, n])
    assert hit["name", 0] <= 0.05 * len(names), [x.w for x in got if x.k == "name" and x.spans]

    def ratio(w):
        return sum(model[128 * ord(a) + ord(b)] for a, b in zip(w, w[1:], strict=False)) / (len(w) - 1)

    for x in got:
        w, cut = x.w, [c for least, c in zip(secret_scan.LENGTHS, model.cuts, strict=True) if len(x.w) >= least]
        if "markov" in x.spans:
            assert ratio(w) > cut[-1] - 1e-3 and x.spans == f"markov:{x.text.index(w)}:{x.text.index(w) + len(w)}"
        elif not x.spans and x.k in ("alnum", "hex") and any(c.isdigit() for c in w) and any(c.isalpha() for c in w):
            assert ratio(w) < cut[-1] + 1e-3


@pytest.mark.parametrize("block", [3, 512])
def test_a_hub_of_many_near_copies(spark, monkeypatch, block):
    """Copies near a hub but not near each other: with small blocks the hub's list is split over several tasks."""
    from rowloom.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BLOCK", block)
    hub = [f"w{i}" for i in range(300)]
    rows = [(0, " ".join(hub))]
    for k in range(25):
        w = list(hub)
        for j in range(4):
            w[10 + (k * 11 + j * 71) % 280] = f"x{k}_{j}"
        rows.append((k + 1, " ".join(w)))
    sets = {i: {tuple(t.split()[j : j + 3]) for j in range(298)} for i, t in rows}
    near = {(a, b) for a in sets for b in sets if a != b and 10 * len(sets[a] & sets[b]) >= 9 * len(sets[a] | sets[b])}
    assert sum(a == 0 for a, _ in near) == 25 and len(near) < 80
    linker = ngram_join._linker

    def seen(num, den):
        def verify(pdf):
            out = linker(num, den)(pdf)
            assert len(pdf) <= 2 * block + 2 or pdf["kind"].iloc[0] != "list"
            return out

        return verify

    monkeypatch.setattr(ngram_join, "_linker", seen)
    got = ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {(r.doc_id, r.component_id, r.n_links) for r in got} == {(k, 0, sum(a == k for a, _ in near)) for k in sets}


@pytest.mark.parametrize("sent", [1_000_000, 0])
def test_common_passages_alone_bring_no_sets_together(spark, monkeypatch, sent):
    """Texts with a common passage and two fifths of their own are linked with nothing, so no task compares them."""
    from rowloom.llm import ngram_join

    monkeypatch.setattr(ngram_join, "HOT", 8)
    monkeypatch.setattr(ngram_join, "MOST_SENT", sent)
    r = random.Random(5)
    own = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    common = own(70)
    rows = [(i, [*common[: 60 + i % 11], *own(46)]) for i in range(150)]
    rows += [(200 + i, [*rows[i][1][:-2], "other", "end"]) for i in range(6)]  # near copies
    rows += [(300, list(reversed(rows[7][1]))), (7, own(90)), rows[8], rows[8], (None, rows[9][1]), (310, [])]  # a repeated id, repeated rows
    rows += [(400 + i, [*common, *own(3 + i % 14)]) for i in range(20)]  # mostly the passage: some are linked
    rows += [(500 + i, [*(w if (j + i) % 40 else f"v{i}" for j, w in enumerate(common)), *own(i % 5)]) for i in range(20)]
    texts = [(i, " ".join(w)) for i, w in rows]
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for _, w in rows]
    least, degree = [i for i, _ in rows], [0] * len(rows)
    near = [(a, b) for a in range(len(rows)) for b in range(len(rows)) if a != b and None not in (rows[a][0], rows[b][0]) and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for a, _ in near:
        degree[a] += 1
    for _ in rows:
        for a, b in near:
            least[a] = least[b] = min(least[a], least[b])
    linker = ngram_join._linker

    def seen(num, den):
        def verify(pdf):
            assert pdf["member"].nunique() <= 60  # before: more than 150, all in one cluster
            return linker(num, den)(pdf)

        return verify

    monkeypatch.setattr(ngram_join, "_linker", seen)
    got = ngram_join.jaccard_join(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), k=5, num=4, den=5, slack=0.25).collect()
    tell = lambda x: [-1 if v is None else v for v in x]
    assert sorted(tell((x.doc_id, x.n_shingles, x.component_id, x.n_links)) for x in got) == sorted(tell((i, len(s), c, d)) for (i, _), s, c, d in zip(rows, sets, least, degree, strict=True))
    assert sum(d > 0 for d in degree) > 20


@pytest.mark.parametrize("local", [500_000, 40])
def test_components_of_contracted_links(spark, monkeypatch, local):
    """A long way, stars, random links, repeated and self links; in one task, and in many followed by rounds."""
    from rowloom.llm import components

    monkeypatch.setattr(components, "LOCAL", local)
    r = random.Random(4)
    links = [(i, i + 1) for i in range(1000, 1090)] + [(5000, 5000 + i) for i in range(1, 40)] + [(r.randrange(-50, 150), r.randrange(-50, 150)) for _ in range(90)] + [(7, 7), (None, 3), (1003, 1002), (1003, 1002)]
    r.shuffle(links)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = [tuple(x) for x in components.components(spark.createDataFrame(links, "a long, b long").repartition(6)).collect()]
    assert len(got) == len(set(got)) and set(got) == {(x, find(x)) for x in root}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
