"""Secrets by written base patterns and by character Markov models; DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stash

# The contract's base patterns. A run of hex digits of 32 or more starts where the run of any length does.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
#: What the Markov models judge: words of key characters with a digit and a letter (10 or more), with a capital behind
#: the first character and a small letter (12 or more), or of letters alone (20 or more). Ten key characters are looked
#: for first: most words are shorter, and each of the three forms would read them.
_KEY = "A-Za-z0-9+/_=-"
TOKEN = rf"(?<![{_KEY}])(?=[{_KEY}]{{10}})(?:(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[{_KEY}]{{10,}}|(?=[{_KEY}][a-z0-9+/_=-]*[A-Z])(?=[A-Z0-9+/_=-]*[a-z])[{_KEY}]{{12,}}|[A-Za-z]{{20,}}(?![{_KEY}]))"
#: Mean log-likelihood ratio (nats per character pair) from which a word counts as random, where nothing is calibrated.
THRESHOLD = 0.5
#: Lengths from which a threshold of its own holds, and the share of held-out ordinary identifiers that may reach it.
LENGTHS, FALSE_SHARE, ENOUGH = (10, 13, 16, 20, 32), 1 / 1000, 200
#: Documents whose words teach the model of ordinary identifiers, about; generated random strings.
SAMPLE, RANDOM = 4000, 3000
#: Matches in one running sum.
RUN = 256
#: Around a word whose pairs are counted.
START, END = "\x02", "\x03"


def _located(text: Column, pattern: str) -> Column:
    """Matches as array<struct<at, end, v>>: code point offsets and the match. A text without a match is searched once.

    Offsets are running sums of the lengths of matches and of the pieces between them: sums within runs of RUN matches,
    then over the runs, so that the work for m matches grows with m * sqrt(m) at most in practice, not with m * m.
    """
    # A value that several lambdas need goes through an array of one, so that it is worked out once.
    once = lambda value, fn: F.get(F.transform(F.array(value), fn), F.lit(0))
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("b"))
    paired = lambda x: F.zip_with(F.slice(x["b"], 1, F.size(x["m"])), x["m"], lambda b, m: F.struct(F.length(b).alias("gap"), F.length(m).alias("n"), m.alias("v")))
    empty = F.array().cast("array<struct<at:int,end:int,v:string>>")

    def within(run: Column) -> Column:
        add = lambda acc, x: F.struct(
            (acc["pos"] + x["gap"] + x["n"]).alias("pos"),
            F.concat(acc["out"], F.array(F.struct((acc["pos"] + x["gap"]).alias("at"), (acc["pos"] + x["gap"] + x["n"]).alias("end"), x["v"].alias("v")))).alias("out"),
        )
        return F.aggregate(run, F.struct(F.lit(0).alias("pos"), empty.alias("out")), add)

    in_runs = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / RUN).cast("int")), lambda i: within(F.slice(p, i * RUN + 1, F.lit(RUN))))
    runs = once(once(found, paired), in_runs)
    shift = lambda acc, run: F.struct(
        (acc["pos"] + run["pos"]).alias("pos"),
        F.concat(acc["out"], F.array(F.transform(run["out"], lambda s: F.struct((s["at"] + acc["pos"]).alias("at"), (s["end"] + acc["pos"]).alias("end"), s["v"].alias("v"))))).alias("out"),
    )
    nested = F.array().cast("array<array<struct<at:int,end:int,v:string>>>")
    located = F.aggregate(runs, F.struct(F.lit(0).alias("pos"), nested.alias("out")), shift, lambda acc: F.flatten(acc["out"]))
    return F.when(text.rlike(pattern), located).otherwise(empty)


def _pairs(word: Column) -> Column:
    """Codes 128 * a + b of neighbouring characters; characters beyond ASCII count as 0."""
    code = F.transform(F.split(word, ""), lambda c: F.when(F.ascii(c) < 128, F.ascii(c)).otherwise(0))
    return F.zip_with(F.slice(code, 1, F.size(code) - 1), F.slice(code, 2, F.size(code) - 1), lambda a, b: a * 128 + b)


def ordinary_pairs(a: str, b: str) -> dict[int, float]:
    """What one pair of a word's characters (START and END around it) adds to the pairs of the word's forms: in lower
    case, as it is, in upper case, get_word_value, word-id-2024, dir/word/file and, behind common last letters,
    camelCaseWord."""
    out: dict[int, float] = {}

    def add(text: str, times: float = 1) -> None:
        for x, y in zip(text, text[1:], strict=False):
            p = 128 * ord(x) + ord(y)
            out[p] = out.get(p, 0) + times

    if a == START:
        add("get_" + b.lower())
        add("/" + b.lower(), 0.3)
        for last in "etrsn":
            add(last + b.upper(), 0.1)
    elif b == END:
        add(a.lower() + "_value")
        add(a.lower() + "-id-2024")
        add(a.lower() + "/", 0.3)
    else:
        add((a + b).lower(), 3)
        add(a + b)
        add((a + b).upper())
        add(a.upper() + b.lower(), 0.5)
    return out


class KeyModel(list):
    """log P(b|a) under random strings minus log P(b|a) under ordinary identifiers for all 128 x 128 pairs; ``cuts`` has
    the threshold for each of LENGTHS."""

    cuts: tuple[float, ...] = (THRESHOLD,) * len(LENGTHS)


def ratio(word: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of a word's pairs."""
    table = F.split(F.lit(",".join(f"{x:.4f}" for x in model)), ",").cast("array<float>")  # folded to one literal
    p = _pairs(word)
    return F.aggregate(p, F.lit(0.0), lambda acc, i: acc + F.get(table, i).cast("double")) / F.greatest(F.size(p), F.lit(1))


def cut_of(length: Column, cuts) -> Column:
    out = F.lit(cuts[0])
    for least, cut in zip(LENGTHS[1:], cuts[1:], strict=True):
        out = F.when(length >= least, F.lit(cut)).otherwise(out)
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> KeyModel:
    """Both Markov models' ratios, and thresholds by length.

    Labelled samples: generated hex, base-64 and alphanumeric strings; and the words (6 characters or more, base
    matches and words with digits taken out, also joined as snake_case) of about ``sample`` whole documents, taken by a
    hash. Words of a fifth of the hashes are held out: identifiers made of them, in forms of their own, set each
    length's threshold to what FALSE_SHARE of them reach (THRESHOLD where fewer than ENOUGH are held out). At most 2 x 16384 counts
    come to the driver.
    """
    spark = docs.sparkSession
    n = docs.count()
    share = min(1.0, sample / max(1, n))
    clean = F.regexp_replace(F.regexp_replace(F.col(text_col), ASSIGN, " "), r"[^A-Za-z ]+", " ")
    words = (
        docs.where((F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 20)) <= int(share * (1 << 20))) & F.col(text_col).isNotNull())
        .select(F.explode(F.split(clean, " +")).alias("w"))
        .where("length(w) >= 6")
        .groupBy("w")
        .agg(F.count("*").alias("n"))
        .withColumn("held", F.pmod(F.xxhash64("w"), F.lit(5)) == 0)
    )
    words = stash(words, "words")
    learned = words.where("NOT held").select(F.concat(F.lit(START), F.col("w"), F.lit(END)).alias("w"), "n", F.lit(0).alias("random"))
    h = F.sha2(F.col("id").cast("string"), 256)
    key = F.base64(F.unhex(h))
    short = F.regexp_replace(key, "[+/=]", "")
    random = spark.range(RANDOM).select(F.explode(F.array(h, key, short, F.upper(short))).alias("w"), F.lit(1).cast("long").alias("n"), F.lit(1).alias("random"))
    seen = learned.union(random).select("random", "n", F.explode(_pairs(F.col("w"))).alias("p")).groupBy("random", "p").agg(F.sum("n").alias("n")).collect()
    count = [[0.5] * 16384, [0.5] * 16384]
    for r in seen:
        if r.random:
            count[1][r.p] += r.n
        else:
            for p, times in ordinary_pairs(chr(r.p // 128), chr(r.p % 128)).items():
                count[0][p] += r.n * times
    out = KeyModel()
    for a in range(128):
        rows = [c[128 * a : 128 * a + 128] for c in count]
        sums = [sum(x) for x in rows]
        out += [max(-4.0, min(4.0, math.log(y / sums[1]) - math.log(x / sums[0]))) for x, y in zip(*rows, strict=True)]
    w, small = F.col("w"), F.lower("w")
    forms = F.array(w, F.concat(w, F.lit("2024")), F.concat(small, F.lit("_v2")), F.concat(F.lit("x86_"), small), F.concat(small, F.initcap(small)), F.concat(F.upper(w), F.lit("_ID_7")), F.concat(small, F.lit("-"), small, F.lit("-03")))
    place = sum((F.length("w") >= x).cast("int") for x in LENGTHS[1:])
    held = words.where("held").select(F.explode(forms).alias("w")).where(F.regexp_extract("w", TOKEN, 0) == F.col("w"))
    reached = held.groupBy(place.alias("at")).agg(F.percentile_approx(ratio(F.col("w"), out), 1 - FALSE_SHARE), F.count("*")).collect()
    cuts = {r[0]: r[1] for r in reached if r[2] >= ENOUGH}
    out.cuts = tuple(max(0.0, cuts.get(i, THRESHOLD) + 1e-9) for i in range(len(LENGTHS)))
    return out


def scan(docs: DataFrame, model: list[float], text_col: str = "text", prefix: str = "") -> DataFrame:
    """The input's columns with n_assign, n_access, n_hex, base_sha256, spans (``prefix`` before each name; columns that
    are called so are replaced).

    Base spans follow the contract's patterns; words that look like keys join them as ``markov`` spans where their
    mean log-likelihood ratio reaches the threshold of their length and they overlap no base span. Projections only: no shuffle, no
    Python. Defined cases: null and empty texts have no spans; null ids, repeated rows and extra columns come back
    as they are; an empty table gives an empty result.
    """
    names = [prefix + n for n in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")]
    df = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names])
    a, b, c, m, base = (fresh(df.columns, f"found_{n}") for n in ("assign", "access", "hex", "markov", "base"))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    def kind(spans: Column, name: str, rank: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["at"].alias("at"), F.lit(rank).alias("rank"), F.lit(name).alias("kind"), s["end"].alias("end")))

    cuts = getattr(model, "cuts", KeyModel.cuts)
    marks = F.filter(_located(text, TOKEN), lambda s: ratio(s["v"], model) >= cut_of(F.length(s["v"]), cuts))
    assign = F.filter(_located(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["v"], ASSIGN, 2)) >= 8)
    access = F.filter(_located(text, ACCESS), lambda s: F.length(s["v"]) >= 16)
    out = df.select("*", kind(assign, "assign", 0).alias(a), kind(access, "access", 1).alias(b), kind(_located(text, HEX), "hex", 2).alias(c), marks.alias(m))
    out = out.withColumn(base, F.array_sort(F.concat(a, b, c)))
    apart = F.filter(m, lambda s: ~F.exists(base, lambda b: (b["at"] < s["end"]) & (b["end"] > s["at"])))
    say = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["at"].cast("string"), s["end"].cast("string"))), ",")
    values = [*(F.size(x).cast("long") for x in (a, b, c)), F.sha2(say(F.col(base)), 256), say(F.array_sort(F.concat(base, kind(apart, "markov", 3))))]
    return out.select(*[F.col(f"`{x}`") for x in df.columns], *(v.alias(n) for v, n in zip(values, names, strict=True)))


def holds_secret(text: Column, model: list[float]) -> Column:
    """Whether scan() finds any span in a text; null holds none.

    For filters. One on the spans of scan() is pushed below its projections, which puts the base patterns into the
    lambda over the words that look like keys: the whole text is then searched again for each such word. Here nothing is
    located, and a text is searched once for each pattern, up to the first that finds something. Marked words count
    only where they overlap no base span, but where there is a base span the answer is yes anyway.
    """
    text = F.coalesce(text, F.lit(""))
    matches = lambda pattern, group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    cuts = getattr(model, "cuts", KeyModel.cuts)
    access = text.rlike(r"AKIA[A-Z0-9]{12}")  # a match of 16 characters or more, as matches take all of a run
    assign = (text.contains(":") | text.contains("=")) & F.exists(matches(ASSIGN, 2), lambda v: F.length(v) >= 8)
    return access | assign | text.rlike(HEX) | F.exists(matches(TOKEN, 0), lambda w: ratio(w, model) >= cut_of(F.length(w), cuts))


def op9_markov_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs, train(docs)).drop("text")
