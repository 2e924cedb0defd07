"""Personal data: written base patterns, and further spans chosen by gradient-boosted trees."""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

# The contract's base kinds, in its order. Its patterns are matched piece by piece, so that a long run of
# digits or letters is read once and not once from each of its characters.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED, _PART = re.compile(r"[0-9]+(?:\.[0-9]+)*"), re.compile(r"[0-9]+")
_CARD, _PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of local part, @ and domain: each @ is extended to both sides."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def dotted_quads(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping groups of four numbers joined by dots: a chain of numbers, cut in fours."""
    for chain in _DOTTED.finditer(text):
        if "." in chain[0]:
            parts = list(_PART.finditer(text, chain.start(), chain.end()))
            for i in range(0, len(parts) - 3, 4):
                yield parts[i].start(), parts[i + 3].end()


def spans_of(pattern: re.Pattern):
    return lambda text: (m.span() for m in pattern.finditer(text))


BASE = (("email", emails), ("ip", dotted_quads), ("card", spans_of(_CARD)), ("phone", spans_of(_PHONE)))
# High-recall generators; their spans overlap each other and the base spans.
GENERATORS = ("number", "handle", "address6", "account")
_GROUPS, _LINK = re.compile(r"[0-9]+"), re.compile(r"[\x20().-]{1,2}")
_AT, _DOT = re.compile(r"\x20?[(\[]at[)\]]\x20?"), re.compile(r"\x20?[(\[]dot[)\]]\x20?|\.")
_LABEL = re.compile(r"[A-Za-z0-9-]+")
_COLONS = re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){3,7}(?![0-9A-Fa-f:])")
_ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
#: Digits of a number; letters and digits of an account.
NUMBER, ACCOUNT = (7, 19), (15, 34)
ORDER = {k: i for i, k in enumerate([*(k for k, _ in BASE), *GENERATORS])}
GOOD = re.compile(r"card|visa|tel|phone|call|mobile|ssn|social|iban|account|contact|mail|fax|host|client|peer", re.I)
POOR = re.compile(r"order|invoice|version|isbn|page|sku|part|serial|build|ticket|total|price|euro|usd|id\W*$|no\W*$|#\W*$|\$\W*$", re.I)


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def valid(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in s.split("."))
    if kind == "card":
        return 14 <= len(d := _digits(s)) <= 19 and luhn(d)
    if kind == "phone":
        return 10 <= len(_digits(s)) <= 15
    return True


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed; offsets are code points."""
    out = []
    for kind, find in BASE:
        out += [(a, e, kind) for a, e in find(text) if valid(kind, text[a:e])]
    return sorted(out, key=lambda s: (s[0], ORDER[s[2]]))


def _merged(spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for a, e, _ in spans:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((a, e))
    return out


def numbers(text: str) -> Iterator[tuple[int, int]]:
    """Every run of whole digit groups, one or two of ``space ( ) . -`` between neighbours, of 7 to 19 digits, also with
    the bracket before its first group. A group starts at most 19 of them, so their number grows with the text."""
    groups = [m.span() for m in _GROUPS.finditer(text)]
    for i, (start, _) in enumerate(groups):
        digits, j = 0, i
        while True:
            digits += groups[j][1] - groups[j][0]
            if digits > NUMBER[1]:
                break
            if digits >= NUMBER[0]:
                yield start, groups[j][1]
                if start and text[start - 1] == "(" and ")" in text[start : groups[j][1]]:
                    yield start - 1, groups[j][1]
            j += 1
            if j == len(groups) or not _LINK.fullmatch(text, groups[j - 1][1], groups[j][0]):
                break


def handles(text: str) -> Iterator[tuple[int, int]]:
    """Addresses with a written-out at: the word before it, and the one to five labels of a host behind it."""
    end = 0
    for at in _AT.finditer(text):
        start = at.start()
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        label = _LABEL.match(text, at.end()) if start < at.start() else None
        for _ in range(5):
            dot = _DOT.match(text, label.end()) if label else None
            label = _LABEL.match(text, dot.end()) if dot else None
            if label is None:
                break
            end = label.end()
            yield start, end


def accounts(text: str) -> Iterator[tuple[int, int]]:
    """Two capitals, two digits and groups of capitals and digits, at most a space apart, up to each group's end."""
    for head in _ACCOUNT.finditer(text):
        signs, at = 0, head.start()
        while signs < ACCOUNT[1]:
            group = re.compile(r"\x20?[A-Z0-9]+").match(text, at)
            if group is None:
                break
            signs, at = signs + len(group[0].strip(" ")), group.end()
            if ACCOUNT[0] <= signs <= ACCOUNT[1] and not text[at : at + 1].isalnum():
                yield head.start(), at


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Overlapping spans (start, end, generator); base patterns may take some of them, too."""
    out = [(a, e, "number") for a, e in numbers(text)]
    if "at" in text:
        out += [(a, e, "handle") for a, e in handles(text)]
    if ":" in text:
        out += [(*m.span(), "address6") for m in _COLONS.finditer(text)]
    return out + [(a, e, "account") for a, e in accounts(text)]


def mod97(s: str) -> bool:
    """Whether the letters and digits pass the check of international account numbers."""
    signs = re.sub(r"[^0-9A-Z]", "", s)
    return len(signs) > 4 and int("".join(str(int(c, 36)) for c in signs[4:] + signs[:4])) % 97 == 1


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    """Format of the span and its context of 24 characters; no look at whether a base pattern takes it."""
    s, before, after = text[start:end], text[max(0, start - 24) : start], text[end : end + 8]
    d, sizes = _digits(s), [len(g) for g in _GROUPS.findall(s)] or [0]
    marks = {text[m.end()] for m in _GROUPS.finditer(text, start, end) if m.end() < end}
    return [
        ORDER[kind] - len(BASE), len(s), len(d), len(sizes), max(sizes), min(sizes), s.count(" "), s.count("-"), s.count("."), s.count("("),
        float(luhn(d)) if d else 0.0, len(set(d)), float(d[:1] == "0"), float(13 <= len(d) <= 16), float(bool(re.match(r"(?:19|20)[0-9]{2}\b", s))),
        float(before[-1:].isalnum() or before[-1:] in "_/+=#$"), float(after[:1].isalnum() or after[:1] in "_/=%"), float(before.endswith("+")), float(bool(re.match(r"[.,][0-9]", after))),
        float(bool(GOOD.search(before))), float(bool(POOR.search(before))), s.count(":"), float(sizes[-1] == 4), float(len(set(sizes)) == 1),
        sizes[0], sizes[-1], len(marks), float(sizes == [3, 3, 4]), float(sizes in ([4, 4, 4, 4], [4, 6, 5], [16])), float(sizes == [3, 2, 4]), float(mod97(s)) if kind == "account" else 0.0,
        float(bool(re.search(r"[0-9][\x20().-]{1,2}$", before))), float(bool(re.match(r"[\x20().-]{1,2}[0-9]", after))), float(text[start - 1 : start] == "("), float(bool(re.match(r"(?:\.|\x20?[(\[]dot)", after))),
        float(bool(re.search(r"(?:dot[)\]]\x20?|\.)[a-z]{2,6}$", s))),
    ]


class BoostedTrees:
    """Second-order gradient boosting of depth-2 trees for logistic loss, on quantile splits."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.25, penalty: float = 1.0):
        self.splits = [(f, t) for f in range(x.shape[1]) for t in np.unique(np.quantile(x[:, f], np.linspace(0, 1, 17)[:-1]))]
        b = self._tests(x)
        self.trees, score = [], np.zeros(len(y))
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)

            def split(rows, g=g, h=h):
                gr, hr, br = g[rows], h[rows], b[rows]
                gl, hl = br.T @ gr, br.T @ hr
                gain = gl**2 / (hl + penalty) + (gr.sum() - gl) ** 2 / (hr.sum() - hl + penalty)
                return int(gain.argmax())

            root = split(np.arange(len(y)))
            tree = [root]
            for side in (True, False):
                rows = np.flatnonzero(b[:, root] == side)
                k = split(rows) if len(rows) else 0
                leaves = [rate * g[q].sum() / (h[q].sum() + penalty) for q in (rows[b[rows, k]], rows[~b[rows, k]])]
                tree.append((k, leaves[0], leaves[1]))
            self.trees.append(tree)
            score += self._one(tree, b)

    def _tests(self, x: np.ndarray) -> np.ndarray:
        return np.stack([x[:, f] > t for f, t in self.splits], 1)

    @staticmethod
    def _one(tree, b):
        root, (k1, a1, b1), (k2, a2, b2) = tree
        return np.where(b[:, root], np.where(b[:, k1], a1, b1), np.where(b[:, k2], a2, b2))

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = self._tests(x)
        return 1 / (1 + np.exp(-sum(self._one(t, b) for t in self.trees)))


def labelled_samples(n: int = 6000, seed: int = 7) -> list[tuple[str, int, int, str, int]]:
    """(text, start, end, kind, label): every candidate of texts with personal numbers, accounts and handles, alone or in
    lists, or look-alikes, in neutral or telling contexts. Spans that take a part of one, or parts of two, are labelled 0.
    Cards pass Luhn and accounts their check digits; numbers of their form that do not are look-alikes."""
    r = random.Random(seed)
    dig = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    def card(good: bool) -> str:
        while luhn(d := dig(16)) != good:
            pass
        mark = r.choice(["", "", " ", "-"])
        return mark.join(d[i : i + 4] for i in range(0, 16, 4))

    word = lambda: "".join(r.choice("aeioustrnlmdh") for _ in range(r.randint(2, 8)))

    def account(good: bool) -> str:
        body = r.choice(["", "ABCD", "WEST"]) + dig(r.choice([10, 12, 14, 18]))
        check = 98 - int("".join(str(int(c, 36)) for c in body + "DE00")) % 97
        flat = f"DE{(check if good else (check + r.randint(1, 90)) % 97):02}{body}"
        return flat if r.random() < 0.5 else " ".join(flat[i : i + 4] for i in range(0, len(flat), 4))

    def handle() -> str:
        local = r.choice([word(), f"{word()}.{word()}", f"{word()}_{word()}", f"{word()}{dig(2)}", f"{word()}.{word()}.{word()}"])
        at, dot = r.choice(["(at)", " (at) ", "[at]", " [at] "]), r.choice([".", " (dot) ", "(dot)", "[dot]"])
        return local + at + r.choice(["", word() + dot]) + word() + dot + r.choice(["com", "org", "de", "net", "info"])

    def phone() -> str:
        a, b, c = dig(3), dig(3), dig(4)
        return r.choice([f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"0{dig(2)} {dig(4)} {dig(4)}", f"0{dig(4)} {dig(6)}"])

    def personal():
        return r.choice([
            lambda: card(True), lambda: card(True), phone, phone, phone, lambda: f"{dig(3)}-{dig(2)}-{dig(4)}", handle, handle,
            lambda: ":".join(f"{r.randrange(65536):x}" for _ in range(8)), lambda: account(True),
        ])()

    def other():
        return r.choice([
            lambda: card(False), lambda: card(False), lambda: dig(r.randint(7, 12)), lambda: f"20{dig(2)}-{dig(2)}-{dig(2)}", lambda: f"{dig(2)}.{dig(2)}.20{dig(2)}", lambda: f"{dig(3)}.{dig(3)}.{dig(3)}", lambda: f"{dig(1)}.{dig(7)}",
            lambda: dig(r.randint(17, 19)), lambda: f"{dig(2)} {dig(2)} {dig(2)} {dig(2)}", lambda: f"{dig(3)}-{dig(1)}-{dig(3)}-{dig(5)}-{dig(1)}", lambda: f"{dig(2)}:{dig(2)}:{dig(2)}:{dig(2)}", lambda: f"20{dig(2)} 20{dig(2)} 20{dig(2)}",
            lambda: account(False), lambda: f"{dig(4)} {dig(4)} {dig(4)}", lambda: " ".join(dig(r.randint(1, 5)) for _ in range(r.randint(3, 9))), lambda: f"20{dig(2)}-{dig(2)}-{dig(2)} {dig(2)}.{dig(2)}", lambda: f"{word()} (at) {word()}", lambda: f"look[at]{word()}",
            lambda: f"{dig(1)}.{dig(3)}.{dig(3)}", lambda: f"{dig(2)}-{dig(4)}-{dig(3)}", lambda: f"{dig(6)}-{dig(2)}", lambda: f"{word()}-{dig(3)}-{dig(5)}",
        ])()

    out = []
    while len(out) < n:
        label = r.random() < 0.5
        said = [personal() if label else other() for _ in range(r.choice([1, 1, 1, 2, 3]))]
        cue = r.choice(["card", "phone", "tel", "contact", "ssn", "account", "mail"]) if label and r.random() < 0.3 else r.choice(["order no", "invoice #", "version", "isbn", "total $"]) if not label and r.random() < 0.3 else word()
        text, glued = f"{word()} {word()} {cue} ", not label and r.random() < 0.2
        text += "_" * glued
        spans = set()
        for k, s in enumerate(said):
            text += r.choice([" ", ", ", "; ", " or "]) * (k > 0)
            spans.add((len(text), len(text) + len(s)))
            text += s
        text += (" " if r.random() < 0.8 else ". ") + word()
        out += [(text, a, b, kind, int(label and (a, b) in spans)) for a, b, kind in candidates(text)]
    return out


def train(precision: float = 0.98) -> tuple[BoostedTrees, dict[int, float]]:
    """Trees from two thirds of the samples; per generator the least threshold that keeps ``precision`` on the rest
    (none below one half; above 1 where no threshold does)."""
    data = labelled_samples()
    x = np.array([features(*d[:4]) for d in data])
    y = np.array([d[4] for d in data], float)
    fit = np.arange(len(y)) % 3 != 0
    model = BoostedTrees(x[fit], y[fit])
    p, truth, kind = model.predict(x[~fit]), y[~fit], x[~fit][:, 0]
    cut = {}
    for k in range(len(GENERATORS)):
        o = np.argsort(-p[kind == k])
        s, t = p[kind == k][o], truth[kind == k][o]
        ok = np.flatnonzero(np.cumsum(t) / np.arange(1, len(t) + 1) >= precision)
        cut[k] = max(0.5, float(s[ok[-1]])) if len(ok) else 2.0
    return model, cut


def find_pii(docs: DataFrame, text_col: str = "text", redact: bool = False) -> DataFrame:
    """The input's columns with n_email, n_ip, n_card, n_phone, base_sha256, spans (and redacted).

    Base spans follow the contract's patterns. Generators then propose further spans, boosted trees score them by
    format and context, and those above their generator's calibrated threshold are taken, best first, where they
    overlap nothing taken before. Everything happens inside one map over whole texts; no shuffle.

    Defined cases: null or empty text has no spans; null ids, repeated rows and extra columns come back as they are
    (columns named as results are replaced); an empty table gives an empty result.
    """
    model, cut = train()
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps((model, cut)))
    added = [("n_email", T.LongType()), ("n_ip", T.LongType()), ("n_card", T.LongType()), ("n_phone", T.LongType()), ("base_sha256", T.StringType()), ("spans", T.StringType())]
    added += [("redacted", T.StringType())] if redact else []
    names = [n for n, _ in added]
    df = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names])
    at = df.columns.index(text_col)

    def scan(batches):
        trees, cuts = cloudpickle.loads(shared.value)
        for b in slices(batches):
            texts = [t or "" for t in b.column(at).to_pylist()]
            base = [base_spans(t) for t in texts]
            extra: list[list] = [[] for _ in texts]
            found = [(i, c) for i, t in enumerate(texts) for c in candidates(t)]
            if found:
                p = trees.predict(np.array([features(texts[i], *c) for i, c in found]))
                sure = [(i, c, s) for (i, c), s in zip(found, p, strict=True) if s >= cuts[ORDER[c[2]] - len(BASE)]]
                taken = {i: sorted(_merged(base[i])) for i, _, _ in sure}
                for i, c, _ in sorted(sure, key=lambda z: (z[0], -z[2], z[1][0] - z[1][1], z[1])):
                    k = bisect.bisect(taken[i], (c[0], c[1]))
                    if (k == 0 or taken[i][k - 1][1] <= c[0]) and (k == len(taken[i]) or taken[i][k][0] >= c[1]):
                        taken[i].insert(k, (c[0], c[1]))
                        extra[i].append(c)
            out: list[list] = [[] for _ in names]
            for t, own, more in zip(texts, base, extra, strict=True):
                kinds = [k for _, _, k in own]
                every = sorted(own + more, key=lambda s: (s[0], ORDER[s[2]]))
                say = lambda spans: ",".join(f"{k}:{a}:{e}" for a, e, k in spans)
                row = [*(kinds.count(k) for k, _ in BASE), hashlib.sha256(say(own).encode()).hexdigest(), say(every)]
                if redact:
                    parts, end = [], 0
                    for a, e, k in every:
                        if e > end:
                            parts += [t[end : max(a, end)], f"[{k}]"]
                            end = e
                    row.append("".join([*parts, t[end:]]))
                for held, v in zip(out, row, strict=True):
                    held.append(v)
            cols = [pa.array(v, pa.int64() if n.startswith("n_") else pa.string()) for n, v in zip(names, out, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *names])

    return df.mapInArrow(scan, T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in added)]))


def op7_boosted_pii(spark, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
