"""Personal data by boosted trees over candidate spans.

Fixed rules give the base spans: e-mail addresses, IPv4 addresses, card and phone numbers. High-recall generators propose more,
overlapping spans (obfuscated addresses, numbers without a country code, IPv6, oddly cut card numbers, identity and bank account
numbers, keys, tokens and passwords). Boosted
trees score each proposal from its format and its context; the scores are calibrated on held-out examples and a threshold for
each kind selects spans. Of overlapping selected spans the likeliest stays, and none may touch a base span. The trees are fitted
once, on the driver, from examples that a seeded generator writes: personal data and look-alikes (versions, dates, prices, times,
order numbers, checksums) in prose. What a span is proposed for depends on the span and its neighbours alone.

Defined results: null counts as empty; offsets are code points, the end exclusive; base spans of one kind do not overlap, those
of different kinds may; rows repeat as given; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "ssn", "iban", "secret")
#: The rules of the base spans. Fixed values.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile("[^0-9]+")
#: The generators of further spans; of e-mail addresses the part from the sign on, the part before is read back from there.
GENERATORS = {
    "email": re.compile(r" ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{1,64}(?:(?: ?(?:\[dot\]|\(dot\)| dot ) ?|\.)[A-Za-z0-9-]{1,24}){1,3}", re.I),
    "ip": re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])|(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Za-z:])"),
    "card": re.compile(r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ ./-]{0,2}[0-9]){12,18}(?![ -]?[0-9])"),
    "phone": re.compile(r"(?<![0-9+.-])(?:00[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?[ ./-][0-9]{3,4}[ .-]?[0-9]{2,4}(?:[ .-][0-9]{2,4})?(?![0-9-])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "secret": re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}"),
}
ASSIGNED = re.compile(r"(?:token|secret|key|passw(?:or)?d|pwd)[\"']?\s{0,3}[:=]\s{0,3}[\"']?([^\s\"']{8,64})", re.I)
CUES = {
    "email": ("mail", "contact", "write", "reach"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "mastercard", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "contact", "dial"),
    "ssn": ("ssn", "social", "security"),
    "iban": ("iban", "account", "bank", "konto"),
    "secret": ("token", "secret", "key", "passw", "pwd", "auth", "credential"),
}
AGAINST = ("version", "order", "isbn", "page", "vol", "date", "price", "id", "no", "ref", "invoice", "serial", "lines", "pp", "score", "commit", "checksum", "sha", "digest")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost spans that do not overlap, for each kind; those that fail its test are dropped."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:  # from each @ back over the local part; the same matches as a scan from the left, in linear time
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    for m in IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = DIGITS.sub("", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(DIGITS.sub("", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def proposals(text: str, digits: bool) -> list[tuple[str, int, int]]:
    """Spans that may be personal; a pattern is only tried on texts that hold what it cannot do without."""
    out = []
    low = text.lower()
    if any(x in low for x in (" at ", "[at]", "(at)")):
        for m in GENERATORS["email"].finditer(text):
            start = m.start()
            while start and m.start() - start < 64 and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                out.append(("email", start, m.end()))
    if digits:
        for kind, pattern in GENERATORS.items():
            if kind == "secret":
                out += [(kind, *m.span()) for m in pattern.finditer(text) if any(c.isdigit() for c in m.group()) and any(c.isalpha() for c in m.group())]
            elif kind != "email":
                out += [(kind, *m.span()) for m in pattern.finditer(text)]
    if any(x in low for x in ("token", "secret", "key", "passw", "pwd")):
        out += [("secret", *m.span(1)) for m in ASSIGNED.finditer(text)]
    return sorted(set(out), key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a span."""
    span, before, after = text[start:end], text[max(0, start - 40) : start].lower(), text[end : end + 20].lower()
    groups = [len(g) for g in re.findall("[0-9]+", span)]
    words = re.findall("[a-zà-ÿ]+", before)[-4:]
    n = sum(groups)
    kinds = [c.isdigit() + 2 * c.isalpha() for c in span]
    shares = np.unique([ord(c) for c in span], return_counts=True)[1] / max(1, len(span))
    return [
        KINDS.index(kind), len(span), n, len(groups), groups[0] if groups else 0, groups[-1] if groups else 0, max(groups, default=0),
        sum(c.isalpha() for c in span), span.count(" "), span.count("-"), span.count("."), span.count("/"), span.count("("), span.count(":"),
        float("[at]" in span.lower() or "(at)" in span.lower()), float("dot" in span.lower()),
        float(any(any(w.startswith(c) for c in CUES.get(kind, ())) for w in words)), float(any(w in AGAINST for w in words)),
        float(before[-1:] in ("", " ", "\n", "(", ":")), float(after[:1] in ("", " ", "\n", ",", ".", ")", ";")), float(before.rstrip()[-1:] in (":", "=")),
        float("$" in before[-3:] or "€" in before[-3:] or "€" in after[:3]), float(luhn(DIGITS.sub("", span)) if n >= 12 else 0),
        float(bool(groups) and 1900 <= int(re.findall("[0-9]+", span)[-1][:4] or 0) <= 2100), float(len({*span}) / max(1, len(span))),
        float(-(shares * np.log2(shares)).sum()), sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)), sum(c in "0123456789abcdefABCDEF" for c in span) / max(1, len(span)),
        float(before[-1:] in ("'", '"')), n / max(1, len(span)),
    ]


class Trees:
    """Gradient boosting of depth-3 trees on the logistic loss, over binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.2) -> None:
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.03, 0.97, 24))) for j in range(x.shape[1])]
        self.bias, self.trees = float(np.log(y.mean() / (1 - y.mean()))), []
        z = np.full(len(y), self.bias)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-z))
            tree = self._grow(x, p - y, p * (1 - p), np.arange(len(y)), 3, rate)
            self.trees.append(tree)
            z += np.array([self._leaf(tree, row) for row in x])

    def _grow(self, x, g, h, rows, depth, rate):
        score = lambda a, b: a * a / (b + 1.0)
        value = -rate * g[rows].sum() / (h[rows].sum() + 1.0)
        best = (1e-3, None, None)
        if depth and len(rows) > 20:
            for j, cuts in enumerate(self.cuts):
                v = x[rows, j]
                for c in cuts:
                    left = v <= c
                    gl, hl = g[rows][left].sum(), h[rows][left].sum()
                    gain = score(gl, hl) + score(g[rows].sum() - gl, h[rows].sum() - hl) - score(g[rows].sum(), h[rows].sum())
                    if gain > best[0] and left.any() and not left.all():
                        best = (gain, j, c)
        if best[1] is None:
            return value
        left = x[rows, best[1]] <= best[2]
        return best[1], float(best[2]), self._grow(x, g, h, rows[left], depth - 1, rate), self._grow(x, g, h, rows[~left], depth - 1, rate)

    @staticmethod
    def _leaf(node, row) -> float:
        while isinstance(node, tuple):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        return node

    def raw(self, row: list[float]) -> float:
        return self.bias + sum(self._leaf(t, row) for t in self.trees)


def examples(seed: int, n: int) -> list[tuple[str, str, int, int, int]]:
    """(text, kind, start, end, label) of proposals in written examples."""
    rng, out = random.Random(seed), []
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice(["an", "er", "the", "on", "re", "in", "ou", "st", "ha", "ti", "ly", "es"]) for _ in range(rng.randint(1, 3)))
    prose = lambda k: " ".join(word() for _ in range(k))
    hexes = lambda k=4: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(k))

    def card() -> str:
        number = d(15)
        number += next(c for c in "0123456789" if luhn(number + c))
        return rng.choice([".", "  ", "/", ". "]).join(number[i : i + 4] for i in (0, 4, 8, 12))

    def secret() -> str:
        value = rng.choice([hexes(40), hexes(32), hexes(64), mixed(24), mixed(40), mixed(rng.randint(10, 20)), f"AKIA{mixed(16).upper()}"])
        value = value.upper() if rng.random() < 0.1 else value
        return rng.choice([f'token = "{value}"', f"api_key={value}", f"secret: {value}", f"password = '{value}'", f'"key": "{value}"', value])

    good = {
        "email": lambda: f"{word()}.{word()} {rng.choice(['[at]', '(at)', 'at'])} {word()} {rng.choice(['dot', '[dot]'])} {rng.choice(['com', 'org', 'net'])}",
        "ip": lambda: rng.choice([":".join(hexes() for _ in range(8)), f"2001:{hexes()}::{hexes()}", f"fe80::{hexes()}:{hexes()}:{hexes()}"]),
        "card": card,
        "secret": secret,
        "phone": lambda: rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(3)}/{d(4)} {d(3)}", f"{d(3)} {d(3)} {d(4)}", f"{d(3)}.{d(3)}.{d(4)}"]),
        "ssn": lambda: f"{d(3)}-{d(2)}-{d(4)}",
        "iban": lambda: f"{rng.choice(['DE', 'FR', 'ES', 'GB'])}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)}",
    }
    bad = {
        "email": lambda: f"{word()} at {word()} {rng.choice(['.', ' dot '])}{word()}",
        "ip": lambda: rng.choice([":".join(d(2) for _ in range(5)), f"{d(2)}::{d(1)}"]),
        "card": lambda: rng.choice([".".join(d(4) for _ in range(4)), "/".join(d(2) for _ in range(7)), "  ".join(d(4) for _ in range(4))]),
        "secret": lambda: rng.choice([f"commit {hexes(40)}", f"checksum: {hexes(64)}", f"sha {hexes(40)}", f"{word()}_{word()}_{word()}_{word()}{d(1)}", f"{word()}-{word()}-{word()}-{d(4)}-{d(2)}", f"/{word()}/{word()}/{word()}/{d(4)}", f"key = {word()}{word()}{word()}", f"password: {word()}{word()}"]),
        "phone": lambda: rng.choice([f"{rng.randint(1950, 2030)}-{rng.randint(1000, 1300)}", f"{d(3)} {d(3)}", f"{d(4)}-{d(4)}", f"{d(3)} {d(3)} {d(3)}", f"{d(2)}.{d(3)}.{d(3)}", f"{d(2)}/{d(4)}"]),
        "ssn": lambda: f"{d(3)}-{d(2)}-{d(4)}",
        "iban": lambda: f"AB{d(2)} {word().upper()[:4]:A<4} {d(4)} {d(4)}",
    }
    while len(out) < n:
        kind, label = rng.choice(list(good)), rng.random() < 0.5
        cue = f"{rng.choice(CUES[kind])}{rng.choice(['', ':', ' is'])} " if label and kind != "secret" and (kind == "ssn" or rng.random() < 0.7) else f"{rng.choice(AGAINST)} " if not label and (kind == "ssn" or rng.random() < 0.5) else ""
        money = "$" if not label and rng.random() < 0.1 else ""
        text = f"{prose(rng.randint(1, 5))} {cue}{money}{(good if label else bad)[kind]()}{rng.choice(['', ',', '.', ''])} {prose(3)}"
        out += [(text, k, a, b, int(label and k == kind)) for k, a, b in proposals(text, True)]
    return out


@lru_cache(1)
def model() -> tuple[Trees, tuple[float, float], dict[str, float]]:
    """(trees, calibration, thresholds): the least calibrated score of each kind at which 95 of 100 held-out spans are right."""
    train, rest = examples(1, 3000), examples(2, 2000)
    trees = Trees(np.array([features(*r[:4]) for r in train]), np.array([r[4] for r in train], float))
    z, y = np.array([trees.raw(features(*r[:4])) for r in rest]), np.array([r[4] for r in rest], float)
    a, b = 1.0, 0.0
    for _ in range(300):
        g = 1 / (1 + np.exp(-(a * z + b))) - y
        a, b = a - 0.02 * float((g * z).mean()), b - 0.2 * float(g.mean())
    p = 1 / (1 + np.exp(-(a * z + b)))
    thresholds = {}
    for kind in KINDS:
        own = np.array([r[1] == kind for r in rest])
        right = [t for t in np.arange(0.3, 0.99, 0.02) if (own & (p >= t)).sum() and y[own & (p >= t)].mean() >= 0.95]
        thresholds[kind] = float(right[0]) if right else 1.01
    return trees, (float(a), float(b)), thresholds


def find(text: str, fitted) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, further spans), each by kind and start."""
    digits = any(c in text for c in "0123456789")
    base = base_spans(text) if digits or "@" in text else []
    trees, (a, b), thresholds = fitted
    scored = []
    for kind, start, end in proposals(text, digits):
        p = 1 / (1 + np.exp(-(a * trees.raw(features(text, kind, start, end)) + b)))
        if p >= thresholds[kind]:
            scored.append((-p, start, end, kind))
    taken, more = [(s, e) for _, s, e in base], []
    for _, start, end, kind in sorted(scored):
        if all(end <= s or e <= start for s, e in taken):
            taken.append((start, end))
            more.append((kind, start, end))
    order = lambda x: (KINDS.index(x[0]), x[1], x[2])
    return sorted(base, key=order), sorted(more, key=order)


def spans(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, base, more): arrays of structs (kind, start, end)."""
    fitted = model()
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find(t or "", fitted) for t in batch.column(1).to_pylist()]
            lists = [pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in f[i]] for f in found], pa.list_(kind)) for i in (0, 1)]
            yield pa.record_batch([batch.column(0), *lists], names=["doc_id", "base", "more"])

    one = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, base {one}, more {one}")


def redact(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with every span's place taken by its kind; overlapping spans become one."""
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in found):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def digest(rows: DataFrame) -> DataFrame:
    """Rows of spans() as counts, the base spans' SHA-256 and all spans as text."""
    place = lambda c: F.array_position(F.array(*map(F.lit, KINDS)), c)
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    every = F.transform(F.array_sort(F.transform(F.concat("base", "more"), lambda x: F.struct(place(x["kind"]).alias("k"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    counts = [F.size(F.filter("base", (lambda k: lambda x: x["kind"] == k)(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return rows.select("doc_id", *counts, F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(every).alias("spans"))


def sha256(found: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in found).encode()).hexdigest()
