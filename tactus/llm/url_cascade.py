"""URL rules by a cascade of Bloom filters.

A rule is a host with the start of a path, on an allow or a block list; it fits the host and all its subdomains. The keys that
can match a url are its host suffixes with starts of its path in the rules' lengths. All such keys of the corpus are the
universe. Level 1 holds the listed keys; level 2 the universe's keys that level 1 takes falsely; level 3 the listed keys that
level 2 takes falsely, and so on until no key is left. For a key of the universe, the first level that refuses it tells exactly
whether it is listed, so pages meet small filters, never a join with the lists. Level 1's false positive rate follows the ratio
of listed keys to the universe, so every further level has about as many keys as the lists, however large the corpus.

Defined results: null urls and urls without :// have an empty host and path and fit no rule; of the rules that fit, the longest
wins, block before allow where one key is on both lists; a url that no rule fits is allowed unless a label of its host is on
`bad_labels`; rows repeat as given; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared as S

#: Rules of the registered query, and host labels that are blocked without a rule. Fixed values.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
BAD_LABELS = ("spam-farm", "casino", "malware", "phishing", "xxx")


@dataclass
class Bloom:
    bits: bytearray
    n_bits: int
    n_hashes: int
    salt: int

    @classmethod
    def of(cls, keys: list[str], rate: float, salt: int) -> Bloom:
        n = max(64, math.ceil(len(keys) * -math.log(rate) / math.log(2) ** 2))
        out = cls(bytearray(-(-n // 8)), n, max(1, round(-math.log2(rate))), salt)
        for key in keys:
            for i in out._places(key):
                out.bits[i >> 3] |= 1 << (i & 7)
        return out

    def _places(self, key: str) -> Iterator[int]:
        d = hashlib.blake2b(key.encode("utf-8", "surrogatepass"), digest_size=16, salt=self.salt.to_bytes(4, "little")).digest()
        a, b = int.from_bytes(d[:8], "little"), int.from_bytes(d[8:], "little") | 1
        return ((a + i * b) % self.n_bits for i in range(self.n_hashes))

    def __contains__(self, key: str) -> bool:
        return all(self.bits[i >> 3] >> (i & 7) & 1 for i in self._places(key))


def listed(levels: list[Bloom], key: str) -> bool:
    """Whether a key of the universe is listed: the first refusing level is of even number."""
    for i, level in enumerate(levels):
        if key not in level:
            return i % 2 == 1
    return len(levels) % 2 == 1


def parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path."""
    first = F.locate("://", url)
    rest = F.when(first > 0, url.substr(first + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def candidates(host: str, path: str, lengths: tuple[int, ...]) -> list[str]:
    labels = host.split(".")
    return [f"{'.'.join(labels[i:])}{path[:n]}" for i in range(len(labels)) for n in lengths if n <= len(path)]


def universe(places: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """Distinct keys (key) of all rows (host, path)."""
    suffixes = F.transform(F.sequence(F.lit(1), F.size(F.split("host", r"\."))), lambda i: F.array_join(F.slice(F.split("host", r"\."), i, F.lit(1 << 20)), "."))
    starts = F.array(*(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(F.filter(starts, lambda x: x.isNotNull()), lambda x: F.concat(s, x))))
    return places.select(F.explode(keys).alias("key")).distinct()


def cascade(keys: DataFrame, total: int, on: set[str], off: DataFrame | None = None) -> list[Bloom]:
    """Levels that tell the listed keys `on` from all other keys of the universe.

    Only keys that a level takes falsely come to the driver: about as many as the lists hold, by the choice of level 1's rate.
    """
    here = set(on)
    levels = [Bloom.of(sorted(here), min(0.5, max(1e-9, len(here) / max(1, total))), 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array([k for k in batch.column(0).to_pylist() if k in levels[0] and k not in here], pa.string())], names=["key"])

    false = {r.key for r in keys.mapInArrow(run, "key string").toLocalIterator()}
    wrong, right = false, here
    while wrong:
        levels.append(Bloom.of(sorted(wrong), 0.5, len(levels) + 1))
        wrong, right = {k for k in right if k in levels[-1]}, wrong
    return levels


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, bad_labels: tuple[str, ...] = BAD_LABELS) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict)."""
    host, path = parts(F.col("url"))
    places = pages.select("page_id", host.alias("host"), path.alias("path"))
    lists = {kind: {r for k, r in rules if k == kind} for kind in ("allow", "block")}
    lengths = tuple(sorted({len(r) - r.index("/") for _, r in rules}))
    keys = S.materialize(universe(places, lengths), "url-universe")
    total = keys.count()
    levels = {kind: cascade(keys, total, lists[kind]) for kind in lists}
    labels = S.materialize(places.select(F.explode(F.split("host", r"\.")).alias("key")).distinct(), "url-labels")
    bad = cascade(labels, labels.count(), set(bad_labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, verdicts = [], []
            for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                fits = [(len(k), kind == "block", k, kind) for k in candidates(h, p, lengths) for kind in lists if lists[kind] and listed(levels[kind], k)]
                best = max(fits, default=None)
                found.append(best and best[2])
                verdicts.append(best[3] if best else "block" if any(listed(bad, x) for x in h.split(".")) else "allow")
            yield pa.record_batch([*batch.columns, pa.array(found, pa.string()), pa.array(verdicts)], names=["page_id", "host", "path", "rule", "verdict"])

    return places.mapInArrow(run, f"page_id {dict(places.dtypes)['page_id']}, host string, path string, rule string, verdict string")
