"""Toxicity by weak supervision.

Voters are words, word beginnings and numbers of words with one beginning, found from counts over all labelled rows that may be learnt from, and a few
patterns; the annotator is one more. Each votes toxic or abstains, and an absence voter votes clean where no other votes. A generative label model, fitted by expectation
maximisation on a bounded sample, estimates how often each voter speaks on toxic and on clean texts; voters that speak
together more than the label explains are correlated, and their evidence is shared out by the strength of their correlations.
Its posteriors are the labels that a linear classifier over the voters and further associated terms learns; a logistic scaling
on the labelled sample calibrates the scores. Labels, language, source and doc_id never enter a score.

Labels come only from rows whose crc32(doc_id as text) mod 4 is not 2. FIT_ROWS bounds the labelled rows that the models are
fitted on, those with the smallest hashes; counts of terms cover all labelled rows that may be learnt from.

Defined results: null text counts as empty; empty texts get the score of no feature; a null doc_id is not held out; repeated
rows are scored each; labels of a repeated doc_id are averaged, and ties count as toxic; without labels every score is 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared as S

FIT_ROWS = 20_000
HELD_OUT, FOLDS, THRESHOLD = 2, 4, 0.3
#: Terms with the strongest association, either way, voters among them, and the log likelihood ratio that a term needs.
TERMS, VOTERS, EVIDENCE = 1500, 300, 20.0
PREFIXES = (4, 5, 6, 7)
#: So many different words with one beginning are a term of their own.
MANY = (2, 3, 5)
WORD = re.compile(r"[^\W\d_]+")
#: Further voters. Fixed values.
PATTERNS = {"!shout": re.compile(r"\b[A-Z]{4,}\b.*!{2}"), "!censored": re.compile(r"\b[A-Za-z]+[*@#$]{2,}[A-Za-z]*\b"), "!youare": re.compile(r"\byou(?:'re| are) (?:an? )?[a-z]+", re.I)}
REMEMBERED = 500_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def terms(text: str) -> set[str]:
    """Words, word beginnings (with a final ~), numbers of words with one beginning and patterns that a text has."""
    words = set(WORD.findall(text.lower()))
    begins = Counter(f"{w[:n]}~" for w in words for n in PREFIXES if len(w) > n)
    return words | set(begins) | {f"{t}{m}" for t, k in begins.items() if k > 1 for m in MANY if k >= m} | {name for name, pattern in PATTERNS.items() if pattern.search(text)}


def _term_rows(texts: DataFrame) -> DataFrame:
    """Rows (term, toxic, n): in how many texts of either label a task has seen a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            got = pa.record_batch([pa.array(list(seen)), pa.array([x[1] for x in seen.values()], pa.int64()), pa.array([x[0] for x in seen.values()], pa.int64())], names=["term", "toxic", "clean"])
            seen.clear()
            return got

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for t in terms(text):
                    seen.setdefault(t, [0, 0])[toxic] += 1
                if len(seen) > REMEMBERED:
                    yield out()
        yield out()

    return texts.mapInArrow(run, "term string, toxic long, clean long")


class Model:
    """Weights of terms; scores texts."""

    def __init__(self, names: list[str], weights: np.ndarray, bias: float) -> None:
        self.names, self.weights, self.bias = names, weights, bias
        self.index = {n: i for i, n in enumerate(names)}
        self.counted = {n.rstrip("0123456789") for n in names if n[-1].isdigit()}
        self.words: dict[str, tuple[tuple[int, ...], tuple[str, ...]]] = {}

    def features(self, text: str) -> list[int]:
        """Numbers of the model's terms in a text."""
        if len(self.words) > REMEMBERED:
            self.words.clear()
        out, begins, words, index = set(), [], self.words, self.index
        for w in set(WORD.findall(text.lower())):
            got = words.get(w)
            if got is None:
                own = [f"{w[:n]}~" for n in PREFIXES if len(w) > n]
                got = words[w] = tuple(index[t] for t in (w, *own) if t in index), tuple(t for t in own if t in self.counted)
            if got[0]:
                out.update(got[0])
            if got[1]:
                begins += got[1]
        for t, k in Counter(begins).items():
            out.update(index[f"{t}{m}"] for m in MANY if k >= m and f"{t}{m}" in index)
        out.update(index[name] for name, pattern in PATTERNS.items() if name in index and pattern.search(text))
        return sorted(out)

    def score(self, text: str) -> float:
        z = self.bias + float(self.weights[self.features(text)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Posterior probabilities of toxic for rows of votes (0 or 1).

    Expectation maximisation over two classes from the posteriors `start`. A voter's log likelihood ratio counts by the inverse
    of the sum of its correlations, given the class, with all voters: a group of voters that speak as one counts as one.
    """
    p = start.copy()
    for step in range(rounds):
        prior = np.clip(p.mean(), 1e-4, 0.9999)
        one = (p @ votes + 0.05) / (p.sum() + 1)
        zero = ((1 - p) @ votes + 0.005) / ((1 - p).sum() + 1)
        if step % 10 == 0:
            rest = votes - np.outer(p, one) - np.outer(1 - p, zero)
            sd = np.sqrt((rest**2).mean(0)) + 1e-9
            together = np.clip((rest.T @ rest) / len(votes) / np.outer(sd, sd), 0, 1)
            np.fill_diagonal(together, 1)
            share = 1 / np.where(together > 0.3, together, 0).sum(0)
        z = np.log(prior / (1 - prior)) + votes @ (share * np.log(one / zero)) + (1 - votes) @ (share * np.log((1 - one) / (1 - zero)))
        new = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        if np.abs(new - p).max() < 1e-4:
            return new
        p = new
    return p


def fit_linear(rows: list[list[int]], target: np.ndarray, n: int, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient steps, with a small penalty."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    to = np.concatenate([np.array(r, np.int64) for r in rows]) if len(at) else np.zeros(0, np.int64)
    scale = 1 / np.sqrt(np.bincount(to, minlength=n) + 20.0) * np.sqrt(len(rows))
    w, v, bias, vb = np.zeros(n), np.zeros(n), -2.0, 0.0
    per_row = max(1.0, np.bincount(at, weights=scale[to] ** 2 if len(to) else None, minlength=len(rows)).mean()) if len(at) else 1.0
    rate = 4 / (1 + per_row)
    for _ in range(rounds):
        z = bias + np.bincount(at, weights=(w * scale)[to], minlength=len(rows))
        g = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - target
        v = 0.9 * v - rate * (np.bincount(to, weights=g[at], minlength=n) * scale / len(rows) + 1e-5 * w)
        vb = 0.9 * vb - rate * g.mean()
        w, bias = w + v, bias + vb
    return w * scale, float(bias)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    own = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    own = S.materialize(own, "labels")
    texts = S.join_small(docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), own, "doc_id", "inner")
    totals = {r.toxic: r["count"] for r in own.join(docs.select("doc_id"), "doc_id", "left_semi").groupBy("toxic").count().collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos or not neg:
        return Model([], np.zeros(0), -40.0)
    counted = _term_rows(texts.select("text", "toxic")).groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where("toxic + clean >= 3")
    odds = F.log((F.col("toxic") + 0.5) / (pos + 1) / ((F.col("clean") + 0.5) / (neg + 1)))
    share, base = F.col("toxic") / (F.col("toxic") + F.col("clean")), pos / (pos + neg)
    part = lambda n, ratio: F.when(F.col(n) > 0, F.col(n) * F.log(ratio)).otherwise(0.0)
    evidence = 2 * (part("toxic", share / base) + part("clean", (1 - share) / (1 - base)))
    rows = counted.withColumn("odds", odds).withColumn("evidence", evidence).where(F.col("evidence") >= EVIDENCE).orderBy(F.desc("evidence"), "term").limit(TERMS).collect()
    names = [r.term for r in rows]
    voters = [i for i, r in enumerate(rows) if r.odds > 2][:VOTERS]
    model = Model(names, np.zeros(len(names)), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(1), pa.array([model.features(t) for t in batch.column(0).to_pylist()], pa.list_(pa.int32()))], names=["toxic", "features"])

    chosen = S.materialize(own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS).select("doc_id"), "fit-rows")
    sample = S.join_small(texts, chosen, "doc_id", "left_semi").select("text", "toxic").mapInArrow(run, "toxic int, features array<int>").toPandas()
    sets = [list(x) for x in sample["features"]]
    truth = sample["toxic"].to_numpy(np.float64)
    if not len(truth):
        return Model([], np.zeros(0), -40.0)
    spot = {v: k for k, v in enumerate(voters)}
    votes = np.zeros((len(sets), len(voters) + 2))
    for i, s in enumerate(sets):
        for f in s:
            if f in spot:
                votes[i, spot[f]] = 1
    votes[:, -1] = votes[:, :-2].sum(1) == 0  # the absence voter
    votes[:, -2] = truth  # the annotator is a voter, too
    posterior = label_model(votes, 0.1 + 0.8 * truth)
    weights, bias = fit_linear(sets, posterior, len(names))
    z = np.array([bias + weights[s].sum() for s in sets])
    a, b = 1.0, 0.0
    for _ in range(200):  # logistic scaling
        g = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40))) - truth
        a, b = a - 0.05 * float((g * z).mean()) - 0.002 * (a - 1), b - 0.5 * float(g.mean())
    return Model(names, weights * a, bias * a + b)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted)."""
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([model.score(t) for t in batch.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, all columns, without those that are predicted toxic."""
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            yield batch.filter(pa.array([model.score(t or "") < THRESHOLD for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
