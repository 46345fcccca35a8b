"""Benchmark decontamination by SimHash of item-sized windows.

Every benchmark item has a 64-bit SimHash of its words, weighted by their lengths. Windows of a document with as many words as
an item are fingerprinted the same way. Fingerprints fall into four 16-bit blocks; the index lists an item under every block
value within 3 bits of its own, so every pair within 15 bits meets in a block at least. Candidates are then verified exactly:
the weight of the common shingles of window and item, of five words each and weighted by their characters, has to be `least`
of the weight of all their shingles. Windows without any shingle of the benchmark cannot pass and are not fingerprinted.

The benchmark goes to the executors in blocks of at most BLOCK_ITEMS items, one pass over the documents for each block, so what
a task holds is bounded whatever the benchmark's size.

Defined results: A-Z count as a-z; items without words match nothing; items of fewer than five words are one shingle; a text that
is shorter than an item is a window by itself; null and empty texts hold nothing; repeated rows are reported each; rows with a null doc_id are reported with it; extra columns are
ignored. Of the places where a document holds an item, the most similar, then the first, is reported.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as S

WIDTH, LEAST = 5, 0.8
BLOCK_RADIUS, RADIUS = 3, 15
BLOCK_ITEMS = 4096
U64 = np.uint64
FOUND = "doc_id long, item_id long, start_word long, n_words long, similarity double"


def words_of(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, lengths in bytes) of the words of each text."""
    out = []
    for _, raw, offsets in S.chunks(pa.array(texts, pa.string())):
        hashes, starts, ends, at = S.word_hashes(raw, offsets)
        out += [(hashes[a:b], (ends - starts)[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


def simhash(hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHashes of the windows of `size` words that begin at `starts`."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
    total = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum((2 * bits - 1) * weights[:, None].astype(np.int32), axis=0, out=total[1:])
    return np.packbits(total[starts + size] > total[starts], axis=1, bitorder="little").view(U64).ravel()


class Index:
    """A block of the benchmark."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        rows = [(i, h, w) for (i, _), (h, w) in zip(items, words_of([t for _, t in items]), strict=True) if len(h)]
        self.ids = [i for i, _, _ in rows]
        self.size = np.array([len(h) for _, h, _ in rows], np.int64)
        self.shingles = [self.weighted(h, w, min(WIDTH, len(h))) for _, h, w in rows]
        self.fp = np.array([simhash(h, w, np.zeros(1, np.int64), len(h))[0] for _, h, w in rows], U64)
        self.widths = sorted({min(WIDTH, int(n)) for n in self.size})
        self.known = {k: np.unique(np.concatenate([s[0] for s, n in zip(self.shingles, self.size, strict=True) if min(WIDTH, n) == k])) for k in self.widths}
        masks = np.array([sum(1 << b for b in c) for r in range(BLOCK_RADIUS + 1) for c in combinations(range(16), r)], np.int64)
        self.tables = []
        for b in range(4):
            keys = (((self.fp >> U64(16 * b)) & U64(0xFFFF)).astype(np.int64)[:, None] ^ masks).ravel()
            order = np.argsort(keys, kind="stable")
            self.tables.append((np.searchsorted(keys[order], np.arange((1 << 16) + 1)), (order // len(masks)).astype(np.int32)))

    @staticmethod
    def weighted(h: np.ndarray, w: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles and their weights."""
        s, first = np.unique(S.windows(h, width), return_index=True)
        total = np.concatenate([[0], np.cumsum(w)])
        return s, (total[first + width] - total[first]).astype(np.float64)

    def similarity(self, item: int, h: np.ndarray, w: np.ndarray) -> float:
        s, weight = self.weighted(h, w, min(WIDTH, len(h)))
        t, weight_t = self.shingles[item]
        _, i, _ = np.intersect1d(s, t, assume_unique=True, return_indices=True)
        common = weight[i].sum()
        return float(common / (weight.sum() + weight_t.sum() - common))

    def candidates(self, fps: np.ndarray, size: int, longer: bool = False) -> set[tuple[int, int]]:
        """(window, item) within RADIUS bits of items of that size, or with `longer` of larger ones."""
        out = set()
        for b, (at, items) in enumerate(self.tables):
            key = ((fps >> U64(16 * b)) & U64(0xFFFF)).astype(np.int64)
            n = at[key + 1] - at[key]
            window = np.repeat(np.arange(len(fps)), n)
            item = items[np.repeat(at[key] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            near = (self.size[item] > size if longer else self.size[item] == size) & (np.bitwise_count(fps[window] ^ self.fp[item]) <= RADIUS)
            out.update(zip(window[near].tolist(), item[near].tolist(), strict=True))
        return out

    def search(self, h: np.ndarray, w: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """(item_id, first word, words, similarity) of the items in one document."""
        best: dict[int, tuple[float, int]] = {}
        for width in self.widths:
            if len(h) < width:
                continue
            hits = np.flatnonzero(np.isin(S.windows(h, width), self.known[width]))
            if not len(hits):
                continue
            sizes = {int(n) for n in self.size if min(WIDTH, n) == width and n <= len(h)}
            for size in sorted(sizes):  # windows that hold a hit
                reach = np.zeros(len(h) - size + 2, np.int32)
                np.add.at(reach, np.maximum(0, hits - (size - width)), 1)
                np.add.at(reach, np.minimum(hits, len(h) - size) + 1, -1)
                starts = np.flatnonzero(np.cumsum(reach[:-1]) > 0)
                if not len(starts):
                    continue
                first, last = starts[0], starts[-1] + size
                fps = simhash(h[first:last], w[first:last], starts - first, size)
                for window, item in self.candidates(fps, size):
                    at = int(starts[window])
                    s = self.similarity(item, h[at : at + size], w[at : at + size])
                    if s >= LEAST and (item not in best or (-s, at) < (-best[item][0], best[item][1])):
                        best[item] = s, at
            if len(h) < self.size.max():  # larger items: the whole text is the window
                for _, item in self.candidates(simhash(h, w, np.zeros(1, np.int64), len(h)), len(h), True):
                    s = self.similarity(item, h, w)
                    if s >= LEAST and item not in best:
                        best[item] = s, 0
        for item, (s, at) in best.items():
            yield self.ids[item], at, min(len(h), int(self.size[item])), s


_INDEX: dict[int, Index] = {}


def _index(items: list[tuple[int, str]]) -> Index:
    key = hash(tuple(items))
    if key not in _INDEX:
        _INDEX.clear()
        _INDEX[key] = Index(items)
    return _INDEX[key]


def _found(index: Index, texts: pa.Array) -> Iterator[tuple[int, int, int, int, float]]:
    """(row, item_id, first word, words, similarity) of the items in a column of texts."""
    for first, raw, offsets in S.chunks(texts):
        hashes, starts, ends, at = S.word_hashes(raw, offsets)
        held = np.zeros(len(hashes) + 1, bool)
        if len(hashes) >= WIDTH and WIDTH in index.known:  # most texts hold no shingle; told for all texts at once
            held[: len(hashes) - WIDTH + 1] = np.isin(S.windows(hashes, WIDTH), index.known[WIDTH])
        some = np.add.reduceat(np.concatenate([held, [False]]), at[:-1]) if len(at) > 1 else []
        for i in range(len(at) - 1):
            if at[i] < at[i + 1] and (some[i] or index.widths[:1] != [WIDTH]):
                a, b = at[i], at[i + 1]
                for x in index.search(hashes[a:b], (ends - starts)[a:b]):
                    yield (first + i, *x)


def _search(docs: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(items)
        for batch in batches:
            rows = list(_found(index, batch.column(1)))
            ids = batch.column(0)
            yield pa.record_batch([ids.take(pa.array([r[0] for r in rows], pa.int64())), *(pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.int64()), (4, pa.float64())))], names=["doc_id", "item_id", "start_word", "n_words", "similarity"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(run, FOUND)


def _clean(docs: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(items)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            drop = {r[0] for r in _found(index, texts.fill_null(""))}
            yield batch.filter(pa.array([i not in drop for i in range(len(batch))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's different items, by BLOCK_ITEMS."""
    block = []
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").dropDuplicates()
    for row in items.orderBy("item_id", "text").toLocalIterator():
        block.append((row.item_id, row.text))
        if len(block) == BLOCK_ITEMS:
            yield block
            block = []
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows (doc_id, item_id, start_word, n_words, similarity): the items that documents hold."""
    out = None
    for block in _blocks(benchmark):
        found = _search(docs, block)
        out = found if out is None else out.unionByName(found)
    return _search(docs, []).limit(0) if out is None else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, all columns, without the rows whose own text holds a benchmark item."""
    for block in _blocks(benchmark):
        docs = _clean(docs, block)
    return docs
