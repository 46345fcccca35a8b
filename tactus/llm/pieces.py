"""SentencePiece encoding and decoding by a shared-prefix Viterbi.

The model's pieces join by rank (byte-pair merges), so the best path is not the one with the largest sum of piece scores. The
forward pass therefore scores a step from piece p to piece t as possible or impossible: possible where merging the characters
of p + t gives p, t again. A text's encoding is the path on which every step is possible, and the last piece of every prefix is
the forward state. Texts fall into marked words, over whose borders no piece reaches; the distinct words that a worker has not
met yet are sorted and walked as a trie, depth first, so words with a common prefix share its states. Each word's states hang on
the stack of the walk; nothing is built for the trie itself.

The ids are those of the sentencepiece library, bytes for unknown characters included. Defined results: null and empty texts
have no ids and decode to ""; U+2581 counts as a space, as in the library, so it decodes to one; rows keep every column.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MARK = "▁"
#: Words whose ids a worker remembers; beyond it starts anew.
REMEMBERED = 200_000
#: Pairs of pieces whose steps a worker remembers.
STEPS = 400_000
WORD = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+")


class Pieces:
    """The pieces of a model file and the encoder over them."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.score, self.id_of, self.bytes_of = {}, {}, [b""] * n
        self.byte_id = [0] * 256
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif sp.is_unknown(i):
                self.bytes_of[i] = " ⁇ ".encode()
            elif not sp.is_control(i):
                self.id_of[piece], self.score[piece] = i, sp.get_score(i)
                self.bytes_of[i] = piece.replace(MARK, " ").encode()
        #: All endings of pieces; true for the pieces that merging their own characters gives.
        self.endings: dict[str, bool] = {}
        for t in self.id_of:
            for i in range(1, len(t)):
                self.endings.setdefault(t[i:], False)
            self.endings[t] = self.merge(t) == [t]
        self.possible: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}

    def merge(self, text: str) -> list[str]:
        """Pieces of a short text by merging the neighbours of the best rank, the first ones on a tie."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def step(self, p: str, t: str) -> bool:
        i = self.id_of.get(p)
        if i is None:  # an unknown character joins nothing
            return True
        key = i << 32 | self.id_of[t]
        known = self.possible.get(key)
        if known is None:
            if len(self.possible) >= STEPS:
                self.possible.clear()
            known = self.possible[key] = self.merge(p + t) == [p, t]
        return known

    def walk(self, words: list[str]) -> Iterator[tuple[str, list[str]]]:
        """Words in sorted order with their pieces; states of the prefix that a word shares with the last are kept."""
        last, states = "", [""]  # states[i]: the last piece of the first i characters
        endings, step = self.endings.get, self.step
        for word in words:
            same, limit = 0, min(len(last), len(word))
            while same < limit and last[same] == word[same]:
                same += 1
            del states[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                found = word[end - 1]
                for begin in range(end - 1, -1, -1):
                    t = word[begin:end]
                    usable = endings(t)
                    if usable is None:  # no piece ends so
                        break
                    if usable and (not begin or step(states[begin], t)):
                        found = t
                        break
                states.append(found)
            out, end = [], len(word)
            while end:
                out.append(states[end])
                end -= len(states[end])
            last = word
            yield word, out[::-1]

    def ids(self, pieces: list[str]) -> bytes:
        out = []
        for t in pieces:
            i = self.id_of.get(t)
            out.extend([i] if i is not None else [self.byte_id[b] for b in t.encode("utf-8", "surrogatepass")])
        return struct.pack(f"<{len(out)}I", *out)

    def split(self, text: str) -> list[str]:
        """Marked words; borders are where a space begins and around line feeds, where no piece reaches across."""
        if "  " in text or " \n" in text or text[0] == " " or text[-1] == " " or MARK in text:
            return WORD.findall(MARK + text.replace(" ", MARK))
        return (MARK + text.replace(" ", f" {MARK}").replace("\n", " \n")).split(" ")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers."""
        split = [self.split(t) if t else [] for t in texts]
        if len(self.words) > REMEMBERED:
            self.words.clear()
        new = {w for words in split for w in words}.difference(self.words)
        for word, pieces in self.walk(sorted(new)):
            self.words[word] = self.ids(pieces)
        get = self.words.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


@lru_cache(2)
def pieces(model_file: str) -> Pieces:
    return Pieces(model_file)


def _slices(batch: pa.RecordBatch, column: int, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of some MB, whole rows only."""
    sizes = np.array([0 if x is None else x for x in pc.binary_length(batch.column(column)).to_pylist()], np.int64)
    at, ends = 0, np.cumsum(sizes)
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most_bytes, "right")))
        yield batch.slice(at, to - at)
        at = to


def encode(docs: DataFrame, model_file: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a binary column `ids`: little-endian unsigned 32-bit integers."""
    rest = [c for c in docs.columns if c != ids]
    schema = T.StructType([*docs.select(*rest).schema.fields, T.StructField(ids, T.BinaryType())])
    at = rest.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_file)
        for whole in batches:
            for batch in _slices(whole, at):
                yield pa.record_batch([*batch.columns, pa.array(model.encode(batch.column(at).to_pylist()), pa.binary())], names=[*rest, ids])

    return docs.select(*rest).mapInArrow(run, schema)


def decode(rows: DataFrame, model_file: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """rows with a column `decoded`: the texts of the ids."""
    rest = [c for c in rows.columns if c != decoded]
    schema = T.StructType([*rows.select(*rest).schema.fields, T.StructField(decoded, T.StringType())])
    at = rest.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_file)
        for whole in batches:
            for batch in _slices(whole, at):
                yield pa.record_batch([*batch.columns, pa.array([model.decode(x or b"") for x in batch.column(at).to_pylist()], pa.string())], names=[*rest, decoded])

    return rows.select(*rest).mapInArrow(run, schema)


def encoded_and_back(docs: DataFrame, model_file: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids, decoded, same): same tells whether the decoded text is the text. One pass does both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_file)
        for whole in batches:
            for batch in _slices(whole, 1):
                texts = batch.column(1).to_pylist()
                ids = model.encode(texts)
                decoded = [model.decode(x) for x in ids]
                same = [d == (t or "") for d, t in zip(decoded, texts, strict=True)]
                yield pa.record_batch([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.string()), pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "ids", "decoded", "same"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids binary, decoded string, same boolean")
