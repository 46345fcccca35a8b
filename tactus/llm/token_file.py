"""Token ids as Arrow files of equal-length sequences.

Documents are encoded with the tokenizers library, their ids dealt by ranges of doc_id and written, one shard for each range,
in ascending order. A shard is two Arrow IPC files (the stream format with a footer): `*.sequences.arrow` with record batches of
two fixed-size-list columns, ids and mask, and `*.documents.arrow` with each document's place. Every sequence has the same
length and every batch but the last as many sequences, so sequence i of a memory-mapped shard is a slice of one buffer of a
batch that its number tells, without a copy; only the last sequence of a shard is padded, and its mask says so. A shard is
written under another name and renamed when whole, and the manifest, written to the shared folder after all shards, names those
that count: a lost executor leaves at most a file that nothing names.

With by_word=True words between spaces and line feeds are encoded once for a worker and texts are put together from them. The
caller states by it that the tokenizer drops white space, that no token or rule reaches over it, that A-Z count as a-z, and that
a full stop or comma after a letter at a word's end is taken apart, as with the one that the registered query uses (a test
compares it with whole texts); otherwise texts are encoded whole.

Defined results: null text counts as empty and gives the end id only; null doc_ids come first; rows with the same doc_id
follow in the order of their texts' hashes; extra columns are ignored; very long texts are encoded whole.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared as S

SEQUENCE, BATCH = 2048, 256
END_ID = 1
#: Words whose ids a worker remembers; beyond it starts anew.
REMEMBERED = 1_000_000
#: Bytes of text that a shard has, about.
SHARD = 8 << 20
MANIFEST = "shard int, path string, n_documents long, n_tokens long"
PLACES = "shard int, doc_id long, start long, n_tokens long, ids_crc32 long"
_SPACE = np.zeros(256, bool)
_SPACE[[32, 10]] = True
#: A full stop or a comma at a word's end.
_TAIL = np.zeros(256, bool)
_TAIL[[44, 46]] = True


class Encoder:
    """Ids of whole texts, with the end id, as little-endian integers of the least width that the vocabulary allows."""

    def __init__(self, file: str, by_word: bool, end_id: int) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.by_word, self.end_id = by_word, end_id
        self.forget()

    def forget(self) -> None:
        """Word 0 is the end."""
        self.at: dict[int, int] = {}
        self.start, self.size, self.ids = np.zeros(1, np.int64), np.ones(1, np.int64), np.array([self.end_id], self.dtype)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, hashes: list[int], words: list[str]) -> None:
        ids = self._encode(words)
        size = np.array([len(x) for x in ids], np.int64)
        first = len(self.ids) + np.concatenate([[0], np.cumsum(size)[:-1]])
        self.at.update(zip(hashes, range(len(self.start), len(self.start) + len(words)), strict=True))
        self.start, self.size = np.concatenate([self.start, first]), np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, np.array([i for x in ids for i in x], self.dtype)])

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
        """(first row, ids as binary) of slices of a text column."""
        for first, raw, offsets in S.chunks(texts, 2 << 20):
            n = len(offsets) - 1
            if self.by_word:
                ids, ends = self._by_word(raw, offsets)
            else:
                lists = self._encode([raw[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
                ids = np.array([i for x in lists for i in (*x, self.end_id)], self.dtype)
                ends = np.cumsum([len(x) + 1 for x in lists])
            at = np.concatenate([[0], ends]).astype(np.int64) * self.dtype.itemsize
            yield first, pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(ids))])

    def _by_word(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice and where each text's end."""
        hashes, starts, ends, at = S.word_hashes(raw, offsets, True, _SPACE, _TAIL)
        place, different = pd.factorize(hashes)
        if len(self.start) > REMEMBERED:
            self.forget()
        known = [self.at.get(h, -1) for h in different.tolist()]
        new = [k for k, i in enumerate(known) if i < 0]
        if new:
            seen = np.zeros(len(different), np.int64)
            seen[place[::-1]] = np.arange(len(place))[::-1]  # the first place of each
            hs = different[new].tolist()
            self._learn(hs, [raw[starts[i] : ends[i]].tobytes().decode() for i in seen[new].tolist()])
            known = [self.at[h] for h in different.tolist()]
        words = np.insert(np.array(known, np.int64)[place] if len(place) else np.zeros(0, np.int64), at[1:], 0)
        size = self.size[words]
        upto = np.cumsum(size)
        ids = self.ids[np.repeat(self.start[words] - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)]
        return ids, upto[at[1:] + np.arange(len(at) - 1)]


@lru_cache(2)
def encoder(file: str, by_word: bool, end_id: int) -> Encoder:
    return Encoder(file, by_word, end_id)


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Writes one shard; tokens go out in batches of whole sequences."""

    def __init__(self, folder: str, name: str, dtype: np.dtype, length: int, end_id: int) -> None:
        self.system, base = _files(folder)
        self.system.create_dir(base, recursive=True)
        self.path, self.dtype, self.length = f"{base}/{name}", dtype, length
        ids, mask = (pa.list_(pa.field("item", x, nullable=False), length) for x in (pa.from_numpy_dtype(dtype), pa.bool_()))
        self.schema = pa.schema([pa.field("ids", ids, nullable=False), pa.field("mask", mask, nullable=False)], metadata={"sequence": str(length), "batch": str(BATCH), "end_id": str(end_id)})
        self.out = self.system.open_output_stream(f"{self.path}.sequences.part")
        self.writer = pa.ipc.new_file(self.out, self.schema)
        self.held, self.held_n, self.total, self.places = [], 0, 0, []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // self.dtype.itemsize
        self.places.append((doc_id, self.total, n))
        self.total += n
        self.held.append(ids)
        self.held_n += n
        if self.held_n >= BATCH * self.length:
            self.flush()

    def flush(self, last: bool = False) -> None:
        """Write all full batches, and with `last` what is left."""
        flat = np.frombuffer(b"".join(self.held), self.dtype)
        per, at = BATCH * self.length, 0
        while len(flat) - at >= per or last and at < len(flat):
            part = flat[at : at + per]
            ids = np.zeros(-(-len(part) // self.length) * self.length, self.dtype)
            ids[: len(part)] = part
            columns = [pa.array(ids), pa.array(np.arange(len(ids)) < len(part))]
            self.writer.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(x, type=f.type) for x, f in zip(columns, self.schema, strict=True)], schema=self.schema))
            at += len(part)
        self.held, self.held_n = [flat[at:].tobytes()], len(flat) - at

    def close(self) -> str:
        self.flush(last=True)
        self.writer.close()
        self.out.close()
        table = pa.table({k: pa.array([x[i] for x in self.places], pa.int64()) for i, k in enumerate(("doc_id", "start", "n_tokens"))})
        with self.system.open_output_stream(f"{self.path}.documents.part") as out, pa.ipc.new_file(out, table.schema) as writer:
            writer.write_table(table)
        for kind in ("documents", "sequences"):
            self.system.move(f"{self.path}.{kind}.part", f"{self.path}.{kind}.arrow")
        return self.path


def bounds(rows: DataFrame) -> list[tuple[bool, int, int]]:
    """The last keys, (whether doc_id is known, doc_id, row), of all shards but the last, about SHARD bytes of text each.

    They come from the keys alone, so neither texts nor ids are written or encoded for them.
    """
    scratch = S.Scratch(rows.sparkSession, "token-keys")
    keys = scratch.put(rows.select("doc_id", "row", F.octet_length("text").cast("long").alias("bytes")))
    n = max(1, -(-(keys.agg(F.sum("bytes")).first()[0] or 0) // SHARD))
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "row")
    dealt = keys.select("doc_id", "row").repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "row")
    last = sorted(tuple(r["last"]) for r in dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.max(key).alias("last")).collect())
    scratch.drop()
    return last[:-1]


def write(docs: DataFrame, folder: str, tokenizer: str, length: int = SEQUENCE, end_id: int = END_ID, by_word: bool = False) -> DataFrame:
    """Write the shards below `folder` (any address that pyarrow's file systems know); returns the manifest.

    The ids are held once on their way, in the shuffle to the shards.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(tokenizer, by_word, end_id)
        for batch in batches:
            for first, ids in model.encode(batch.column(2)):
                part = batch.slice(first, len(ids))
                shard = [bisect_left(last, (d is not None, d or 0, r)) for d, r in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                yield pa.record_batch([part.column(0), part.column(1), ids.cast(pa.binary()), pa.array(shard, pa.int32())], names=["doc_id", "row", "ids", "shard"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, task, dtype = None, TaskContext.get(), encoder(tokenizer, by_word, end_id).dtype
        for batch in batches:
            if writer is None and len(batch):
                writer = ShardWriter(folder, f"shard-{task.partitionId():06d}-{task.taskAttemptId()}", dtype, length, end_id)
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                writer.add(doc_id, ids)
        if writer:
            path = writer.close()
            yield pa.record_batch([pa.array([task.partitionId()], pa.int32()), pa.array([path]), pa.array([len(writer.places)], pa.int64()), pa.array([writer.total], pa.int64())], names=["shard", "path", "n_documents", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    last = bounds(rows)
    dealt = rows.mapInArrow(encode, "doc_id long, row long, ids binary, shard int").repartitionById(len(last) + 1, "shard")
    return S.materialize(dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "row").select("doc_id", "ids").mapInArrow(run, MANIFEST), "token-manifest")


def open_shard(folder: str, path: str):
    """(sequences, documents) of a shard; local files are mapped, so their buffers are the file's pages."""
    system, _ = _files(folder)
    local = system.type_name == "local"
    return tuple(pa.ipc.open_file(pa.memory_map(f"{path}.{k}.arrow") if local else system.open_input_file(f"{path}.{k}.arrow")) for k in ("sequences", "documents"))


def sequence(folder: str, path: str, i: int) -> tuple[pa.Array, pa.Array]:
    """Ids and mask of sequence i of a shard."""
    file, _ = open_shard(folder, path)
    k, row = divmod(i, int(file.schema.metadata[b"batch"]))
    if not 0 <= k < file.num_record_batches or row >= len(batch := file.get_batch(k)):
        raise IndexError(i)
    n = batch.schema.field("ids").type.list_size
    return tuple(batch.column(c).values.slice((batch.column(c).offset + row) * n, n) for c in (0, 1))


def _tokens(file: pa.ipc.RecordBatchFileReader) -> Iterator[np.ndarray]:
    for k in range(file.num_record_batches):
        batch = file.get_batch(k)
        ids, mask = batch.column(0).flatten().to_numpy(zero_copy_only=False), batch.column(1).flatten()
        yield ids[: mask.true_count]


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) from the files; start counts the ids of all documents before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, path in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                sequences, documents = open_shard(folder, path)
                places = documents.read_all()
                crcs, held, tokens = [], np.zeros(0, "<u4"), _tokens(sequences)
                for n in places.column("n_tokens").to_pylist():
                    parts = [held]
                    have = len(held)
                    while have < n:
                        parts.append(next(tokens).astype("<u4"))
                        have += len(parts[-1])
                    flat = np.concatenate(parts) if len(parts) > 1 else held
                    crcs.append(zlib.crc32(flat[:n]))
                    held = flat[n:]
                yield pa.record_batch([pa.array([shard] * len(crcs), pa.int32()), *(places.column(c).combine_chunks() if places.column(c).num_chunks else pa.array([], pa.int64()) for c in ("doc_id", "start", "n_tokens")), pa.array(crcs, pa.int64())], names=["shard", "doc_id", "start", "n_tokens", "ids_crc32"])

    shards = manifest.select("shard", "path").repartition(max(1, spark.sparkContext.defaultParallelism), "shard")
    bases = manifest.select("shard", (F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_tokens")).alias("base"))
    rows = S.join_small(shards.mapInArrow(run, PLACES), bases, "shard", "inner")
    return rows.select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
