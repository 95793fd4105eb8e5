"""Token ids as Arrow IPC files of fixed-size lists.

Documents are dealt out by ranges of doc_id; the task of a range writes one shard: a file of record
batches with ``ids`` and ``mask`` as fixed-size lists of one length, which can be mapped into memory
and read at any sequence without a copy, and a file with the documents' token counts.  A file gets
its name only when it is whole, and another attempt writes the same bytes, so lost tasks do no harm.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as filesystems
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorelake.llm.common import saved, scratch_path, shuffle_width, text_of
from scorelake.llm.tokens import encoder

LENGTH = 1024
#: Sequences of a record batch.
BATCH = 256
VOCABULARY = "word_bpe_49k.json"
END = 1
#: All ids of the vocabulary are below 2 ** 16.
ID = pa.uint16()


def place(path: str) -> tuple[filesystems.FileSystem, str]:
    """File system and path of a file in a shared folder."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return filesystems.FileSystem.from_uri(path) if "://" in path else (filesystems.LocalFileSystem(), path)


def schema(length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(ID, length)), ("mask", pa.list_(pa.bool_(), length))])


class _Shard:
    """Writes one shard batch by batch."""

    def __init__(self, folder: str, number: int, length: int):
        self.fs, path = place(folder)
        self.fs.create_dir(path, recursive=True)
        self.names = [f"{path}/{kind}-{number:06d}.arrow" for kind in ("tokens", "documents")]
        self.length, self.attempt = length, uuid.uuid4().hex
        self.files = [self.fs.open_output_stream(f"{n}.{self.attempt}") for n in self.names]
        self.index_schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])
        self.tokens = pa.ipc.new_file(self.files[0], schema(length))
        self.index = pa.ipc.new_file(self.files[1], self.index_schema)
        self.held, self.size, self.sequences = [], 0, 0

    def add(self, doc_ids: list, ids: list[np.ndarray]) -> None:
        self.index.write_batch(pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array([len(x) for x in ids], pa.int64())], schema=self.index_schema))
        for x in ids:
            self.held.append(x)
            self.size += len(x)
        step = self.length * BATCH
        if self.size >= step:
            flat = np.concatenate(self.held)
            whole = len(flat) // step * step
            for at in range(0, whole, step):
                self._write(flat[at:at + step], step)
            self.held, self.size = [flat[whole:]], len(flat) - whole

    def _write(self, flat: np.ndarray, size: int) -> None:
        ids, mask = np.zeros(size, np.uint16), np.zeros(size, bool)
        ids[:len(flat)], mask[:len(flat)] = flat, True
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.tokens.write_batch(pa.record_batch(arrays, schema=schema(self.length)))
        self.sequences += size // self.length

    def close(self) -> int:
        if self.size:
            flat = np.concatenate(self.held)
            self._write(flat, -(-len(flat) // self.length) * self.length)
        self.tokens.close(), self.index.close()
        for name, file in zip(self.names, self.files):
            file.close()
            if self.fs.get_file_info(name).type == filesystems.FileType.NotFound:
                self.fs.move(f"{name}.{self.attempt}", name)
            else:  # another attempt was here first, with the same bytes
                self.fs.delete_file(f"{name}.{self.attempt}")
        return self.sequences


def write_shards(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, length: int = LENGTH) -> DataFrame:
    """Writes the files; returns the manifest: shard, n_documents, n_tokens, n_sequences.

    Ids run in ascending doc_id order over the shards by number; the end id follows each document.
    A null doc_id comes first, rows that repeat a doc_id by their text.  A null text is empty.  An
    empty table makes no shard.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, shard, documents, tokens = encoder(vocabulary, lower=True), None, 0, 0
        end = np.array([END], np.uint16)
        number = TaskContext.get().partitionId()
        for batch in batches:
            shard = shard or _Shard(folder, number, length)
            texts = batch.column("text").to_pylist()
            ids = [np.concatenate([np.frombuffer(codes.ids(t), "<u4").astype(np.uint16), end]) for t in texts]
            documents, tokens = documents + len(ids), tokens + sum(map(len, ids))
            shard.add(batch.column("doc_id").to_pylist(), ids)
        if shard:
            yield pa.RecordBatch.from_pydict({"shard": [number], "n_documents": [documents], "n_tokens": [tokens], "n_sequences": [shard.close()]})

    width = shuffle_width(docs.sparkSession)
    ordered = docs.select(F.col("doc_id").cast("bigint"), text_of().alias("text")).repartitionByRange(width, "doc_id").sortWithinPartitions("doc_id", "text")
    return saved(ordered.mapInArrow(run, "shard bigint, n_documents bigint, n_tokens bigint, n_sequences bigint"), "manifest")


def sequence(folder: str, shard: int, number: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and mask of one sequence of a shard; of a local file, views of the mapped memory."""
    fs, path = place(f"{folder}/tokens-{shard:06d}.arrow")
    source = pa.memory_map(path) if isinstance(fs, filesystems.LocalFileSystem) else fs.open_input_file(path)
    row = pa.ipc.open_file(source).get_batch(number // BATCH).slice(number % BATCH, 1)
    return row.column("ids").flatten().to_numpy(), row.column("mask").flatten().to_numpy(zero_copy_only=False)


def _stretches(folder: str, shard: int) -> Iterator[np.ndarray]:
    """The ids of a shard without padding, batch by batch."""
    fs, path = place(f"{folder}/tokens-{shard:06d}.arrow")
    with fs.open_input_file(path) as file:
        reader = pa.ipc.open_file(file)
        for i in range(reader.num_record_batches):
            batch = reader.get_batch(i)
            ids, mask = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in ("ids", "mask"))
            yield ids[mask]


def read_documents(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32, shard."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    shards = manifest.select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, base in zip(batch.column("shard").to_pylist(), batch.column("base").to_pylist()):
                stretches, left = _stretches(folder, shard), np.array([], np.uint16)
                fs, path = place(f"{folder}/documents-{shard:06d}.arrow")
                with fs.open_input_file(path) as file:
                    reader = pa.ipc.open_file(file)
                    for i in range(reader.num_record_batches):
                        index = reader.get_batch(i)
                        starts, sums = [], []
                        for n in index.column("n_tokens").to_pylist():
                            starts.append(base)
                            base += n
                            crc = 0
                            while n:
                                if not len(left):
                                    left = next(stretches)
                                part, left = left[:n], left[n:]
                                crc, n = zlib.crc32(part.astype("<u4").tobytes(), crc), n - len(part)
                            sums.append(crc)
                        yield pa.RecordBatch.from_arrays(
                            [index.column("doc_id"), pa.array(starts, pa.int64()), index.column("n_tokens"), pa.array(sums, pa.int64()), pa.array([shard] * len(sums), pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    dealt = shards.repartitionByRange(shuffle_width(spark), "shard")
    return dealt.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, shard bigint")


def token_documents(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH) -> DataFrame:
    """Writes the documents' ids to new files in the shared folder and reads them back, one row per document."""
    folder = scratch_path(docs.sparkSession, "tokens")
    return read_documents(docs.sparkSession, folder, write_shards(docs, folder, vocabulary, length))
