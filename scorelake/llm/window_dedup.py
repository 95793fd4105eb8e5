"""Repeated word windows: merged count-min sketches first, then exact groups of what may be repeated.

1. Texts go to a store in the shared folder and are read file by file, in chunks of bounded size that
   are the same in every pass.
2. Each chunk fills its own count-min sketch: two rows of cells, a window's hash gives one cell in
   each.  The rows are cut into blocks by the hash, and a chunk sends each block only its filled
   cells, sorted, as differences, with a count of one or many.  The task of a block adds the counts of
   all chunks and answers every chunk with one bit per cell sent: filled once or more often.  No task
   holds the whole sketch, nothing is broadcast, and the sketch grows with the input.
3. A count is never under the true one, so a window with a cell filled once is unique.  In the second
   pass the others go to their block once a chunk, as the cell and a second 64-bit hash, are counted
   exactly there and answered with one bit each.
4. The third pass removes the words that the repeated windows cover.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import saved, shuffle_width
from scorelake.llm.suffix_dedup import BASES, Hashes, _mixed, _powers, _store, _texts

WINDOW = 35
#: Rows of the sketch, and cells of a row for each window.
ROWS, CELLS = 2, 8
#: Bytes of text that are hashed at a time (a longer text is taken alone), and windows that a block holds.
CHUNK, BLOCK = 4 << 20, 1 << 21
#: Bytes of text for one window, to size the blocks.
PER_WINDOW = 6

_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOW = np.uint64(0xFFFFFFFF)


class Chunk:
    """The words of some texts and the hashes of all windows of ``size`` words inside one text."""

    def __init__(self, texts: list[bytes], size: int, powers):
        joined = b"\n".join(texts) + b"\n"
        self.raw = np.frombuffer(joined, np.uint8)
        if len(powers[0][0]) <= len(joined):
            powers = [_powers(b, len(joined)) for b in BASES]
        inside = np.concatenate([[False], ~_SPACE[self.raw]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end, self.size = edges[::2], edges[1::2], size
        self.ends = np.cumsum([len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.start, np.concatenate([[0], self.ends]))  # word that each text begins with
        text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        n = max(0, len(text) - size + 1)
        self.at = np.flatnonzero(text[:n] == text[size - 1:size - 1 + n])
        self.powers = powers

    def hashes(self, lane: int) -> np.ndarray:
        if not len(self.at):
            return np.array([], np.uint64)
        words = Hashes(self.raw, self.powers[lane]).of(self.start, self.end)
        return Hashes(words, self.powers[lane]).all(self.size)[self.at]

    def without(self, windows: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]], bytes]]:
        """For each text: words, runs (first, last) of words that ``windows`` cover, the other words joined by a space."""
        steps = np.zeros(len(self.start) + 1, np.int32)
        np.add.at(steps, windows, 1)
        np.add.at(steps, windows + self.size, -1)
        gone = np.cumsum(steps[:-1]) > 0
        ends = np.zeros(len(self.raw) + 2, np.int8)
        ends[self.start[~gone]] += 1
        ends[self.end[~gone] + 1] -= 1
        spaced = self.raw.copy()
        spaced[self.end] = 0x20
        stay = np.cumsum(ends[:len(self.raw)], dtype=np.int8) > 0
        before = np.concatenate([[0], np.cumsum(stay)])
        left = spaced[stay].tobytes()
        bounds = before[np.concatenate([[0], self.ends])]
        turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
        runs = np.searchsorted(turns, self.first)
        for i, (a, b) in enumerate(zip(self.first, self.first[1:])):
            own = []
            if gone[a:b].any():
                own = turns[runs[i] // 2 * 2:(runs[i + 1] + 1) // 2 * 2].reshape(-1, 2)
                own = [(max(s, a) - a, min(e, b) - 1 - a) for s, e in own.tolist() if s < b and e > a]
            yield int(b - a), own, left[bounds[i]:max(bounds[i], bounds[i + 1] - 1)]


class Sketch:
    """A chunk's filled cells; ``blocks`` and ``cells`` (of a block and row) are the same for all chunks."""

    def __init__(self, hashes: np.ndarray, blocks: int, cells: int):
        block = (hashes >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)
        self.blocks, self.keys, self.inverse, self.many = blocks, [], [], []
        self.cell = block << np.uint64(32) | ((hashes & _LOW) * np.uint64(cells) >> np.uint64(32))
        for row in range(ROWS):
            low = _mixed(hashes + np.uint64(row)) & _LOW if row else hashes & _LOW
            keys, inverse, counts = np.unique(block << np.uint64(32) | (low * np.uint64(cells) >> np.uint64(32)), return_inverse=True, return_counts=True)
            self.keys.append(keys)
            self.inverse.append(inverse)
            self.many.append(counts > 1)

    def parts(self) -> Iterator[tuple[int, bytes]]:
        """(block, its filled cells); the second row's blocks come after all of the first row's."""
        for row, (keys, many) in enumerate(zip(self.keys, self.many)):
            for block, a, b in _segments(keys):
                yield row * self.blocks + block, _packed((keys[a:b] & _LOW) << np.uint64(1) | many[a:b])

    def often(self, masks: Iterator[bytes]) -> np.ndarray:
        """Windows whose cells are all filled more than once."""
        out = np.ones(len(self.inverse[0]), bool)
        for keys, inverse in zip(self.keys, self.inverse):
            out &= _bits(keys, masks)[inverse]
        return np.flatnonzero(out)


class Group:
    """The windows of a chunk that may be repeated, each different one once."""

    def __init__(self, cell: np.ndarray, other: np.ndarray):
        order = np.lexsort((other, cell))
        cell, other = cell[order], other[order]
        new = np.concatenate([[True], (cell[1:] != cell[:-1]) | (other[1:] != other[:-1])]) if len(order) else np.array([], bool)
        first = np.flatnonzero(new)
        self.cell, self.other = cell[first], other[first]
        self.many = np.diff(np.concatenate([first, [len(order)]])) > 1
        self.inverse = np.empty(len(order), np.int64)
        self.inverse[order] = np.cumsum(new) - 1

    def parts(self) -> Iterator[tuple[int, bytes]]:
        for block, a, b in _segments(self.cell):
            yield block, _packed((self.cell[a:b] & _LOW) << np.uint64(1) | self.many[a:b], self.other[a:b])

    def repeated(self, masks: Iterator[bytes]) -> np.ndarray:
        return _bits(self.cell, masks)[self.inverse] if len(self.cell) else np.array([], bool)


def _segments(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(block, first, end) of sorted keys with the block above the lowest 32 bits."""
    block = keys >> np.uint64(32)
    cuts = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]]) if len(block) else [0]
    for a, b in zip(cuts, cuts[1:]):
        yield int(block[a]), int(a), int(b)


def _bits(keys: np.ndarray, masks: Iterator[bytes]) -> np.ndarray:
    """The answers to a chunk's keys, block after block."""
    found = [np.unpackbits(np.frombuffer(next(masks), np.uint8), count=b - a) for _, a, b in _segments(keys)]
    return np.concatenate(found).astype(bool) if found else np.array([], bool)


def _packed(keys: np.ndarray, other: np.ndarray | None = None) -> bytes:
    """Sorted numbers as differences, lowest bytes first, compressed; ``other`` as it is."""
    steps = np.diff(keys, prepend=np.uint64(0))
    planes = max(1, (int(steps.max()).bit_length() + 7) // 8)
    body = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes()
    packed = pa.compress(body, codec="zstd", asbytes=True)
    return np.array([len(keys), planes, len(packed)], "<u4").tobytes() + packed + (b"" if other is None else other.tobytes())


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray | None]:
    n, planes, size = (int(x) for x in np.frombuffer(data, "<u4", 3))
    body = pa.decompress(data[12:12 + size], decompressed_size=n * planes, codec="zstd", asbytes=True)
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :planes] = np.frombuffer(body, np.uint8).reshape(planes, n).T
    return np.cumsum(steps.reshape(-1).view("<u8"), dtype=np.uint64), np.frombuffer(data[12 + size:], np.uint64) if len(data) > 12 + size else None


def counted(parts: list[bytes]) -> list[bytes]:
    """For what each chunk sent to one block: a bit per key, set if all chunks together hold it more than once."""
    sent = [_unpacked(p) for p in parts]
    keys = np.concatenate([k for k, _ in sent])
    other = np.concatenate([o for _, o in sent]) if sent[0][1] is not None else None
    cell, many = keys >> np.uint64(1), keys & np.uint64(1)
    order = np.argsort(cell, kind="stable") if other is None else np.lexsort((other, cell))
    cell = cell[order]
    new = cell[1:] != cell[:-1]
    if other is not None:
        other = other[order]
        new |= other[1:] != other[:-1]
    first = np.flatnonzero(np.concatenate([[True], new]))
    total = np.add.reduceat(many[order].astype(np.int64) + 1, first)
    twice = np.empty(len(order), bool)
    twice[order] = np.repeat(total > 1, np.diff(np.concatenate([first, [len(order)]])))
    bounds = np.cumsum([len(k) for k, _ in sent])[:-1]
    return [np.packbits(x).tobytes() for x in np.split(twice, bounds)]


def _chunks(path: str, size: int) -> Iterator[tuple[list, list[bytes]]]:
    """doc_ids and texts of a store file, some ``size`` bytes at a time; the same ones in every pass."""
    ids, texts, held = [], [], 0
    for _, doc_id, text in _texts(path, ["doc_id", "text"]):
        raw = text.encode("utf-8", "surrogatepass")
        if ids and held + len(raw) > size:
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(doc_id)
        texts.append(raw)
        held += len(raw)
    if ids:
        yield ids, texts


def _by_file(files: DataFrame, answers: list[DataFrame], work: Callable, out: str, chunk: int) -> DataFrame:
    """``work(chunk number, ids, texts, masks of each step)`` over all chunks, one task per file at a time."""
    columns = ["file", "chunk", "step", "block", "mask"]
    rows = files.select("file", F.lit(-1).alias("chunk"), F.lit(0).alias("step"), F.lit(0).alias("block"), F.lit(None).cast("binary").alias("mask"), "path")
    for step, answer in enumerate(answers):
        rows = rows.unionByName(answer.select("file", "chunk", F.lit(step).alias("step"), "block", "mask", F.lit(None).cast("string").alias("path")))
    dealt = rows.repartition(shuffle_width(files.sparkSession), "file").sortWithinPartitions("file", "chunk", "step", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (x for b in batches for x in zip(*(b.column(c).to_pylist() for c in (*columns, "path"))))
        for file, own in groupby(each, key=lambda x: x[0]):
            path = next(own)[5]
            told = groupby(own, key=lambda x: x[1])
            number, masks = next(told, (None, iter(())))
            for at, (ids, texts) in enumerate(_chunks(path, chunk)):
                mine = masks if number == at else iter(())
                yield from work(file, at, ids, texts, (x[4] for x in mine))
                if number == at:
                    number, masks = next(told, (None, iter(())))

    return dealt.mapInArrow(run, out)


def _answers(sent: DataFrame, label: str) -> DataFrame:
    """(file, chunk, block, mask) from the tasks that hold one block each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (x for b in batches for x in zip(*(b.column(c).to_pylist() for c in ("block", "file", "chunk", "part"))))
        for block, own in groupby(rows, key=lambda x: x[0]):
            own = list(own)
            masks = counted([x[3] for x in own])
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[1] for x in own], pa.int64()), pa.array([x[2] for x in own], pa.int32()), pa.array([block] * len(own), pa.int32()), pa.array(masks, pa.binary())],
                ["file", "chunk", "block", "mask"])

    dealt = sent.repartition(shuffle_width(sent.sparkSession), "block").sortWithinPartitions("block", "file", "chunk")
    return saved(dealt.mapInArrow(run, "file bigint, chunk int, block int, mask binary"), label)


def without_repeats(docs: DataFrame, window: int = WINDOW, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, spans (first and last word of each removed run), kept (the other words).

    Words are runs of characters but white space (``[\\x20\\x09-\\x0D]``).  Every word of a window of
    ``window`` words whose word sequence also starts elsewhere, in the same document or another one, is
    removed; windows never cross documents and are judged on the input.  Null and empty texts have no
    words; texts of fewer words lose nothing; rows that repeat a doc_id are documents of their own;
    other columns are not read.  An empty table gives no rows.  Two windows count as equal if two
    independent hashes agree, over 80 bits in all.
    """
    kind = "string" if docs.schema["doc_id"].dataType.simpleString() == "string" else "bigint"
    store = _store(docs.select(F.col("doc_id").cast(kind).alias("doc_id"), "text"))
    files = saved(store.groupBy(F.shiftright("row", 32).alias("file"), "path").agg(F.sum(F.octet_length("text")).alias("bytes")), "files")
    windows = (files.agg(F.sum("bytes")).first()[0] or 0) // PER_WINDOW + 1
    blocks = max(shuffle_width(docs.sparkSession), math.ceil(windows / block))
    cells = min(1 << 31, 1 << max(10, math.ceil(math.log2(CELLS * windows / blocks))))
    made = lambda: [_powers(b, chunk + 4096) for b in BASES]  # noqa: E731  (once a task)
    parts = "file bigint, chunk int, block int, part binary"

    def rows(file: int, at: int, found: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        sent = list(found)
        if sent:
            yield pa.RecordBatch.from_arrays(
                [pa.array([file] * len(sent), pa.int64()), pa.array([at] * len(sent), pa.int32()), pa.array([b for b, _ in sent], pa.int32()), pa.array([p for _, p in sent], pa.binary())],
                ["file", "chunk", "block", "part"])

    memory: dict = {}

    def powers():
        if "powers" not in memory:
            memory["powers"] = made()
        return memory["powers"]

    def sketched(file, at, ids, texts, masks):
        yield from rows(file, at, Sketch(Chunk(texts, window, powers()).hashes(0), blocks, cells).parts())

    def candidates(words: Chunk, masks: Iterator[bytes]) -> tuple[np.ndarray, Group]:
        sketch = Sketch(words.hashes(0), blocks, cells)
        often = sketch.often(masks)
        return often, Group(sketch.cell[often], words.hashes(1)[often])

    def grouped(file, at, ids, texts, masks):
        yield from rows(file, at, candidates(Chunk(texts, window, powers()), masks)[1].parts())

    def removed(file, at, ids, texts, masks):
        words = Chunk(texts, window, powers())
        often, group = candidates(words, masks)
        gone = words.at[often[group.repeated(masks)]]
        out = list(words.without(gone))
        yield pa.RecordBatch.from_arrays([
            pa.array(ids, pa.string() if kind == "string" else pa.int64()), pa.array([n for n, _, _ in out], pa.int64()),
            pa.array([sum(b - a + 1 for a, b in runs) for _, runs, _ in out], pa.int64()),
            pa.array([[{"first": a, "last": b} for a, b in runs] for _, runs, _ in out], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
            pa.array([left.decode("utf-8", "surrogatepass") for _, _, left in out], pa.string()),
        ], ["doc_id", "n_words", "n_removed", "spans", "kept"])

    often = _answers(_by_file(files, [], sketched, parts, chunk), "sketch")
    twice = _answers(_by_file(files, [often], grouped, parts, chunk), "windows")
    return _by_file(files, [often, twice], removed, f"doc_id {kind}, n_words bigint, n_removed bigint, spans array<struct<first: bigint, last: bigint>>, kept string", chunk)
