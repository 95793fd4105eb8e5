"""Sum-of-squares packing of token sequences.

Documents come in online.  A document's full windows leave at once; its rest goes to the open
window whose new fill level makes the sum of squared counts of partially filled windows least.
Counts live in an array by fill level.  Each task packs its own share of the documents.  When a task
ends (or holds more open windows than ``OPEN``), the emptiest windows are cut up to fill the gaps of
the fullest, and the last rest leaves in lengths that are powers of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import saved, text_of
from scorelake.llm.tokens import encoder

LENGTH = 1024
VOCABULARY = "byte_bpe_50k.json"
END = 0
#: Open windows of one task, 16 MB of ids at most.
OPEN = 4096

Piece = tuple[object, int, int, bytes]  # doc_id, start, tokens of the document, ids


class Packer:
    """Places pieces; ``rows`` has the finished ones as (doc_id, start, length, crc32, doc_tokens, sequence, offset)."""

    def __init__(self, length: int = LENGTH, open_windows: int = OPEN):
        self.length, self.most = length, open_windows
        self.counts = np.zeros(length + 1, np.int64)
        self.windows: list[list[list[Piece]]] = [[] for _ in range(length)]
        self.open = self.done = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: object, ids: bytes) -> None:
        total, full = len(ids) // 4, len(ids) // 4 // self.length * self.length
        for start in range(0, full, self.length):
            self._leave([(doc_id, start, total, ids[start * 4:(start + self.length) * 4])])
        if total > full:
            self._place((doc_id, full, total, ids[full * 4:]))
        if self.open > self.most:
            self._level_out()

    def finish(self) -> None:
        self._level_out()
        for level in np.flatnonzero(self.counts[:self.length]).tolist():
            for pieces in self.windows[level]:
                while level:
                    size = 1 << level.bit_length() - 1
                    part, pieces = _cut(pieces, size)
                    self._leave(part)
                    level -= size
        self.counts[:], self.windows, self.open = 0, [[] for _ in range(self.length)], 0

    def _place(self, piece: Piece) -> None:
        size = len(piece[3]) // 4
        counts, top = self.counts, self.length - size
        # moving a window from level h to h + size changes the sum by 2 N(h + size) - 2 N(h) + 2, a full one by 1 - 2 N(h)
        change = 2 * counts[size:] - 2 * counts[:top + 1] + 2
        change[counts[:top + 1] == 0] = np.iinfo(np.int64).max
        if counts[top]:
            change[top] = 1 - 2 * counts[top]
        change[0] = 2 * counts[size] + 1
        level = top - int(np.argmin(change[::-1]))  # of equal ones the fullest
        pieces = [*self._take(level), piece] if level else [piece]
        self._put(pieces, level + size)

    def _take(self, level: int) -> list[Piece]:
        self.counts[level] -= 1
        self.open -= 1
        return self.windows[level].pop()

    def _put(self, pieces: list[Piece], level: int) -> None:
        if level == self.length:
            return self._leave(pieces)
        if level:
            self.counts[level] += 1
            self.open += 1
            self.windows[level].append(pieces)

    def _level_out(self) -> None:
        """Cuts up the emptiest windows into the gaps of the fullest, until at most one is open."""
        while self.open > 1:
            levels = np.flatnonzero(self.counts)
            high, low = int(levels[-1]), int(levels[0])
            full, giver = self._take(high), self._take(low)
            part, rest = _cut(giver, min(low, self.length - high))
            moved = sum(len(p[3]) for p in part) // 4
            self._put(full + part, high + moved)
            self._put(rest, low - moved)

    def _leave(self, pieces: list[Piece]) -> None:
        offset = 0
        for doc_id, start, total, ids in pieces:
            self.rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), total, self.done, offset))
            offset += len(ids) // 4
        self.done += 1


def _cut(pieces: list[Piece], size: int) -> tuple[list[Piece], list[Piece]]:
    """The first ``size`` tokens of a window and the others."""
    head, tail = [], []
    for doc_id, start, total, ids in pieces:
        n = min(size, len(ids) // 4)
        size -= n
        if n:
            head.append((doc_id, start, total, ids[:n * 4]))
        if n < len(ids) // 4:
            tail.append((doc_id, start + n, total, ids[n * 4:]))
    return head, tail


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH, open_windows: int = OPEN) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and the end id 0, so a null or empty text is one token.  Every id lies in
    one piece; sequences hold at most ``length`` tokens and have gapless offsets from 0.  Only a
    sequence whose length is a power of two may be shorter than ``length``, so nothing is padded.
    sequence_id holds the task's number above its lowest 33 bits.  Rows that repeat a doc_id are
    documents of their own.  The result is written to the shared folder once, since another run of
    a task may see its rows in another order and pack them otherwise.  An empty table gives no rows.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    ids = docs.schema["doc_id"].dataType
    types = [pa.string() if ids.simpleString() == "string" else pa.int64(), *[pa.int64()] * 6]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, packer = encoder(vocabulary, lower=False), Packer(length, open_windows)
        first, end = TaskContext.get().partitionId() << 33, np.array([END], "<u4").tobytes()

        def finished() -> pa.RecordBatch:
            columns = list(zip(*packer.rows)) or [()] * 7
            packer.rows = []
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            arrays[5] = pa.array(np.array(columns[5], np.int64) + first)
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                packer.add(doc_id, codes.ids(text) + end)
            yield finished()
        packer.finish()
        yield finished()

    kind = "string" if ids.simpleString() == "string" else "bigint"
    rows = docs.select(F.col("doc_id").cast(kind), text_of().alias("text"))
    return saved(rows.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} bigint" for n in names[1:])), "packed")
