"""Items of large JSON documents: one array or object in one file, read by many tasks.

A file is cut into byte ranges.  What a range does to the reader's state depends only on whether it
begins inside a string, so each range is scanned once for both cases, the cases are composed file by
file, and every range then knows its depth and whether it begins inside a string.  The ranges with
their states are the partitions of a data source; each yields the items that begin in it, reading on
past its end where the last one does.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as filesystems
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range; bytes read at a time, and behind the end of a range; bytes of the items handed on at a time.
RANGE, BLOCK, REST, HANDED = 64 << 20, 1 << 20, 1 << 16, 4 << 20
SCHEMA = "path string, at bigint, key string, value string, error string"
ARROW = pa.schema([("path", pa.string()), ("at", pa.int64()), ("key", pa.string()), ("value", pa.string()), ("error", pa.string())])

_QUOTE, _SLASH, _COMMA, _COLON = (ord(c) for c in '"\\,:')
_STEP = np.zeros(256, np.int64)
_STEP[[ord("["), ord("{")]] = 1
_STEP[[ord("]"), ord("}")]] = -1


def _file(path: str) -> tuple[filesystems.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return filesystems.FileSystem.from_uri(path) if "://" in path else (filesystems.LocalFileSystem(), path)


class _Bytes:
    """A file's blocks from some place on."""

    def __init__(self, path: str):
        fs, name = _file(path)
        self.file = fs.open_input_file(name)

    def blocks(self, start: int, end: int | None = None, size: int = BLOCK) -> Iterator[tuple[int, bytes]]:
        at = start
        while end is None or at < end:
            data = self.file.read_at(size if end is None else min(size, end - at), at)
            if not data:
                return
            yield at, data
            at += len(data)

    def escaped(self, at: int) -> bool:
        """Whether the byte there follows an odd number of backslashes."""
        run, step = 0, 64
        while at - run > 0:
            low = max(0, at - run - step)
            data = self.file.read_at(at - run - low, low)
            kept = len(data.rstrip(b"\\"))
            run += len(data) - kept
            if kept:
                break
            step *= 4
        return run % 2 == 1


def _quotes(raw: np.ndarray, escaped: bool) -> tuple[np.ndarray, bool]:
    """Whether each byte is a quote that no backslash escapes, and whether the byte after them is escaped."""
    slash = raw == _SLASH
    place = np.arange(len(raw))
    last = np.maximum.accumulate(np.where(slash, -1, place))  # the last byte that is no backslash
    run = place - last  # backslashes up to here
    whole = last < 0
    odd = (run + (whole & escaped)) % 2 == 1
    before = np.concatenate([[escaped], odd[:-1]])
    return (raw == _QUOTE) & ~before, bool(odd[-1])


def range_effect(path: str, start: int, end: int) -> tuple[bool, int, int]:
    """(whether the range changes between inside and outside a string, depth gained if it begins outside, if inside)."""
    file = _Bytes(path)
    escaped, odd, gained = file.escaped(start), False, [0, 0]
    for _, data in file.blocks(start, end):
        raw = np.frombuffer(data, np.uint8)
        quotes, escaped = _quotes(raw, escaped)
        inside = (np.cumsum(quotes) + odd) % 2 == 1
        step = _STEP[raw]
        gained[0] += int(step[~inside].sum())
        gained[1] += int(step[inside].sum())
        odd ^= bool(quotes.sum() % 2)
    return odd, *gained


def items(path: str, start: int, end: int, inside: bool, depth: int) -> Iterator[tuple]:
    """(at, key, value, error) of the items whose opening bracket or comma lies in the range."""
    file = _Bytes(path)
    escaped = file.escaped(start)
    held: list[bytes] = []
    first = colon = None  # place after the separator that begins the open item; its colon, if it has one
    for at, data in chain(file.blocks(start, end), file.blocks(end, size=REST)):
        raw = np.frombuffer(data, np.uint8)
        quotes, escaped = _quotes(raw, escaped)
        within = (np.cumsum(quotes) + inside) % 2 == 1
        step = np.where(within, 0, _STEP[raw])
        level = depth + np.cumsum(step)
        ends = (step < 0) & (level == 0)
        cuts = np.flatnonzero(((raw == _COMMA) & ~within & (level == 1)) | (step > 0) & (level == 1) | ends)
        colons = np.flatnonzero((raw == _COLON) & ~within & (level == 1))
        low = 0
        for cut in cuts.tolist():
            if first is not None:
                if colon is None and (k := np.searchsorted(colons, low)) < len(colons) and colons[k] < cut:
                    colon = sum(map(len, held)) + int(colons[k]) - low
                held.append(data[low:cut])
                yield from _item(first, b"".join(held), colon, bool(ends[cut]))
            held, first, colon, low = [], None, None, cut + 1
            if at + cut >= end:
                return
            if not ends[cut]:
                first = at + cut + 1
        if first is not None:
            if colon is None and (k := np.searchsorted(colons, low)) < len(colons):
                colon = sum(map(len, held)) + int(colons[k]) - low
            held.append(data[low:])
        elif at + len(data) >= end:
            return
        inside, depth = bool(within[-1]), int(level[-1])
    if first is not None:
        yield first, None, None, f"unfinished item: {b''.join(held)[:80].decode('utf-8', 'replace').strip()}"


def _item(at: int, raw: bytes, colon: int | None, last: bool) -> Iterator[tuple]:
    text = raw.strip()
    if not text:
        if not last:
            yield at, None, None, "empty item"
        return
    try:
        if colon is not None:
            yield at, json.loads(raw[:colon]), raw[colon + 1:].strip().decode("utf-8"), None
        else:
            yield at, None, text.decode("utf-8"), None
    except (UnicodeDecodeError, json.JSONDecodeError) as error:
        yield at, None, None, f"damaged item: {error}"


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, inside: bool, depth: int):
        super().__init__((path, start))
        self.path, self.start, self.end, self.inside, self.depth = path, start, end, inside, depth


class _Reader(DataSourceReader):
    def __init__(self, ranges: list):
        self.ranges = ranges

    def partitions(self) -> list[InputPartition]:
        return [_Range(*r) for r in self.ranges]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for found in items(partition.path, partition.start, partition.end, partition.inside, partition.depth):
            rows.append((partition.path, *found))
            held += len(found[2] or "")
            if held >= HANDED or len(rows) >= 10_000:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), ARROW.types)], schema=ARROW)


class JsonItems(DataSource):
    """Format ``json_items``; the option ``ranges`` holds the ranges and their states as ``ranges_of`` gives them."""

    @classmethod
    def name(cls) -> str:
        return "json_items"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(json.loads(self.options["ranges"]))


def ranges_of(spark: SparkSession, path: str, size: int = RANGE) -> list[tuple]:
    """(path, start, end, inside, depth) of each range of all files under ``path``: a row per range, scanned by Spark."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")  # names and sizes only
    cut = files.where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(size).cast("bigint"))).alias("start"))
    cut = cut.select("path", "start", F.least(F.col("start") + size, "length").alias("end"))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                turns, outside, inside = range_effect(row["path"], row["start"], row["end"])
                yield pa.RecordBatch.from_pylist([{**row, "turns": turns, "outside": outside, "inside": inside}], schema)

    schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("turns", pa.bool_()), ("outside", pa.int64()), ("inside", pa.int64())])
    n = cut.count()
    effects = cut.repartition(_tasks(spark, n, size)).mapInArrow(scanned, "path string, start bigint, end bigint, turns boolean, outside bigint, inside bigint")

    def composed(ranges: pd.DataFrame) -> pd.DataFrame:
        inside, depth, out = False, 0, []
        for r in ranges.sort_values("start").itertuples():
            out.append((r.path, r.start, r.end, inside, depth))
            depth += r.inside if inside else r.outside
            inside ^= bool(r.turns)
        return pd.DataFrame(out, columns=["path", "start", "end", "inside", "depth"])

    states = effects.groupBy("path").applyInPandas(composed, "path string, start bigint, end bigint, inside boolean, depth bigint")
    return sorted(tuple(r) for r in states.collect())


def _tasks(spark: SparkSession, n: int, size: int) -> int:
    """Tasks for so many ranges: a few a core, and more where a task would read more than ``RANGE`` bytes."""
    return max(1, min(n, max(4 * spark.sparkContext.defaultParallelism, -(-n * size // RANGE))))


def joined(ranges: list[tuple], span: int) -> list[tuple]:
    """Ranges that follow each other in a file as one, of ``span`` bytes about; the first one's state holds for all."""
    out: list[tuple] = []
    for r in ranges:
        if out and out[-1][0] == r[0] and out[-1][2] == r[1] and r[2] - out[-1][1] <= span:
            out[-1] = (*out[-1][:2], r[2], *out[-1][3:])
        else:
            out.append(r)
    return out


def read_json_items(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """path, at (byte), key (of an object's item), value (JSON text) and error of every item of the arrays and objects under ``path``.

    An item that the end of the file cuts off, an empty one, and one that is not UTF-8 or has no right
    key come out with an error and no value.  Files that hold neither array nor object, and empty
    arrays, have no items.
    """
    spark.dataSource.register(JsonItems)
    ranges = ranges_of(spark, path, size)
    # a task a range costs more than reading it where ranges are small
    ranges = joined(ranges, -(-len(ranges) // _tasks(spark, len(ranges), size)) * size)
    return spark.read.format("json_items").option("ranges", json.dumps(ranges)).load()


def read_json_array(spark: SparkSession, path: str, schema: T.DataType | str, size: int = RANGE) -> DataFrame:
    """The items as columns of ``schema``, with ``error`` for those that are damaged."""
    found = read_json_items(spark, path, size).withColumn("_item", F.from_json("value", schema))
    return found.select("_item.*", "error")
