"""Repeated substrings by a sparse enhanced suffix array and its common-prefix interval tree.

Any 200-byte string holds 137 grams of 64 bytes, and the least of their hashes marks an anchor.  Two
equal strings hold the same anchor at the same place, so only suffixes that start at anchors need to
be sorted, about one in seventy.

1. Texts go to a store in the shared folder; a scan writes each anchor with the hash of its gram and
   of its context, the bytes that 200-byte strings around it can reach.
2. Anchors whose gram occurs once are done.  Where all contexts of a gram are equal, or one context
   occurs twice, the whole context is repeated: counts alone settle most copies, however many.
3. One anchor of each other context is looked up in the store.  Spark sorts these suffixes by gram
   and text, which is the suffix array; a stack scan over the longest common prefixes of neighbours
   gives the interval tree.  An interval of length l holds all occurrences of its prefix; those whose
   left extensions agree with another's over 200 - l bytes or more are occurrences of a long repeat.
   Intervals whose left extensions do not differ are extended as one.
4. Spans return to the store's files, which give each document's removed and kept bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import saved, scratch_path, shuffle_width, text_of
from scorelake.llm.token_files import place

#: Bytes of a string that counts as repeated, and of a gram.
LENGTH, GRAM = 200, 64
#: Distinct contexts of one gram that a task sorts; of a gram with more, every 200-byte string is counted by hash.
GROUP = 20_000
#: Bytes hashed at a time; a longer text is taken alone.
CHUNK = 1 << 20
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse, modulo 2 ** 64."""
    one = np.ones(1, np.uint64)
    return tuple(np.cumprod(np.concatenate([one, np.full(n, b, np.uint64)]), dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64)))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Hashes:
    """Hashes of any stretches of a run of bytes."""

    def __init__(self, raw: np.ndarray, powers: tuple[np.ndarray, np.ndarray]):
        power, self.inverse = powers
        sums = np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:len(raw)], dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), sums])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.inverse[start])

    def all(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mixed((self.sums[size:] - self.sums[:n]) * self.inverse[:n])


def _sliding_least(x: np.ndarray, window: int) -> np.ndarray:
    size = 1
    while size * 2 <= window:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:len(x) - (window - size)], x[window - size:]) if window > size else x


def anchors(texts: list[bytes], powers, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text number, place, gram hash, context hash) of the anchors of texts of ``length`` bytes and over."""
    none = [np.array([], t) for t in (np.int64, np.int64, np.uint64, np.uint64)]
    sizes = np.array([len(t) for t in texts], np.int64)
    joined = np.frombuffer(b"".join(texts), np.uint8)
    if len(joined) < length:
        return tuple(none)
    if len(powers[0][0]) <= len(joined):
        powers = [_powers(b, len(joined)) for b in BASES]
    ends = np.cumsum(sizes)
    starts = ends - sizes
    grams = Hashes(joined, powers[0]).all(gram)
    of = np.repeat(np.arange(len(texts)), sizes)
    fits = of[:len(grams)] == of[gram - 1:]
    place_ = np.arange(len(grams), dtype=np.uint64)
    rank = np.where(fits, (grams >> np.uint64(32) << np.uint64(32)) | place_, np.uint64(0xFFFFFFFFFFFFFFFF))
    window = length - gram + 1
    least = _sliding_least(rank, window)
    inside = of[:len(least)] == of[length - 1:length - 1 + len(least)]  # windows that lie in one text
    at = np.unique(least[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = of[at]
    low, high = np.maximum(starts[text], at + gram - length), np.minimum(ends[text], at + length)
    context = Hashes(joined, powers[1]).of(low, high) ^ _mixed(((at - low) << 32 | (high - at)).astype(np.uint64))
    return text, at - starts[text], grams[at], context


def _store(docs: DataFrame) -> DataFrame:
    """doc_id and text in new files; row (file number above the lowest 32 bits, row in the file) and path."""
    path = scratch_path(docs.sparkSession, "texts")
    docs.select("doc_id", text_of().alias("text")).write.option("compression", "zstd").parquet(path)
    kept = docs.sparkSession.read.schema(docs.select("doc_id", "text").schema).parquet(path)
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)-", 1).cast("bigint")
    piece = F.regexp_extract("_metadata.file_name", r"-c(\d+)\.", 1).cast("bigint")
    return kept.select("doc_id", "text", (F.shiftleft(part * 4096 + piece, 32) + F.col("_metadata.row_index")).alias("row"), F.col("_metadata.file_path").alias("path"))


def _anchor_table(store: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = [_powers(b, CHUNK + 1) for b in BASES]

        def found(rows: list[int], texts: list[bytes]) -> pa.RecordBatch:
            text, at, grams, context = anchors(texts, powers, length, gram)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.array(rows, np.int64)[text]), pa.array(at.astype(np.int32)), pa.array(grams.view(np.int64)), pa.array(context.view(np.int64))], ["row", "place", "gram", "context"])

        for batch in batches:
            rows, texts, size = [], [], 0
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                if len(raw) < length:
                    continue
                if rows and size + len(raw) > CHUNK:
                    yield found(rows, texts)
                    rows, texts, size = [], [], 0
                rows.append(row)
                texts.append(raw)
                size += len(raw)
            if rows:
                yield found(rows, texts)

    return saved(store.select("row", "text").mapInArrow(run, "row bigint, place int, gram bigint, context bigint"), "anchors")


def _by_file(rows: DataFrame, files: DataFrame, extra: list[str]) -> DataFrame:
    """``rows`` (row, place, ...) dealt to tasks by file and sorted; first of each file a row with its path."""
    blank = files.select(
        F.shiftleft("file", 32).alias("row"), F.lit(-1).cast("int").alias("place"),
        *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in extra], "path", "file")
    told = rows.select("row", "place", *extra, F.lit(None).cast("string").alias("path"), F.shiftright("row", 32).alias("file"))
    width = shuffle_width(rows.sparkSession)
    return told.unionByName(blank).repartition(width, "file").sortWithinPartitions("file", F.col("path").isNull(), "row", "place")


def _files_of(batches: Iterator[pa.RecordBatch], extra: list[str]) -> Iterator[tuple[str, Iterator[tuple]]]:
    """Each file's path with its rows (row, place, extra ...), in order."""
    rows = (x for b in batches for x in zip(*(b.column(c).to_pylist() for c in ("file", "path", "row", "place", *extra))))
    for _, own in groupby(rows, key=lambda x: x[0]):
        path = next(own)[1]
        yield path, (x[2:] for x in own)


def _texts(path: str, columns: list[str]) -> Iterator[tuple]:
    """(row in the file, values ...) of a store file, a few MB at a time."""
    fs, name = place(path)
    number = 0
    with fs.open_input_file(name) as file:
        for batch in pq.ParquetFile(file).iter_batches(batch_size=256, columns=columns):
            for values in zip(*(batch.column(c).to_pylist() for c in columns)):
                yield number, *values
                number += 1


def _looked_up(rows: Iterator[tuple], path: str) -> Iterator[tuple[bytes, tuple]]:
    """The text of each row, beside the row."""
    texts = _texts(path, ["text"])
    at, raw = -1, b""
    for x in rows:
        while at < x[0] & 0xFFFFFFFF:
            at, text = next(texts)
            if at == x[0] & 0xFFFFFFFF:
                raw = text.encode("utf-8", "surrogatepass")
        yield raw, x


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 1:
        half = (low + n) // 2
        if a[low:half] == b[low:half]:
            low = half
        else:
            n = half
    return low


def intervals(common: list[int]) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of the common-prefix interval tree; ``common[i]``: of the suffixes i and i + 1.

    Children come before their parents; leaves and the root are left out.
    """
    stack: list[tuple[int, int]] = [(0, 0)]
    for i, here in enumerate([*common, 0]):
        first = i
        while stack and stack[-1][0] > here:
            length, first = stack.pop()
            yield length, first, i
        if not stack or stack[-1][0] < here:
            stack.append((here, first))


def repeats(suffixes: list[bytes], lefts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, int, int]]:
    """(suffix number, bytes to its left, bytes from it on) of every maximal long repeat around an anchor.

    ``suffixes`` in order; ``lefts``: what stands before each, backwards.
    """
    common = [_common(a, b) for a, b in zip(suffixes, suffixes[1:])]
    for right, first, last in intervals(common):
        if right < gram:
            continue
        own = range(first, last + 1)
        need = length - right
        if all(lefts[i] == lefts[first] for i in own):  # no two differ to the left: one repeat with all its occurrences
            if len(lefts[first]) >= need:
                for i in own:
                    yield i, len(lefts[i]), right
            continue
        order = sorted(own, key=lefts.__getitem__)
        agreed = [0, *(_common(lefts[a], lefts[b]) for a, b in zip(order, order[1:])), 0]
        for k, i in enumerate(order):
            left = max(agreed[k], agreed[k + 1])
            if left >= need:
                yield i, left, right


def _contexts(found: DataFrame, files: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, rows in _files_of(batches, ["gram"]):
            out = []
            for raw, (row, at, g) in _looked_up(rows, path):
                out.append((g, row, at, raw[at:at + length], raw[max(0, at + gram - length):at][::-1]))
                if len(out) == 4096:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["gram", "row", "place", "suffix", "left"])

    return _by_file(found, files, ["gram"]).mapInArrow(run, "gram bigint, row bigint, place int, suffix binary, left binary")


def _sorted_spans(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """Spans from the suffixes, which Spark sorts by gram and text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (x for b in batches for x in zip(*(b.column(c).to_pylist() for c in ("gram", "row", "place", "suffix", "left"))))
        out = []
        for _, own in groupby(rows, key=lambda x: x[0]):
            own = list(own)
            if len(own) > 1:
                for i, left, right in repeats([x[3] for x in own], [x[4] for x in own], length, gram):
                    out.append((own[i][1], own[i][2] - left, own[i][2] + right))
            if len(out) >= 8192:
                yield spans(out)
                out = []
        if out:
            yield spans(out)

    def spans(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32()))], ["row", "place", "end"])

    width = shuffle_width(contexts.sparkSession)
    return contexts.repartition(width, "gram").sortWithinPartitions("gram", "suffix").mapInArrow(run, "row bigint, place int, end int")


def _counted_spans(found: DataFrame, files: DataFrame, length: int, gram: int) -> DataFrame:
    """For grams with very many contexts: each string around an anchor, known by two hashes, is counted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = [_powers(b, 2 * length) for b in BASES]
        for path, rows in _files_of(batches, ["gram"]):
            for raw, (row, at, g) in _looked_up(rows, path):
                low = max(0, at + gram - length)
                part = np.frombuffer(raw[low:at + length], np.uint8)
                if len(part) >= length:
                    one, two = (Hashes(part, p).all(length).view(np.int64) for p in powers)
                    start = low + np.arange(len(one))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(one), row)), pa.array(start.astype(np.int32)), pa.array(one), pa.array(two)], ["row", "place", "one", "two"])

    strings = saved(_by_file(found, files, ["gram"]).mapInArrow(run, "row bigint, place int, one bigint, two bigint"), "strings")
    where = F.struct("row", "place")  # several anchors may bring the same string of one place
    twice = saved(strings.groupBy("one", "two").agg((F.min(where) != F.max(where)).alias("twice")).where("twice").drop("twice"), "twice")
    return strings.join(twice, ["one", "two"], "left_semi").select("row", "place", (F.col("place") + length).cast("int").alias("end"))


def _removed(spans: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Maximal runs of sorted spans."""
    now = None
    for start, end in spans:
        if now and start <= now[1]:
            now = (now[0], max(now[1], end))
        else:
            if now:
                yield now
            now = (start, end)
    if now:
        yield now


def _results(spans: DataFrame, files: DataFrame, ids: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, rows in _files_of(batches, ["end"]):
            marked = groupby(rows, key=lambda x: x[0] & 0xFFFFFFFF)
            at, own = next(marked, (None, None))
            out = []
            for number, doc_id, text in _texts(path, ["doc_id", "text"]):
                raw, runs = text.encode("utf-8", "surrogatepass"), []
                if at == number:
                    runs = list(_removed((s, min(e, len(raw))) for _, s, e in own))
                    at, own = next(marked, (None, None))
                digest, last = hashlib.sha256(), 0
                for s, e in runs:
                    digest.update(raw[last:s])
                    last = e
                digest.update(raw[last:])
                out.append((doc_id, len(raw), sum(e - s for s, e in runs), len(runs), digest.hexdigest()))
                if len(out) == 4096:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)

    kind = pa.string() if ids == "string" else pa.int64()

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), (kind, pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _by_file(spans, files, ["end"]).mapInArrow(run, f"doc_id {ids}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """Spans (row, place, end) of the repeated bytes, and the files (file, path) of the store that the rows are in."""
    store = _store(docs)
    files = saved(store.select(F.shiftright("row", 32).alias("file"), "path").distinct(), "files")
    found = _anchor_table(store, length, gram)
    # written, so that the join's sides are plain exchanges and a gram with very many anchors can be split
    counts = saved(found.groupBy("gram").agg(
        F.count(F.lit(1)).alias("n"), (F.min("context") == F.max("context")).alias("same")).where("n > 1").drop("n"), "counts")
    again = saved(found.join(counts, "gram"), "repeated")
    mixed = again.where("NOT same")
    classes = saved(mixed.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "place")).alias("one")), "contexts")
    copies = mixed.join(classes.where("n > 1").select("gram", "context"), ["gram", "context"], "left_semi")
    # a whole context is repeated; what reaches beyond the text is cut where the text is at hand
    whole = again.where("same").select("row", "place").unionByName(copies.select("row", "place")).select(
        "row", F.greatest(F.col("place") + (gram - length), F.lit(0)).cast("int").alias("place"), (F.col("place") + length).cast("int").alias("end"))
    large = saved(classes.groupBy("gram").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > group).select("gram"), "large")
    each = classes.select("gram", "one.row", "one.place")
    few = each.join(large, "gram", "left_anti")
    sorted_ = _sorted_spans(_contexts(few, files, length, gram), length, gram)
    counted = _counted_spans(each.join(large, "gram", "left_semi"), files, length, gram)
    return whole.unionByName(sorted_).unionByName(counted), files


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Every byte covered by a string of ``length`` bytes that also starts elsewhere, in the same
    document or another one, is removed; overlaps count, strings never cross documents and are
    judged on the input.  Null texts are empty; texts under ``length`` bytes lose nothing; rows that
    repeat a doc_id are documents of their own.  An empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    kind = "string" if kind == "string" else "bigint"
    spans, files = repeated_spans(docs.select(F.col("doc_id").cast(kind).alias("doc_id"), "text"), length, gram, group)
    return _results(spans, files, kind)
