"""Benchmark decontamination by winnowing.

Of each text the least hash of every 9 neighbouring 5-word grams is kept, so any 13 words that a
document and an item share hold one gram kept in both.  A bit map of fixed size, filled from the
items' grams, lets a scan drop most document grams at once; the rest join the items' grams and are
extended word by word, which settles every hit exactly.  Items of under 13 words are one window of
their own length; for each such length all document grams of that length are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import keep_rows, saved, text_key, text_of

WINDOW = 13
GRAM = 5
#: Words that a hit may reach beyond its gram on either side.
REACH = WINDOW - GRAM
#: Bits of the map, as a power of two: 8 MB, whatever the size of the benchmark.
MAP_BITS = 26
#: Bytes of text hashed at a time, in Python's memory some hundred times that at worst; a longer text is taken alone.
CHUNK = 1 << 18
#: Rows whose texts are Python's at a time.
ROWS = 256
BASE = 0x9E3779B97F4A7C15 | 1

_BYTES = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_WORD = ((_LOWER >= 48) & (_LOWER <= 57)) | ((_LOWER >= 97) & (_LOWER <= 122)) | (_LOWER >= 128)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse, modulo 2 ** 64."""
    inverse = pow(BASE, -1, 1 << 64)
    one = np.ones(1, np.uint64)
    return tuple(np.cumprod(np.concatenate([one, np.full(n, b, np.uint64)]), dtype=np.uint64) for b in (BASE, inverse))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of some texts end to end: their bytes, bounds, hashes and text numbers."""

    def __init__(self, texts: list[bytes], powers: tuple[np.ndarray, np.ndarray]):
        joined = b"\n".join(texts) + b"\n"
        self.bytes = _LOWER[np.frombuffer(joined, np.uint8)]
        inside = np.concatenate([[False], _WORD[self.bytes]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edges[::2], edges[1::2]
        power, inverse = powers if len(powers[0]) > len(joined) else _powers(len(joined))
        summed = np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * power[:len(joined)], dtype=np.uint64)
        total = np.concatenate([np.zeros(1, np.uint64), summed])
        self.hash = _mixed((total[self.end] - total[self.start]) * inverse[self.start])
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.text = np.searchsorted(ends, self.start, side="right")
        self.first = np.searchsorted(self.text, np.arange(len(texts) + 1))

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``size`` words from each word on, and whether they lie in one text."""
        n = max(0, len(self.hash) - size + 1)
        h = np.full(n, size, np.uint64)
        for j in range(size):
            h = h * np.uint64(BASE) + self.hash[j:j + n]
        return _mixed(h), self.text[:n] == self.text[size - 1:size - 1 + n]

    def words(self, a: int, b: int) -> list[str]:
        return [self.bytes[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(self.start[a:b], self.end[a:b])]


def winnowed(h: np.ndarray, valid: np.ndarray, window: int) -> np.ndarray:
    """Places of the least valid hash of every ``window`` neighbours; of equal ones the last."""
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    if not len(h):
        return np.array([], np.int64)
    h = np.where(valid, np.minimum(h, none - np.uint64(1)), none)
    padded = np.concatenate([np.full(window - 1, none), h, np.full(window - 1, none)])
    n = len(padded) - window + 1
    best, place = padded[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, window):
        later = padded[j:j + n] <= best
        best = np.where(later, padded[j:j + n], best)
        place[later] = j
    chosen = np.unique((np.arange(n) + place - (window - 1))[best != none])
    return chosen


def _prints(words: Words, short: tuple[int, ...], keep) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(gram size, whether winnowed, places, hashes) of the fingerprints that ``keep`` lets through."""
    h, valid = words.grams(GRAM)
    at = winnowed(h, valid, WINDOW - GRAM + 1)
    out = [(GRAM, at[(k := keep(h[at]))], h[at][k])]
    for size in short:
        h, valid = words.grams(size)
        h = _mixed(h ^ np.uint64(0x5851F42D4C957F2D))  # apart from winnowed grams of the same size
        at = np.flatnonzero(valid)
        out.append((-size, at[(k := keep(h[at]))], h[at][k]))
    return out


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    start, held, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if held and size + len(raw) > CHUNK:
            yield start, held
            start, held, size = i, [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield start, held


_HITS = "array<struct<place:int,size:int,hash:bigint,reach:int,words:array<string>>>"
_HITS_TYPE = pa.list_(pa.struct([("place", pa.int32()), ("size", pa.int32()), ("hash", pa.int64()), ("reach", pa.int32()), ("words", pa.list_(pa.string()))]))


def _scanned(df: DataFrame, short: tuple[int, ...], bits=None, items: bool = False) -> DataFrame:
    """``df``: key columns and text; adds n_words and the fingerprints with the words around them.

    ``items``: of a text under 13 words only the window that is the whole text, of others only winnowed grams.
    """
    keys = [c for c in df.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _powers(CHUNK * 2)
        if bits is None:
            keep = lambda h: np.ones(len(h), bool)
        else:
            keep = lambda h: (bits.value[(h >> np.uint64(64 - MAP_BITS + 3)).astype(np.int64)] >> ((h >> np.uint64(64 - MAP_BITS)) & np.uint64(7)).astype(np.uint8)) & 1 > 0
        for batch in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            for start, chunk in _chunks(batch.column("text").to_pylist()):
                words = Words(chunk, powers)
                lengths = np.diff(words.first)
                hits = [[] for _ in chunk]
                for size, at, hashes in _prints(words, short, keep):
                    of = words.text[at]
                    if items:
                        fits = lengths[of] >= WINDOW if size > 0 else lengths[of] == -size
                        at, hashes, of = at[fits], hashes[fits], of[fits]
                    reach = REACH if size > 0 else 0
                    for p, t, h in zip(at.tolist(), of.tolist(), hashes.view(np.int64).tolist()):
                        first, last = words.first[t], words.first[t + 1]
                        a, b = max(first, p - reach), min(last, p + abs(size) + reach)
                        hits[t].append({"place": p - int(first), "size": size, "hash": h, "reach": p - int(a), "words": words.words(int(a), int(b))})
                # a chunk goes on at once: no more than its hits are held
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k).slice(start, len(chunk)) for k in keys] + [pa.array(lengths, pa.int64()), pa.array(hits, _HITS_TYPE)], [*keys, "n_words", "hits"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name in keys)
    return df.mapInArrow(run, f"{kinds}, n_words bigint, hits {_HITS}")


def _bit_map(prints: DataFrame) -> np.ndarray:
    """One bit for each value of the first MAP_BITS bits of a hash; at most 2 ** MAP_BITS / 64 rows are fetched."""
    cell = F.shiftrightunsigned("hash", 64 - MAP_BITS)
    rows = prints.groupBy(F.shiftright(cell, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - MAP_BITS}) & 63 AS int))")).alias("bits")).toPandas()
    out = np.zeros(1 << (MAP_BITS - 6), np.int64)
    out[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out.view(np.uint8)


def _agreed(theirs: list[str], ours: list[str]) -> int:
    n = 0
    for a, b in zip(theirs, ours):
        if a != b:
            break
        n += 1
    return n


def _extended(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The shared span around each pair of equal grams, where it holds a window."""
    for part in parts:
        out = []
        for row, item, place, size, reach, words, i_reach, i_words in zip(
                part["row"], part["item_id"], part["place"], part["size"], part["reach"], part["words"], part["i_reach"], part["i_words"]):
            words, i_words, n = list(words), list(i_words), abs(size)
            if words[reach:reach + n] != i_words[i_reach:i_reach + n]:
                continue
            left = _agreed(words[:reach][::-1], i_words[:i_reach][::-1])
            right = _agreed(words[reach + n:], i_words[i_reach + n:])
            if size < 0 or left + n + right >= WINDOW:
                out.append((row, item, place - left, place + n + right))
        yield pd.DataFrame(out, columns=["row", "item_id", "start", "end"])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_key.

    Words are runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII.  A window
    is 13 consecutive words of an item, or all words of a shorter one; a document word inside any
    occurrence of a window is hit.  contaminated: n_hit > 0 and 20 * n_hit >= n_words.  Null texts
    and texts without words have no words, such items no window; repeated items count once by
    item_id.  An empty benchmark leaves every document clean.
    """
    item_texts = benchmark.select("item_id", text_of().alias("text"))
    sizes = saved(_scanned(item_texts, (), None, True).select("n_words").where(f"n_words BETWEEN 1 AND {WINDOW - 1}").distinct(), "sizes")
    short = tuple(sorted(r.n_words for r in sizes.collect()))  # at most twelve numbers
    items = saved(_scanned(item_texts, short, None, True).select("item_id", F.explode("hits").alias("h")).select(
        "item_id", F.col("h.size").alias("size"), F.col("h.hash").alias("hash"), F.col("h.reach").alias("i_reach"), F.col("h.words").alias("i_words")), "items")
    bits = docs.sparkSession.sparkContext.broadcast(_bit_map(items))
    numbered = docs.select("doc_id", text_key().alias("text_key"), text_of().alias("text"))
    base = saved(_scanned(numbered, short, bits).withColumn("row", F.monotonically_increasing_id()), "scanned")
    found = base.where(F.size("hits") > 0).select("row", F.explode("hits").alias("h")).select(
        "row", F.col("h.place").alias("place"), F.col("h.size").alias("size"), F.col("h.hash").alias("hash"), F.col("h.reach").alias("reach"), F.col("h.words").alias("words"))
    kind = benchmark.schema["item_id"].dataType.simpleString()
    spans = found.join(items, ["hash", "size"]).mapInPandas(_extended, f"row bigint, item_id {kind}, start int, end int")
    told = spans.groupBy("row").agg(
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"), F.collect_set(F.struct("start", "end")).alias("spans"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["end"] - 1)))))
    told = told.select("row", covered.cast("bigint").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"))
    full = base.drop("hits").join(told, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), "text_key")
    return full.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", F.expr("n_hit > 0 AND 20 * n_hit >= n_words").alias("contaminated"), "text_key")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    return keep_rows(docs, contamination(docs, benchmark).where("contaminated"), keep=False)
