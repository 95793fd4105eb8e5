"""SimHash near-duplicates found through the anchors of a covering code.

Two fingerprints that differ in at most four of 64 bits differ in at most one bit in one of three
blocks (21, 21 and 22 bits).  Each block is covered by the direct sum of the [15, 11] Hamming code
(a perfect code of radius 1) and of all words of its remaining bits, so every block value has its
home anchor within distance 1.  A fingerprint goes to every anchor within covering radius plus
threshold, 1 + 1, of its block value; a pair then meets at the home anchor of either.  Per anchor,
homes are compared with all that came, in tiles, and only a spanning forest of the links leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import keep_rows, plain, saved, shuffle_width
from scorelake.llm.components import components

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: (first bit, width) of the blocks.
BLOCKS = ((0, 21), (21, 21), (42, 22))
HAMMING = 15
#: Rows of one anchor that one task compares; larger anchors are dealt out as a grid of such cells.
CELL_ROWS = 20_000


def fingerprint(text: str | None) -> int:
    """Of whole texts: bit j is 1 if set in over half of the XXH64 values of the 4-word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()[SHINGLE - 1:] or [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends)], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at:at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and fp (a long) of every row, written to the shared folder."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(fps, pa.int64())], ["doc_id", "text_key", "fp"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return saved(plain(docs).mapInArrow(run, f"doc_id {ids}, text_key bigint, fp bigint"), "fingerprints")


def _pairs_of_syndrome() -> np.ndarray:
    """Row s: the masks of the seven pairs of bits whose positions (from 1) have the exclusive or s."""
    out = np.zeros((HAMMING + 1, 7), np.int64)
    for s in range(1, HAMMING + 1):
        out[s] = [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, HAMMING + 1) if i < (i ^ s)]
    return out


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """anchor, home, index of the fingerprint: every anchor within distance 2 in each block."""
    pairs, keys, homes, index = _pairs_of_syndrome(), [], [], []
    bits = fps.view(np.uint64)
    for number, (first, width) in enumerate(BLOCKS):
        value = ((bits >> np.uint64(first)) & np.uint64((1 << width) - 1)).astype(np.int64)
        code, rest = value & ((1 << HAMMING) - 1), value >> HAMMING
        syndrome = np.zeros(len(value), np.int64)
        for i in range(HAMMING):
            syndrome ^= np.where((code >> i) & 1, i + 1, 0)
        home = code ^ np.where(syndrome > 0, 1 << np.maximum(syndrome - 1, 0), 0)
        flips = [1 << i for i in range(width - HAMMING)]
        everyone, off = np.arange(len(value)), np.flatnonzero(syndrome)
        on = np.flatnonzero(syndrome == 0)
        found = [(home, rest, everyone)] + [(home, rest ^ f, everyone) for f in flips]
        found += [(code[off] ^ pairs[syndrome[off], k], rest[off], off) for k in range(7)]
        found += [(home[on], rest[on] ^ f ^ g, on) for f in flips for g in flips if f < g]
        for k, (c, r, i) in enumerate(found):
            keys.append(np.int64(number << 22) | (r << HAMMING) | c)
            homes.append(np.full(len(i), k == 0))
            index.append(i)
    return np.concatenate(keys), np.concatenate(homes), np.concatenate(index)


def _counted(nodes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, _, _ = anchors(batch.column("fp").to_numpy())
            found, n = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], ["anchor", "n"])

    return nodes.select("fp").mapInArrow(run, "anchor bigint, n bigint").groupBy("anchor").agg(F.sum("n").alias("n"))


def _forest(fps: np.ndarray, homes: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within one cell as (member, least member of its piece); compared in tiles of a few MB."""
    root, bits = np.arange(len(fps)), fps.view(np.uint64)  # signed numbers would count the bits of their absolute value

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return int(i)

    tile = max(1, (1 << 20) // max(1, len(fps)))
    at = np.flatnonzero(homes)
    for start in range(0, len(at), tile):
        block = at[start:start + tile]
        i, j = np.nonzero(np.bitwise_count(bits[block][:, None] ^ bits[None, :]) <= max_bits)
        a, b = root[block[i]], root[j]
        apart = a != b
        for x, y in np.unique(np.stack([a[apart], b[apart]], 1), axis=0):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
        while not np.array_equal(root, root[root]):
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(fps)))
    return fps[moved], fps[root[moved]]


def links(nodes: DataFrame, max_bits: int = MAX_BITS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """u, v: fingerprints joined by links of at most ``max_bits`` (up to four) bits, as forests per anchor.

    ``nodes``: distinct fingerprints fp.  Every link is inside one piece of some forest.
    """
    assert max_bits <= MAX_BITS
    spark = nodes.sparkSession
    large = _counted(nodes).where(F.col("n") > cell_rows).collect()  # no more than the 2^19 anchors that exist
    cells = spark.sparkContext.broadcast({r.anchor: -(-r.n // cell_rows) for r in large})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            key, home, index = anchors(fps)
            cell = np.zeros(len(key), np.int64)
            if cells.value:
                side = np.array([cells.value.get(k, 1) for k in key.tolist()], np.int64)
                many = np.flatnonzero(side > 1)
                own = (fps[index[many]].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % side[many]
                # a home row waits in its row of the grid, every row calls at its column
                times = side[many]
                which = np.repeat(np.arange(len(many)), times)
                step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                parts = [(np.flatnonzero(side == 1), home[side == 1], cell[side == 1])]
                parts.append((many[which], np.zeros(len(which), bool), step * side[many][which] + own[which]))
                hw = which[home[many][which]]
                hs = step[home[many][which]]
                parts.append((many[hw], np.ones(len(hw), bool), own[hw] * side[many][hw] + hs))
                rows, home, cell = (np.concatenate(x) for x in zip(*parts))
                key, index = key[rows], index[rows]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(cell), pa.array(home), pa.array(fps[index])], ["anchor", "cell", "home", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            part = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            held = part if held is None else [np.concatenate(x) for x in zip(held, part)]
            change = np.flatnonzero((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0)) + 1
            if len(change):
                yield from settle([x[:change[-1]] for x in held], change[:-1])
                held = [x[change[-1]:] for x in held]
        if held is not None and len(held[0]):
            yield from settle(held, np.array([], np.int64))

    def settle(held: list[np.ndarray], change: np.ndarray) -> Iterator[pa.RecordBatch]:
        bounds = np.concatenate([[0], change, [len(held[0])]]).astype(np.int64)
        found = []
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if e - s > 1 and held[2][s:e].any():
                fps, home = held[3][s:e], held[2][s:e]
                u, v = _forest(fps, home, max_bits)
                if len(u):
                    found.append((u, v))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["u", "v"])

    dealt = nodes.select("fp").mapInArrow(deal, "anchor bigint, cell bigint, home boolean, fp bigint")
    sorted_ = dealt.repartition(shuffle_width(spark), "anchor", "cell").sortWithinPartitions("anchor", "cell")
    return sorted_.mapInArrow(compare, "u bigint, v bigint").where("u <> v").distinct()


def near_groups(docs: DataFrame, max_bits: int = MAX_BITS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, text_key.

    A-Z is lower-cased, words are runs without ASCII white space, shingles of four words repeat.  Of
    fewer words the whole sequence is the shingle; no words (null, empty) give fingerprint zero,
    which links like any other.  component_id is the smallest doc_id reachable over links of at
    most ``max_bits`` differing bits.  Rows with a null doc_id take part; a component of such rows
    alone has a null component_id.  Rows that repeat a doc_id are separate texts.
    """
    base = fingerprints(docs)
    nodes = saved(base.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    stars = components(links(nodes, max_bits, cell_rows))
    rooted = nodes.join(stars, nodes["fp"] == stars["u"], "left").select(nodes["fp"], "least", F.coalesce("v", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(named, "root").select("fp", "component_id")
    return base.join(classes, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "text_key")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each component, that with the smallest doc_id, with all its columns.

    Rows of components without any doc_id all stay.
    """
    groups = near_groups(docs)
    first = groups.where("doc_id = component_id").groupBy("component_id").agg(F.min("text_key").alias("text_key"))
    first = first.select(F.col("component_id").alias("doc_id"), "text_key")
    first = first.unionByName(groups.where("component_id IS NULL").select("doc_id", "text_key"))
    return keep_rows(docs, first, one_of_each=True)
