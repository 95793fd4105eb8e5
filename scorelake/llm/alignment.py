"""Links between the tokens of two vocabularies, by products of incidence matrices in row form.

1. A text is cut into stretches, before each space or line end that follows a printable Latin
   character: neither vocabulary has a token across such a place, so each different stretch is
   encoded and aligned once and remembered.
2. The matrix A has a row for each token of the first vocabulary and a one at each byte it covers, B
   the same of the second.  The row products A Bᵀ are the overlap links, with the number of shared
   bytes.  Where no overlap link crosses, both sides have a token end: these places cut the groups.
3. The products of the tokens' group incidence, gathered by id, are the shared-group links: every pair
   of ids with its number of occurrences.
4. Chunks of documents send each block of pairs their own document counts as sorted lists; the
   block's task adds them up and answers with the whole corpus' counts.  The highest count of each id
   of the first vocabulary is a list as long as that vocabulary, which every task may hold.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from scorelake.llm.common import scratch_path, shuffle_width, saved, text_of
from scorelake.llm.suffix_dedup import _mixed
from scorelake.llm.token_files import place
from scorelake.llm.tokens import byte_names, encoder

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text that one chunk of documents holds; a longer text is taken alone.
CHUNK = 4 << 20
#: Stretches, and characters of stretches, that a worker remembers.
STRETCHES, CHARACTERS = 250_000, 8 << 20
#: Products that are formed before they are added up.
PRODUCTS = 1 << 21

_CUT = re.compile("(?<=[!-~¡-ɏ])(?=[ \n])")
_UNSURE = re.compile("[^!-~¡-ɏ][ \n]|\0")
_PAIR = np.uint64(40)


class Rows:
    """A sparse matrix, row after row: places of the entries, their columns and their values."""

    def __init__(self, pointers: np.ndarray, columns: np.ndarray, values: np.ndarray):
        self.pointers, self.columns, self.values = pointers, columns, values

    @classmethod
    def of(cls, row: np.ndarray, column: np.ndarray, n: int) -> Rows:
        """From entries of value one, added up where they meet."""
        order = np.lexsort((column, row))
        row, column = row[order], column[order]
        first = _starts(row, column)
        counts = np.diff(np.concatenate([first, [len(row)]]))
        return cls(np.searchsorted(row[first], np.arange(n + 1)), column[first], counts)

    def __len__(self) -> int:
        return len(self.pointers) - 1

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.pointers))


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Places where any of the sorted keys changes."""
    if not len(keys[0]):
        return np.array([], np.int64)
    new = np.zeros(len(keys[0]) - 1, bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    return np.flatnonzero(np.concatenate([[True], new]))


def product(left: Rows, right: Rows) -> Rows:
    """Row i of the result adds up the rows of ``right`` that row i of ``left`` names; some rows of ``left`` at a time."""
    sizes = np.diff(right.pointers)[left.columns]
    upto = np.concatenate([[0], np.cumsum(sizes)])[left.pointers]
    row, column, value = [], [], []
    at = 0
    while at < len(left):
        last = max(at + 1, int(np.searchsorted(upto, upto[at] + PRODUCTS, side="right")) - 1)
        a, b = left.pointers[at], left.pointers[last]
        n = sizes[a:b]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(right.pointers[left.columns[a:b]], n)
        r = np.repeat(np.repeat(np.arange(at, last), np.diff(left.pointers[at:last + 1])), n)
        c, v = right.columns[inner], np.repeat(left.values[a:b], n) * right.values[inner]
        order = np.lexsort((c, r))
        r, c = r[order], c[order]
        first = _starts(r, c)
        row.append(r[first])
        column.append(c[first])
        value.append(np.add.reduceat(v[order], first) if len(first) else v)
        at = last
    empty = np.array([], np.int64)
    row, column, value = (np.concatenate(x) if x else empty for x in (row, column, value))
    return Rows(np.searchsorted(row, np.arange(len(left) + 1)), column, value)


class Aligner:
    """Stretches met so far: ids, groups and linked pairs of each."""

    def __init__(self, first: str, second: str):
        self.first = encoder(first, False, True)
        path = second if os.path.isabs(second) else public_tokenizers.path(second)
        self.second = SentencePieceProcessor(model_file=path)
        back = {c: b for b, c in byte_names().items()}
        names = self.first.whole.get_vocab()
        self.size = max(names.values()) + 1
        raw = [b""] * self.size
        for name, number in names.items():
            raw[number] = bytes(back[c] for c in name) if all(c in back for c in name) else name.encode()
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        self.width = len(pieces)
        self.space = self.second.piece_to_id("▁")
        self.bytes = [_table(t) for t in (raw, [
            bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])]
        # an id's text after each mark that can stand before it
        self.said_a = np.array([[f"{mark}{i}" for i in range(self.size)] for mark in (",", ";", "\n")], object)
        self.said_b = np.array([[f"{mark}{i}" for i in range(self.width)] for mark in (",", "|")], object)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.characters, self.texts = 0, []
        self.numbers = np.zeros((0, 4), np.int64)  # tokens of either side, groups, links
        self.good = np.zeros(0, bool)
        self.pairs = Rows(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def stretches(self, text: str) -> list[str]:
        spaced = " " + text
        if _UNSURE.search(spaced):
            return _CUT.split(spaced)
        return spaced.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")[1:]

    def _seconds(self, stretches: list[str]) -> list[list[int]]:
        ids = self.second.encode([s[1:] if s[0] == " " else s for s in stretches], num_threads=1)
        # a line end: no token joins it to the space put in front; a space alone is not encoded
        return [([self.space] if s == " " else x) if s[0] == " " else x[1:] for s, x in zip(stretches, ids)]

    def learn(self, texts: list[list[str]]) -> None:
        """Aligns the stretches that are not remembered yet."""
        new = set().union(*texts)
        old = new - self.known.keys()
        size = sum(map(len, old))
        if self.known and (len(self.known) + len(old) > STRETCHES or self.characters + size > CHARACTERS):
            self.forget()
            old, size = new, sum(map(len, new))
        if not old:
            return
        self.characters += size
        old = list(old)
        raw = [s.encode("utf-8", "surrogatepass") for s in old]
        long = np.array([len(r) for r in raw], np.int64)
        joined = np.frombuffer(b"".join(raw), np.uint8)
        firsts, seconds = [self.first.ids(s) for s in old], self._seconds(old)
        sides = [
            (np.array([len(x) // 4 for x in firsts], np.int64), np.frombuffer(b"".join(firsts), "<u4").astype(np.int64)),
            (np.array([len(x) for x in seconds], np.int64), np.fromiter(chain.from_iterable(seconds), np.int64))]
        good = np.ones(len(old), bool)
        for (n, ids), (pointers, held) in zip(sides, self.bytes):
            good &= np.bincount(np.repeat(np.arange(len(old)), n), np.diff(pointers)[ids], len(old)).astype(np.int64) == long
        for (n, ids), (pointers, held) in zip(sides, self.bytes):
            own = np.repeat(np.arange(len(old)), long)
            stays = good[own]
            given = _gather(held, pointers, ids[np.repeat(good, n)])
            good[own[stays][given != joined[stays]]] = False
        sides = [(np.where(good, n, 0), ids[np.repeat(good, n)]) for n, ids in sides]
        self._align(*sides[0], *sides[1])
        self.good = np.concatenate([self.good, good])
        self.known.update(zip(old, range(len(self.known), len(self.known) + len(old))))

    def _align(self, n_a: np.ndarray, ids_a: np.ndarray, n_b: np.ndarray, ids_b: np.ndarray) -> None:
        many = len(n_a)
        own_a, own_b = np.repeat(np.arange(many), n_a), np.repeat(np.arange(many), n_b)
        long_a, long_b = np.diff(self.bytes[0][0])[ids_a], np.diff(self.bytes[1][0])[ids_b]
        total = int(long_a.sum())
        one = np.ones(total, np.int64)
        covers = Rows(np.concatenate([[0], np.cumsum(long_a)]), np.arange(total), one)
        covered = Rows(np.arange(total + 1), np.repeat(np.arange(len(ids_b)), long_b), one)
        overlap = product(covers, covered)
        group_a = np.zeros(len(ids_a), np.int64)
        if len(ids_a):
            low, high = overlap.columns[overlap.pointers[:-1]], overlap.columns[overlap.pointers[1:] - 1]
            group_a[1:] = np.cumsum(high[:-1] < low[1:])
        group_b = np.zeros(len(ids_b), np.int64)
        group_b[overlap.columns] = group_a[overlap.rows()]
        groups = int(group_a[-1]) + 1 if len(ids_a) else 0
        # rows: a stretch's ids of the first vocabulary; columns: groups, then ids of the second
        rows, row = np.unique(own_a * self.size + ids_a, return_inverse=True)
        links = product(Rows.of(row, group_a, len(rows)), Rows.of(group_b, ids_b, groups))
        pair = np.repeat(rows % self.size, np.diff(links.pointers)) * self.width + links.columns
        owner = np.repeat(rows // self.size, np.diff(links.pointers))
        pointers = np.searchsorted(owner, np.arange(1, many + 1))
        self.pairs = Rows(np.concatenate([self.pairs.pointers, self.pairs.pointers[-1] + pointers]), np.concatenate([self.pairs.columns, pair]), np.concatenate([self.pairs.values, links.values]))
        own_g = np.zeros(groups, np.int64)
        own_g[group_a] = own_a
        numbers = [n_a, n_b, np.bincount(own_g, minlength=many), np.bincount(owner, links.values, many)]
        self.numbers = np.concatenate([self.numbers, np.stack(numbers, 1).astype(np.int64)])
        # all groups' texts, the stretches as lines
        new_a, new_b = (np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool) for g in (group_a, group_b))
        line = np.concatenate([[True], own_a[1:] != own_a[:-1]]) if len(own_a) else np.zeros(0, bool)
        words = np.concatenate([self.said_a[np.where(line, 2, new_a), ids_a], self.said_b[new_b.astype(np.int64), ids_b]])
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        lines = iter("".join(words[order].tolist()).split("\n")[1:])
        self.texts += [next(lines) if n else "" for n in n_a.tolist()]


def _table(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings end to end: where each begins, and the bytes."""
    return np.concatenate([[0], np.cumsum([len(v) for v in values])]), np.frombuffer(b"".join(values), np.uint8)


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(first: str, second: str) -> Aligner:
    """One per worker."""
    if (first, second) not in _aligners:
        _aligners[first, second] = Aligner(first, second)
    return _aligners[first, second]


def _plain(numbers: np.ndarray) -> bytes:
    """Numbers, lowest bytes first, compressed."""
    numbers = numbers.astype("<u8")
    planes = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    body = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes()
    return np.array([len(numbers), planes], "<u4").tobytes() + pa.compress(body, codec="zstd", asbytes=True)


def _read(data: bytes) -> np.ndarray:
    n, planes = (int(x) for x in np.frombuffer(data, "<u4", 2))
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :planes] = np.frombuffer(pa.decompress(data[8:], decompressed_size=n * planes, codec="zstd", asbytes=True), np.uint8).reshape(planes, n).T
    return steps.reshape(-1).view("<u8").astype(np.int64)


_FIELDS = ["n_a", "n_b", "n_groups", "n_links"]


def _schema(ids: str) -> pa.Schema:
    return pa.schema([
        ("chunk", pa.int64()), ("block", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("doc_id", pa.string() if ids == "string" else pa.int64()),
        *[(c, pa.int64()) for c in _FIELDS], ("groups_sha256", pa.string())])


class Batch:
    """The documents of one chunk: their numbers, and their pairs as places in the chunk's sorted list of pairs."""

    def __init__(self, links: Aligner, texts: list[str], blocks: int):
        cut = [links.stretches(t) if t else [] for t in texts]
        links.learn(cut)
        own = [list(map(links.known.__getitem__, c)) for c in cut]
        sizes = np.array([len(x) for x in own], np.int64)
        all_ = np.fromiter(chain.from_iterable(own), np.int64)
        doc = np.repeat(np.arange(len(own)), sizes)
        whole = np.bincount(doc, ~links.good[all_], len(own)) == 0
        self.numbers = np.stack([np.bincount(doc, x[all_], len(own)) for x in links.numbers.T], 1).astype(np.int64) * whole[:, None]
        said = links.texts.__getitem__
        self.digests = [hashlib.sha256(";".join(map(said, x)).encode()).hexdigest() if x and fits else "" for x, fits in zip(own, whole.tolist())]
        stays = whole[doc]
        doc, all_ = doc[stays], all_[stays]
        del cut, own
        met, times = np.unique(doc * len(links.good) + all_, return_counts=True)
        doc, stretch = np.divmod(met, max(1, len(links.good)))
        here = np.unique(stretch)
        n = np.diff(links.pairs.pointers)
        pairs = _gather(links.pairs.columns, links.pairs.pointers, here)
        block = (_mixed(pairs.astype(np.uint64)) >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)
        self.pairs, local = np.unique(block << _PAIR | pairs.astype(np.uint64), return_inverse=True)
        # entries of each document: places in the list, occurrences
        starts = np.concatenate([[0], np.cumsum(n[here])])
        slot = np.searchsorted(here, stretch)
        many = np.repeat(times, n[stretch]) * _gather(links.pairs.values, links.pairs.pointers, stretch)
        entry = np.repeat(doc, n[stretch]) * max(1, len(self.pairs)) + _gather(local, starts, slot)
        order = np.argsort(entry, kind="stable")
        entry = entry[order]
        first = _starts(entry)
        self.times = np.add.reduceat(many[order], first) if len(first) else many
        doc, self.place = np.divmod(entry[first], max(1, len(self.pairs)))
        self.size = np.bincount(doc, minlength=len(texts))
        self.docs = np.bincount(self.place, minlength=len(self.pairs))

    def parts(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(block, its pairs, number of documents of each)."""
        block = (self.pairs >> _PAIR).astype(np.int64)
        first = _starts(block)
        for a, b in zip(first, [*first[1:], len(block)]):
            own = self.pairs[a:b] & np.uint64((1 << 40) - 1)
            yield int(block[a]), _plain(np.diff(own, prepend=np.uint64(0))), _plain(self.docs[a:b])

    def kept(self) -> tuple[bytes, bytes]:
        """Entries of the documents: number and places; occurrences."""
        head = np.concatenate([[0], np.cumsum(self.size)])[:-1][self.size > 0]
        steps = np.diff(self.place, prepend=0)
        steps[head] = self.place[head]
        size, steps = _plain(self.size), _plain(steps)
        return np.array([len(size)], "<u4").tobytes() + size + steps, _plain(self.times)


def _gather(values: np.ndarray, pointers: np.ndarray, rows: np.ndarray) -> np.ndarray:
    n = np.diff(pointers)[rows]
    return values[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(pointers[rows], n)]


def _aligned(docs: DataFrame, first: str, second: str, blocks: int, chunk: int, ids: str) -> DataFrame:
    """Per chunk: one row per block of pairs, a row (block -1) with the entries of all documents, a row (block -2) per document."""
    schema = _schema(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, number = aligner(first, second), TaskContext.get().partitionId() << 32

        def done(doc_ids: list, texts: list[str], number: int) -> pa.RecordBatch:
            batch = Batch(links, texts, blocks)
            parts = [*batch.parts(), (-1, *batch.kept())]
            n = len(parts)
            rest = [None] * len(texts)
            columns = [
                [number] * (n + len(texts)), [b for b, _, _ in parts] + [-2] * len(texts), [k for _, k, _ in parts] + rest, [c for _, _, c in parts] + rest, [None] * n + doc_ids,
                *[[None] * n + batch.numbers[:, i].tolist() for i in range(4)], [None] * n + batch.digests]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        doc_ids, texts, held = [], [], 0
        for rows in batches:
            for doc_id, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()):
                if doc_ids and held + len(text) > chunk:
                    yield done(doc_ids, texts, number)
                    doc_ids, texts, held, number = [], [], 0, number + 1
                doc_ids.append(doc_id)
                texts.append(text)
                held += len(text)
        if doc_ids:
            yield done(doc_ids, texts, number)

    return docs.mapInArrow(run, f"chunk bigint, block int, keys binary, counts binary, doc_id {ids}, {', '.join(f'{c} bigint' for c in _FIELDS)}, groups_sha256 string")


def summed(keys: list[bytes], counts: list[bytes], width: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """For the pairs that each chunk sent to one block: all chunks' counts; the ids of the first vocabulary and their highest counts."""
    pairs = [np.cumsum(_read(k)) for k in keys]
    all_, inverse = np.unique(np.concatenate(pairs), return_inverse=True)
    total = np.bincount(inverse, np.concatenate([_read(c) for c in counts])).astype(np.int64)
    of = all_ // width
    first = _starts(of)
    return [_plain(x) for x in np.split(total[inverse], np.cumsum([len(p) for p in pairs])[:-1])], of[first], np.maximum.reduceat(total, first)


def _counted(sent: DataFrame, width: int, size: int) -> DataFrame:
    """(chunk, block, counts), and rows (id, high) with the highest count of an id of the first vocabulary in the task."""
    schema = pa.schema([("chunk", pa.int64()), ("block", pa.int32()), ("counts", pa.binary()), ("id", pa.int64()), ("high", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = np.zeros(size, np.int64)
        rows = (x for b in batches for x in zip(*(b.column(c).to_pylist() for c in ("block", "chunk", "keys", "counts"))))
        for block, own in groupby(rows, key=lambda x: x[0]):
            own = list(own)
            answers, ids, most = summed([x[2] for x in own], [x[3] for x in own], width)
            high[ids] = np.maximum(high[ids], most)
            n = len(own)
            yield pa.RecordBatch.from_arrays([pa.array([x[1] for x in own], pa.int64()), pa.array([block] * n, pa.int32()), pa.array(answers, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], schema=schema)
        ids = np.flatnonzero(high)
        n = len(ids)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(ids), pa.array(high[ids])], schema=schema)

    dealt = sent.repartition(shuffle_width(sent.sparkSession), "block").sortWithinPartitions("block", "chunk")
    return saved(dealt.mapInArrow(run, "chunk bigint, block int, counts binary, id bigint, high bigint"), "pairs")


def token_links(docs: DataFrame, first: str = FIRST, second: str = SECOND, chunk: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best counts links whose id pair is linked in as many documents as the first id's most frequent
    pair, ties included; count_sum adds those numbers of documents over all links.  Texts are encoded
    with a space in front and without special tokens.  Null and empty texts, and texts that the second
    vocabulary does not give back byte by byte, have no tokens: zeros and an empty groups_sha256.  Rows
    that repeat a doc_id are documents of their own; other columns are not read.  An empty table gives
    no rows.
    """
    spark = docs.sparkSession
    ids = "string" if docs.schema["doc_id"].dataType.simpleString() == "string" else "bigint"
    here = aligner(first, second)
    width, size = here.width, here.size
    path = scratch_path(spark, "aligned")
    found = _aligned(docs.select(F.col("doc_id").cast(ids).alias("doc_id"), text_of().alias("text")), first, second, shuffle_width(spark), chunk, ids)
    found.write.option("compression", "zstd").parquet(path)
    written = spark.read.schema(found.schema).parquet(path).withColumn("path", F.col("_metadata.file_path"))
    answers = _counted(written.where("block >= 0").select("chunk", "block", "keys", "counts"), width, size)
    most = answers.where("id IS NOT NULL").groupBy("id").agg(F.max("high").alias("high")).toPandas()  # at most as many rows as the vocabulary has ids
    high = np.zeros(size, np.int64)
    high[most["id"].to_numpy(np.int64)] = most["high"].to_numpy(np.int64)

    files = written.where("block = -1").select("path", "chunk")
    told = answers.where("id IS NULL").select("chunk", "block", "counts").join(files, "chunk")
    blank = files.select(F.col("chunk"), F.lit(-1).alias("block"), F.lit(None).cast("binary").alias("counts"), "path")
    rows = told.unionByName(blank).repartition(shuffle_width(spark), "path").sortWithinPartitions("path", "chunk", "block")
    names = ["chunk", "block", "keys", "counts", "doc_id", *_FIELDS, "groups_sha256"]
    out = pa.schema([("doc_id", pa.string() if ids == "string" else pa.int64()), *[(c, pa.int64()) for c in (*_FIELDS, "n_best", "count_sum")], ("groups_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (x for b in batches for x in zip(*(b.column(c).to_pylist() for c in ("path", "chunk", "block", "counts"))))
        for path, own in groupby(each, key=lambda x: x[0]):
            told = groupby(own, key=lambda x: x[1])
            for number, held in groupby(_stored(path, names), key=lambda x: x[0]):
                at, answers = next(told)
                assert at == number
                counts = [_read(x[3]) for x in answers if x[2] >= 0]
                counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
                pairs, numbers, entries = [], [], None
                for x in held:
                    if x[1] >= 0:
                        pairs.append(np.cumsum(_read(x[2])))
                    elif x[1] == -1:
                        cut = int(np.frombuffer(x[2], "<u4", 1)[0])
                        entries = _read(x[2][4:4 + cut]), _read(x[2][4 + cut:]), _read(x[3])
                    else:
                        numbers.append(x[4:])
                pairs = np.concatenate(pairs) if pairs else np.zeros(0, np.int64)
                best = counts == high[pairs // width]
                yield from finished(entries, counts, best, numbers)

    def finished(entries: tuple, counts: np.ndarray, best: np.ndarray, numbers: list[tuple]) -> Iterator[pa.RecordBatch]:
        size, steps, times = entries
        start = np.concatenate([[0], np.cumsum(size)])
        # places are differences inside each document
        running = np.cumsum(steps)
        base = np.concatenate([[0], running])[start[:-1]]
        spot = running - np.repeat(base, size)
        sums = [np.concatenate([[0], np.cumsum(times * x[spot])]) for x in (best.astype(np.int64), counts)]
        n_best, count_sum = (s[start[1:]] - s[start[:-1]] for s in sums)
        columns = list(zip(*numbers))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*columns[:5], n_best, count_sum, columns[5]], out)], schema=out)

    return rows.mapInArrow(run, f"doc_id {ids}, {', '.join(f'{c} bigint' for c in (*_FIELDS, 'n_best', 'count_sum'))}, groups_sha256 string")


def _stored(path: str, columns: list[str]) -> Iterator[tuple]:
    fs, name = place(path)
    with fs.open_input_file(name) as file:
        for batch in pq.ParquetFile(file).iter_batches(batch_size=2048, columns=columns):
            yield from zip(*(batch.column(c).to_pylist() for c in columns))
