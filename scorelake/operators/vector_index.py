"""Stored vector indexes: built once, searched many times.

Cells: coarse centroids in two levels, the second with as many centroids in a first-level cell as its
share of the vectors asks for, so that cells are of like size; the residual of each vector is kept as a
product-quantised code of a few bytes.  A search reads the codes of the nearest cells only, adds up
table look-ups, and scores the best of them again with their vectors.

Planes: signatures of random hyperplanes in a few tables.  A search also visits the codes next to the
query's own, those first whose flipped bits have the least margin, in the order a heap gives.

Both are tuned when they are built, on held-out vectors against exact search, and a search never runs
an exact one.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.operators.retrieval import SLICE_ROWS, _cells, _ranked, _result_schema, _spread, _unit_rows, cosine_topk, with_vectors
from scorelake.session import saved, scratch_path

#: Vectors that centroids and code books are fitted on, held-out vectors that a build is tuned on, and cells, at most.
SAMPLE, HELD_OUT, MOST_CELLS = 65_536, 128, 4096
#: Parts of a code (fewer if vectors are short), and centroids of each.
PARTS, CODES = 16, 256
#: Tables of signatures; candidates that are scored again for each of the k results.
TABLES, AGAIN = 8, 16
UNIT = T.ArrayType(T.FloatType())


def _units(vector: str):
    @F.pandas_udf(UNIT)
    def units(vectors: pd.Series) -> pd.Series:
        return pd.Series(list(_unit_rows(vectors).astype("float32"))) if len(vectors) else pd.Series([], dtype=object)

    return units(vector)


def _lloyd(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Centroids of a bounded sample."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].astype("float64")
    for _ in range(rounds):
        own = _nearest_of(x, centres)
        sums, sizes = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, x)
        filled = sizes > 0
        centres[filled] = sums[filled] / sizes[filled, None]
        if (~filled).any():  # an empty one starts again from some vector
            centres[~filled] = x[rng.choice(len(x), int((~filled).sum()))]
    return centres


def _nearest_of(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(axis=1) - 2 * x @ centres.T, axis=1)


def two_levels(x: np.ndarray, cells: int, seed: int) -> np.ndarray:
    """Centroids of ``cells`` cells, about: first some, then more inside each by its share of the vectors."""
    first = _lloyd(x, max(1, math.isqrt(cells)), seed)
    own = _nearest_of(x, first)
    out = [_lloyd(x[own == i], max(1, round(cells * (own == i).mean())), seed + i) for i in range(len(first)) if (own == i).any()]
    return np.concatenate(out)


@dataclass(frozen=True)
class Settings:
    """What a build has settled on; kept beside its tables."""

    id: str
    width: int
    probes: int
    again: int
    recall: float
    scored: float


def _sampled(units: DataFrame, id_: str, sample: int, held: int) -> tuple[np.ndarray, pd.DataFrame]:
    """A bounded sample to fit on, and other vectors to tune with; by hash, so that retries agree."""
    some = units.orderBy(F.xxhash64(id_), id_).limit(sample + held).toPandas()
    held = min(held, max(1, len(some) // 4))
    return np.stack(some["v"][held:].to_numpy()) if len(some) > held else np.stack(some["v"].to_numpy()), some[:held]


def _truth(held: pd.DataFrame, units: DataFrame, id_: str, k: int) -> tuple[DataFrame, DataFrame]:
    asked = units.sparkSession.createDataFrame(held.rename(columns={id_: "_asked"})[["_asked", "v"]])
    return asked, saved(cosine_topk(asked, units, "_asked", id_, "v", k).select("_asked", id_), "truth")


def _measured(found: DataFrame, truth: DataFrame, id_: str) -> float:
    total = truth.count()
    return truth.join(found.select("_asked", id_), ["_asked", id_], "left_semi").count() / max(1, total)


class CellIndex:
    """Tables in ``folder``: ``codes`` (cell, id, code), ``vectors`` (id, v), ``model`` and ``settings``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        row = spark.read.parquet(f"{folder}/model").first()
        self.settings = Settings(**json.loads(row["settings"]))
        self.centres = np.array(row["centres"], "float32").reshape(-1, self.settings.width)
        self.books = np.array(row["books"], "float32").reshape(row["parts"], -1, row["span"])
        self.codes, self.vectors = spark.read.parquet(f"{folder}/codes"), spark.read.parquet(f"{folder}/vectors")

    @classmethod
    def build(
        cls, corpus: DataFrame, id_: str, vector: str, folder: str | None = None, k: int = 10, recall: float = 0.92, seed: int = 7, sample: int = SAMPLE
    ) -> CellIndex:
        """Indexes every row that has a vector.  Fitted on ``sample`` rows, tuned on ``HELD_OUT`` others to a recall of
        ``recall`` at ``k`` against exact search, both by hash of the id."""
        spark, folder = corpus.sparkSession, folder or scratch_path(corpus.sparkSession, "cells")
        with_vectors(corpus, vector).select(id_, _units(vector).alias("v")).write.parquet(f"{folder}/vectors")
        units = spark.read.parquet(f"{folder}/vectors")
        n = units.count()
        if not n:
            raise ValueError("no vectors to index")
        x, held = _sampled(units, id_, sample, HELD_OUT)
        width = x.shape[1]
        centres = two_levels(x, min(MOST_CELLS, max(1, 2 * math.isqrt(n)), max(1, len(x) // 8)), seed).astype("float32")
        parts = max(p for p in range(1, min(PARTS, width) + 1) if width % p == 0)
        rest = x - centres[_nearest_of(x, centres)]
        books = [_lloyd(part, CODES, seed) for part in np.split(rest, parts, axis=1)]
        books = np.stack([np.concatenate([b, np.repeat(b[:1], CODES - len(b), axis=0)]) for b in books]).astype("float32")

        def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    v = np.stack(batch["v"].to_numpy())
                    cell = _nearest_of(v, centres)
                    left = np.split(v - centres[cell], parts, axis=1)
                    code = np.stack([_nearest_of(p, b) for p, b in zip(left, books)], axis=1).astype(np.uint8)
                    yield pd.DataFrame({"cell": cell.astype("int32"), id_: batch[id_], "code": [c.tobytes() for c in code]})

        schema = T.StructType([T.StructField("cell", T.IntegerType()), units.schema[id_], T.StructField("code", T.BinaryType())])
        # sorted by cell, so that a search's filter on cells skips row groups; the id cuts a busy cell
        units.mapInPandas(coded, schema).repartitionByRange("cell", id_).sortWithinPartitions("cell").write.parquet(f"{folder}/codes")
        model = {"centres": centres.ravel().tolist(), "books": books.ravel().tolist(), "parts": parts, "span": width // parts}

        def stored(settings: Settings) -> CellIndex:
            kind = "centres array<float>, books array<float>, parts int, span int, settings string"
            spark.createDataFrame([(*model.values(), json.dumps(asdict(settings)))], kind).coalesce(1).write.mode("overwrite").parquet(f"{folder}/model")
            return cls(spark, folder)

        # the cells that hold the true neighbours of held-out vectors say how many must be visited
        asked, truth = _truth(held, units, id_, k)
        places = truth.join(spark.read.parquet(f"{folder}/codes").select(id_, "cell"), id_).toPandas()  # HELD_OUT x k rows
        ranks = np.argsort(np.argsort(-(np.stack(held["v"].to_numpy()) @ centres.T), axis=1), axis=1)
        row_of = {a: i for i, a in enumerate(held[id_])}
        needed = np.sort([ranks[row_of[a], c] for a, c in zip(places["_asked"], places["cell"])]) + 1
        # some of what is left to lose goes to the codes
        probes = int(needed[min(len(needed) - 1, math.ceil((recall + (1 - recall) / 2) * len(needed)))])
        sizes = {r["cell"]: r["count"] for r in spark.read.parquet(f"{folder}/codes").groupBy("cell").count().collect()}  # a row per cell
        visited = np.array([[sizes.get(c, 0) for c in np.argsort(-q)[:probes]] for q in np.stack(held["v"].to_numpy()) @ centres.T])
        again, reached = AGAIN, 0.0
        while True:
            index = stored(Settings(id_, width, probes, again, 0.0, float(visited.sum(axis=1).mean() / n)))
            reached = _measured(index.search(asked, "_asked", "v", k), truth, id_)
            if reached >= recall or again * k >= n:
                return stored(Settings(id_, width, probes, again, reached, index.settings.scored))
            again *= 4

    def search(self, queries: DataFrame, query_id: str, vector: str, k: int) -> DataFrame:
        """query, id, score, rank: codes of the nearest cells first, then the best ``again * k`` with their vectors."""
        s, centres, books = self.settings, self.centres, self.books
        id_, parts, top = s.id, len(books), s.again * k
        asked = with_vectors(queries, vector).select(query_id, _units(vector).alias("v"))

        @F.pandas_udf("array<int>")
        def near(vectors: pd.Series) -> pd.Series:
            scores = np.stack(vectors.to_numpy()) @ centres.T if len(vectors) else np.zeros((0, 1))
            return pd.Series(list(np.argsort(-scores, axis=1, kind="stable")[:, :s.probes].astype("int32")))

        left = asked.select(query_id, "v", F.explode(near("v")).alias("cell"))
        visited = left.select("cell").distinct()
        codes = self.codes.join(visited, "cell", "left_semi")
        c_slices, q_slices = _cells(codes, SLICE_ROWS), _cells(left, 2000)
        left = _spread(left.withColumn("_own", q_slices).withColumn("_other", c_slices), "_q", "_c", query_id)
        right = _spread(codes.withColumn("_own", c_slices).withColumn("_other", q_slices), "_c", "_q", id_)
        schema = _result_schema(queries, query_id, self.codes, id_)

        def scan(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(q) and len(c):
                code = np.frombuffer(b"".join(c["code"]), np.uint8).reshape(-1, parts)
                for name, v in zip(q[query_id], q["v"]):
                    table = np.einsum("pcs,ps->pc", books, np.asarray(v).reshape(parts, -1))
                    score = float(np.asarray(v) @ centres[int(q["cell"].iloc[0])]) + table[np.arange(parts), code].sum(axis=1)
                    best = np.argpartition(-score, min(top, len(score)) - 1)[:top]
                    out.append(pd.DataFrame({query_id: [name] * len(best), id_: c[id_].to_numpy()[best], "score": score[best].astype("float64")}))
            return pd.concat(out) if out else pd.DataFrame({query_id: q[query_id][:0], id_: c[id_][:0], "score": np.zeros(0)})

        keys = ["cell", "_q", "_c"]
        rough = _ranked(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(scan, schema), query_id, id_, top)
        return _scored_again(rough.select(query_id, id_), asked, self.vectors, query_id, id_, k)


def _scored_again(pairs: DataFrame, asked: DataFrame, vectors: DataFrame, query_id: str, id_: str, k: int) -> DataFrame:
    both = pairs.join(vectors.withColumnRenamed("v", "_x"), id_).join(asked.select(query_id, "v"), query_id)
    product = F.aggregate(F.zip_with("_x", "v", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda acc, x: acc + x)
    return _ranked(both.select(query_id, id_, product.alias("score")), query_id, id_, k)


def probe_sequence(margins: np.ndarray, probes: int) -> list[int]:
    """Bit masks to flip, the first ``probes`` by the sum of their margins; starts with no flip.

    A heap holds the frontier: each set of bits, as places in the order of margins, is followed by the
    set with its last place moved on by one, and by the set with the next place added.
    """
    order = np.argsort(margins, kind="stable")
    m = margins[order]
    out, heap = [0], [(float(m[0]), (0,))] if len(m) else []
    while heap and len(out) < probes:
        cost, places = heapq.heappop(heap)
        out.append(int(sum(1 << int(order[p]) for p in places)))
        last = places[-1]
        if last + 1 < len(m):
            heapq.heappush(heap, (cost - float(m[last]) + float(m[last + 1]), (*places[:-1], last + 1)))
            heapq.heappush(heap, (cost + float(m[last + 1]), (*places, last + 1)))
    return out


class PlaneIndex:
    """Tables in ``folder``: ``signatures`` (slot, code, id), ``vectors`` (id, v) and ``settings``; ``slot`` is the table."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        row = spark.read.parquet(f"{folder}/model").first()
        self.settings, self.bits, self.tables = Settings(**json.loads(row["settings"])), row["bits"], row["tables"]
        self.planes = np.random.default_rng(row["seed"]).standard_normal((self.tables * self.bits, self.settings.width))
        self.signatures, self.vectors = spark.read.parquet(f"{folder}/signatures"), spark.read.parquet(f"{folder}/vectors")

    @classmethod
    def build(
        cls, corpus: DataFrame, id_: str, vector: str, folder: str | None = None, k: int = 10, recall: float = 0.92, seed: int = 7,
        tables: int = TABLES, bits: int | None = None,
    ) -> PlaneIndex:
        """Signs every row that has a vector, ``tables`` times; the number of codes to visit is tuned on held-out vectors."""
        spark, folder = corpus.sparkSession, folder or scratch_path(corpus.sparkSession, "planes")
        with_vectors(corpus, vector).select(id_, _units(vector).alias("v")).write.parquet(f"{folder}/vectors")
        units = spark.read.parquet(f"{folder}/vectors")
        n = units.count()
        if not n:
            raise ValueError("no vectors to index")
        _, held = _sampled(units, id_, HELD_OUT, HELD_OUT)
        width, bits = len(held["v"].iloc[0]), bits or max(4, (n // 8).bit_length())
        planes = np.random.default_rng(seed).standard_normal((tables * bits, width))

        @F.pandas_udf("array<bigint>")
        def signed(vectors: pd.Series) -> pd.Series:
            signs = (np.stack(vectors.to_numpy()) @ planes.T > 0).reshape(len(vectors), tables, bits) if len(vectors) else np.zeros((0, tables, bits), bool)
            return pd.Series(list(signs @ (1 << np.arange(bits, dtype="int64"))))

        codes = units.select(id_, F.posexplode(signed("v")).alias("slot", "code"))
        codes.repartitionByRange("slot", "code", id_).sortWithinPartitions("slot", "code").write.parquet(f"{folder}/signatures")
        asked, truth = _truth(held, units, id_, k)
        near = {r["id"]: r["v"] for r in truth.select(F.col(id_).alias("id")).distinct().join(units.select(F.col(id_).alias("id"), "v"), "id").collect()}
        probes = cls._probes(held, truth.toPandas(), near, planes, id_, tables, bits, recall)
        kind = "bits int, tables int, seed bigint, settings string"
        settings = Settings(id_, width, probes, 0, 0.0, min(1.0, tables * probes / 2**bits))
        for final in (False, True):
            spark.createDataFrame([(bits, tables, seed, json.dumps(asdict(settings)))], kind).coalesce(1).write.mode("overwrite").parquet(f"{folder}/model")
            index = cls(spark, folder)
            if not final:
                found = index.search(asked, "_asked", "v", k)
                settings = Settings(id_, width, probes, 0, _measured(found, truth, id_), settings.scored)
        return index

    @staticmethod
    def _probes(held, truth, near, planes, id_, tables, bits, recall) -> int:
        """Codes to visit in each table so that the share ``recall`` of true neighbours is met in one of them."""
        flips, needed = {name: (planes @ np.asarray(v)).reshape(tables, bits) for name, v in zip(held[id_], held["v"])}, []
        for a, i in zip(truth["_asked"], truth[id_]):
            dots, other = flips[a], (planes @ np.asarray(near[i])).reshape(tables, bits)
            cost = np.where((dots > 0) != (other > 0), np.abs(dots), 0).sum(axis=1)
            needed.append(1 + min(_cheaper(np.abs(d), c) for d, c in zip(dots, cost)))
        return int(np.sort(needed)[min(len(needed) - 1, math.ceil(recall * len(needed)))])

    def search(self, queries: DataFrame, query_id: str, vector: str, k: int) -> DataFrame:
        """query, id, score, rank.  Only ids travel to the codes; vectors are fetched for what was met."""
        planes, tables, bits, probes, id_ = self.planes, self.tables, self.bits, self.settings.probes, self.settings.id
        asked = with_vectors(queries, vector).select(query_id, _units(vector).alias("v"))

        @F.pandas_udf("array<struct<slot: int, code: bigint>>")
        def visits(vectors: pd.Series) -> pd.Series:
            out = []
            for v in vectors:
                dots = (planes @ np.asarray(v)).reshape(tables, bits)
                own = (dots > 0) @ (1 << np.arange(bits, dtype="int64"))
                out.append([{"slot": t, "code": int(own[t]) ^ mask} for t in range(tables) for mask in probe_sequence(np.abs(dots[t]), probes)])
            return pd.Series(out)

        met = asked.select(query_id, F.explode(visits("v")).alias("at")).select(query_id, "at.slot", "at.code")
        pairs = met.join(self.signatures, ["slot", "code"]).select(query_id, id_).distinct()
        return _scored_again(pairs, asked, self.vectors, query_id, id_, k)


def _cheaper(margins: np.ndarray, cost: float, most: int = 4096) -> int:
    """How many sets of bits have a smaller sum of margins than ``cost``, up to ``most``."""
    if cost <= 0:
        return 0
    m, count = np.sort(margins), 1  # the empty set
    heap = [(float(m[0]), (0,))]
    while heap and count < most:
        c, places = heapq.heappop(heap)
        if c >= cost - 1e-12:
            break
        count += 1
        last = places[-1]
        if last + 1 < len(m):
            heapq.heappush(heap, (c - float(m[last]) + float(m[last + 1]), (*places[:-1], last + 1)))
            heapq.heappush(heap, (c + float(m[last + 1]), (*places, last + 1)))
    return count
