"""Stored vector indexes: recall on queries that nothing was tuned on, and the share of rows that is scored."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scorelake.operators import vector_index as V

N, WIDTH, K = 6000, 24, 10


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((60, WIDTH)) * 2
    x = centres[rng.integers(0, 60, N)] + rng.standard_normal((N, WIDTH))
    asked = centres[rng.integers(0, 60, 60)] + rng.standard_normal((60, WIDTH))
    corpus = spark.createDataFrame(pd.DataFrame({"id": np.arange(N), "vec": list(x)})).unionByName(
        spark.createDataFrame([(N, None), (N + 1, [0.5, None] + [0.0] * (WIDTH - 2))], "id long, vec array<double>"))
    queries = spark.createDataFrame(pd.DataFrame({"q": np.arange(60), "vec": list(asked)}))
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    truth = np.argsort(-(unit(asked) @ unit(x).T), axis=1, kind="stable")[:, :K]
    return corpus, queries, truth, unit(asked) @ unit(x).T


def recall(found, truth):
    got = {(r.q, r.id) for r in found.collect()}
    return np.mean([(q, i) in got for q, row in enumerate(truth) for i in row.tolist()])


def test_cells(spark, clustered):
    corpus, queries, truth, scores = clustered
    index = V.CellIndex.build(corpus, "id", "vec", k=K)
    again = V.CellIndex(spark, index.folder)  # another reader of the stored tables
    assert again.settings == index.settings and index.codes.count() == index.vectors.count() == N
    found = again.search(queries, "q", "vec", K)
    assert recall(found, truth) >= 0.9 and index.settings.scored < 0.15
    rows = found.collect()
    assert all(abs(r.score - scores[r.q, r.id]) < 1e-5 for r in rows) and max(r["rank"] for r in rows) <= K
    sizes = np.array([r["count"] for r in index.codes.groupBy("cell").count().collect()])
    assert sizes.max() < 8 * sizes.mean()  # cells of like size
    plan = found._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "CartesianProduct" not in plan


def test_planes(spark, clustered):
    corpus, queries, truth, scores = clustered
    index = V.PlaneIndex.build(corpus, "id", "vec", k=K)
    assert index.tables <= 8 and index.signatures.count() == index.tables * N
    assert recall(V.PlaneIndex(spark, index.folder).search(queries, "q", "vec", K), truth) >= 0.9
    assert index.signatures.columns == ["id", "slot", "code"]  # copies hold no vectors


def test_probe_sequence_is_in_order_of_margins():
    margins = np.array([0.5, 0.1, 0.9, 0.3, 0.25])
    cost = lambda mask: sum(m for i, m in enumerate(margins) if mask >> i & 1)
    every = sorted(cost(sum(1 << i for i in c)) for n in range(6) for c in itertools.combinations(range(5), n))
    got = V.probe_sequence(margins, 32)
    assert len(set(got)) == 32 and np.allclose([cost(m) for m in got], every) and got[0] == 0
    assert V._cheaper(margins, cost(got[7])) == 7


def test_small_and_empty(spark):
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "id long, vec array<double>")
    asked = spark.createDataFrame([("a", [1.0, 0.1]), ("b", None)], "q string, vec array<double>")
    for kind in (V.CellIndex, V.PlaneIndex):
        found = kind.build(few, "id", "vec", k=2).search(asked, "q", "vec", 2).orderBy("rank").collect()
        assert [(r.q, r.id) for r in found][:1] == [("a", 1)]
        with pytest.raises(ValueError):
            kind.build(few.where(F.lit(False)), "id", "vec")
