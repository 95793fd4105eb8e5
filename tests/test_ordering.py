import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.operators import merging, ordering
from scorelake.operators.ordering import average_ranks, exact_quantiles, row_blocks, row_positions, value_positions


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows and one value a third of them."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(3000):
        group = "hot" if i % 5 else f"g{i % 7}"
        value = 5.0 if i % 3 == 0 else float(round(rng.normal(), 2))
        rows.append((i, group, value))
    rows.append((3000, "lone", 1.5))
    return rows, spark.createDataFrame(rows, "id long, g string, v double")


@pytest.mark.parametrize("accuracy", [10, 4000])
def test_quantiles_equal_numpy(skewed, accuracy):
    rows, df = skewed
    got = {r.g: r for r in exact_quantiles(df, "v", {"a": .25, "b": .5, "c": .9}, ["g"], [F.count("v").alias("n")], accuracy).collect()}
    for g in {r[1] for r in rows}:
        values = [r[2] for r in rows if r[1] == g]
        expected = np.percentile(values, [25, 50, 90])
        assert np.allclose([got[g].a, got[g].b, got[g].c], expected) and got[g].n == len(values)


def test_quantiles_with_a_wrong_sketch(skewed, monkeypatch):
    """Brackets that hold none of the places: further rounds find them."""
    rows, df = skewed
    honest = ordering._brackets

    def wrong(*args):
        return honest(*args).withColumn("_edges", F.transform("_edges", lambda e: F.lit(-99.0)))

    monkeypatch.setattr(ordering, "_brackets", wrong)
    got = {r.g: r for r in exact_quantiles(df, "v", {"a": .25, "c": .9}, ["g"]).collect()}
    for g in {r[1] for r in rows}:
        assert np.allclose([got[g].a, got[g].c], np.percentile([r[2] for r in rows if r[1] == g], [25, 90]))
    one = exact_quantiles(df, "v", {"a": .25, "c": .9}).first()
    assert np.allclose([one.a, one.c], np.percentile([r[2] for r in rows], [25, 90]))


def test_only_values_near_the_places_travel(spark):
    df = spark.range(200_000).select((F.hash("id") / 7.0).alias("v"), (F.col("id") % 2).alias("g"))
    brackets = ordering._brackets(df.withColumn("_v", F.col("v")), {"m": .5}, ["g"], 4000, ())
    cells = ordering._cells(df.withColumn("_v", F.col("v")).select("g", "_v"), brackets, ["g"], 1)
    assert cells.count() < 0.01 * 200_000 and cells.agg(F.sum("weight")).first()[0] == 200_000


def test_half_of_the_rows_share_one_value(spark, monkeypatch):
    """Row positions cut a value that half of the rows share, and a group that holds them all."""
    df = spark.range(8000).select("id", F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("v"), F.lit("one").alias("g"))
    written, plain = [], merging.saved
    monkeypatch.setattr(merging, "saved", lambda d, label: written.append(plain(d, label)) or written[-1])
    out = row_positions(df, "v", ["g"], ties=["id"])
    expected = sorted(range(8000), key=lambda i: (0 if i % 2 == 0 else i, i))
    assert [r.id for r in out.orderBy("position").collect()] == expected
    sizes = [r["count"] for r in written[0].groupBy("_part").count().collect()]
    assert len(sizes) >= 3 and max(sizes) < 0.5 * 8000


def test_quantile_without_groups_and_nulls(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,), (10.0,)], "v double")
    assert exact_quantiles(df, "v", {"m": .5}).first().m == 2.0
    assert exact_quantiles(df.where("v > 99"), "v", {"m": .5}).first().m is None


def test_positions_and_ranks(skewed):
    rows, df = skewed
    got = {(r.g, r.v): (r.n_before, r.n_rows) for r in value_positions(df, "v", ["g"]).collect()}
    for (g, v), (before, n) in got.items():
        values = [r[2] for r in rows if r[1] == g]
        assert before == sum(x < v for x in values) and n == values.count(v)
    ranks = {(r.g, r.v): r["rank"] for r in average_ranks(df, "v", ["g"]).collect()}
    assert ranks[("lone", 1.5)] == 1.0


def test_row_positions_keep_null_groups(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "x") for i in range(20)], "id long, g string")
    out = row_positions(df, "id", ["g"]).collect()
    assert len(out) == 20
    assert sorted(r.position for r in out if r.g is None) == list(range(10))


def test_blocks(spark):
    df = spark.range(0, 1001).withColumn("v", F.rand(1))
    out = row_blocks(df, "id", 150).collect()
    assert all(r.block == r.id // 150 and r.row_in_block == r.id % 150 for r in out)
    assert len(out) == 1001


def test_timestamp_order(spark):
    df = spark.sql("SELECT id, timestamp_micros(id * 7) AS ts FROM range(100)")
    assert all(r.position == r.id for r in row_positions(df, "ts").collect())
