"""Plans keep the properties that matter at scale."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from conftest import SMALL
from scorelake.operators import agreement as A
from scorelake.operators import blinding as B
from scorelake.operators import stats as S
from scorelake.session import shared_dir


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "category_sales", "season_category", "group_profile", "provider_summary", "pairwise", "work_plan", "tfidf_relevance",
    "cosine_topk_blocks", "session_sample", "trailing_count", "completion_grid", "error_timeline_dense", "crosstab_season_category",
])
def test_no_cross_join(spark, name):
    plan = plan_of(queries()[name](spark, SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_only_needed_columns_are_read(spark):
    from scorelake.operators.grouped import totals_by
    from scorelake.plans.views import sales

    plan = plan_of(totals_by(sales(spark, SMALL, "category", "amount"), "category", "amount"))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    read = {f.split(":")[0] for s in schemas for f in s.split(",")}
    assert read == {"l_partkey", "l_extendedprice", "p_partkey", "p_type"}


def test_filters_reach_the_scan(spark):
    plan = plan_of(queries()["filter_questions"](spark, SMALL))
    assert re.search(r"PushedFilters: \[[^\]]*In\(lang", plan)


def test_top_k_is_limited_before_the_shuffle(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("domain"))
    assert "WindowGroupLimit" in plan_of(B.sample_per_stratum(df, "domain", "id", 5))


def test_hot_groups_do_not_reach_one_window(spark):
    """Every window of the exact quantiles is keyed by group and bucket, or runs over cells."""
    plan = plan_of(queries()["age_band_spend"](spark, SMALL))
    for keys in re.findall(r"Window \[.*?\], \[([^\]]*)\], \[", plan):
        assert "_bucket" in keys or "_cell_rows" in plan


def test_shared_folder(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == shared_dir(spark)
    if configured:
        assert shared_dir(spark) == configured.rstrip("/")


def test_shared_folder_without_setting():
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: "hdfs://store/warehouse/" if key == "spark.sql.warehouse.dir" else default)

    assert shared_dir(Session).startswith("hdfs://store/warehouse/") and shared_dir(Session) == shared_dir(Session)


def test_tables_are_read_once(spark):
    """What quantiles, moments and ranks need comes from one saved table of counts."""
    for name in ("age_band_spend", "group_profile", "spearman"):
        plan = plan_of(queries()[name](spark, SMALL))
        assert not re.search(r"(lineitem|events|part|orders)\.parquet", plan), name


def test_relevance_shuffles_texts_once(spark):
    df = spark.createDataFrame([("1", "a query here", "some response here")], "id string, q string, r string")
    from scorelake.operators.scoring import tfidf_relevance

    assert plan_of(tfidf_relevance(df, "id", "q", "r")).count("Exchange") <= 2  # the node and its mention in the details


@pytest.mark.parametrize("name", ["category_sales", "session_sample", "crosstab_season_category", "group_profile", "cosine_topk"])
def test_no_scalar_array_is_exploded_beside_a_table(spark, name):
    """A cross join can hide as the explode of an array from a subquery; only grids that are the result may do so."""
    plan = plan_of(queries()[name](spark, SMALL))
    hidden = re.findall(r"explode\((?:scalar-)?subquery", plan, re.I)
    assert len(hidden) <= (1 if name in ("session_sample", "crosstab_season_category") else 0)


def test_no_text_is_lost_to_a_rank(spark):
    """Budgets keep every document that fits, however many: 3,000 short ones, empty ones first."""
    from scorelake.operators.windows import leading_within

    rows = [("a", i, 1) for i in range(3000)] + [("a", 5000 + i, 0) for i in range(40)] + [("b", 1, 5000), (None, 2, 3)]
    df = spark.createDataFrame(rows, "s string, id long, n long")
    got = leading_within(df, "s", "n", ["id"], "n", 2000).groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.max("rank").alias("m")).collect()
    assert {(r.s, r.c, r.m) for r in got} == {("a", 2040, 2040), (None, 1, 1)}


def test_missing_vectors_and_keys(spark):
    from scorelake.operators import retrieval as V
    from scorelake.operators.windows import sessions

    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0]), (4, [None, 1.0])], "id long, v array<double>")
    asked = spark.createDataFrame([("q", [1.0, 0.1]), ("none", None)], "q string, v array<double>")
    assert [(r.q, r.id) for r in V.cosine_topk(asked, corpus, "q", "id", "v", 3).orderBy("rank").collect()] == [("q", 1), ("q", 3)]
    events = spark.createDataFrame([("a", 10), (None, 10), ("a", None)], "who string, t long").withColumn("ts", F.timestamp_seconds("t"))
    assert sessions(events, ["who"], "ts", 60).agg(F.sum("events")).first()[0] == 3


def test_agreement(spark):
    # the ten-subject, fourteen-rater table used to explain the statistic
    table = [[0, 0, 0, 0, 14], [0, 2, 6, 4, 2], [0, 0, 3, 5, 6], [0, 3, 9, 2, 0], [2, 2, 8, 1, 1], [7, 7, 0, 0, 0],
             [3, 2, 6, 3, 0], [2, 5, 3, 2, 2], [6, 5, 2, 1, 0], [0, 2, 2, 3, 7]]
    rows = [(i, c) for i, line in enumerate(table) for c, n in enumerate(line) for _ in range(n)]
    r = A.agreement(spark.createDataFrame(rows, "u int, c int"), "u", "c").first()
    assert abs(r.fleiss_kappa - 0.210) < 5e-4 and r.units == 10 and r.ratings == 140


def test_bootstrap_and_tukey(spark):
    rng = np.random.default_rng(0)
    data = [(g, float(x)) for g, m in (("a", 0), ("b", 0.05), ("c", 3)) for x in rng.normal(m, 1, 200)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "id long, g string, x double")
    out = {r.g: r for r in S.bootstrap_intervals(df, "g", "x", "id", 800).collect()}
    for g in "abc":
        v = np.array([x for k, x in data if k == g])
        half = 1.96 * v.std(ddof=1) / np.sqrt(len(v))
        assert abs(out[g].ci_low - (v.mean() - half)) < .04 and abs(out[g].ci_high - (v.mean() + half)) < .04
    again = {r.g: r for r in S.bootstrap_intervals(df.repartition(7), "g", "x", "id", 800).collect()}
    assert all(abs(again[g].ci_low - out[g].ci_low) < 1e-9 for g in "abc")
    p = {(r.a_grp, r.b_grp): r.p_value for r in S.tukey_pairs(S.moments(df, "g", "x")).collect()}
    assert p[("a", "c")] < 1e-6 and p[("a", "b")] > .05


def test_overlap(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat", "the cat sat on the mat"), (2, "a b c", "x y z"), (3, "the the the", "the cat")],
                               "id int, r string, t string")
    out = {r.id: r for r in A.reference_overlap(df, "id", "r", "t").collect()}
    assert out[1].bleu == 1.0 and out[1].rouge_2 == 1.0 and out[2].bleu == 0.0 and out[2].rouge_1 == 0.0
    assert abs(out[3].rouge_1 - 2 * 1 / 5) < 1e-12


def test_full_report(spark):
    df = spark.createDataFrame([("a", .9), ("a", .8), ("b", .5), ("b", .4)], "g string, x double")
    rows = {(r.section, r.subject, r.measure) for r in S.full_report(df, "g", "x").collect()}
    assert {("ranking", "a", "rank"), ("anova", "all groups", "p_value"), ("pairs", "a vs b", "effect_size"), ("effects", "a_vs_b", "effect_size")} <= rows
