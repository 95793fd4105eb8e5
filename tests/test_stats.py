import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.functions import dist
from scorelake.operators import stats as S

SCORES = {
    "groq": [.8, .9, .7, .85, .9], "gemini": [.75, .8, .85, .9, .8], "openrouter": [.7, .75, .8, .85, .9],
}


@pytest.fixture(scope="module")
def scores(spark):
    return spark.createDataFrame([(p, s) for p, v in SCORES.items() for s in v], "provider string, score double")


def test_published_points(spark):
    ten, four = F.lit(10.0), F.lit(4.0)
    got = spark.range(1).select(
        dist.t_quantile(.975, ten), dist.t_quantile(.975, four), dist.t_quantile(.975, F.lit(1.0)), dist.p_two_sided(F.lit(2.0), ten),
        dist.p_f(F.lit(3.885294), F.lit(2.0), F.lit(12.0)), dist.p_less(F.lit(0.0), F.lit(5.0)), dist.normal_cdf(F.lit(-1.959964)),
        dist.p_two_sided(F.lit(1.96), F.lit(1e6)), dist.p_studentized_range(F.lit(3.77), F.lit(3.0), F.lit(12.0))).first()
    assert np.allclose(got[:8], [2.228139, 2.776445, 12.706205, 0.0733880, 0.05, 0.5, 0.025, 0.0499962], atol=1e-5)
    assert abs(got[8] - 0.05) < 5e-4 and abs(dist.normal_quantile(.975) - 1.959964) < 1e-6
    none = spark.range(1).select(dist.p_two_sided(F.lit(None).cast("double"), ten), dist.p_f(F.lit(1.0), F.lit(0.0), ten), dist.t_quantile(.975, F.lit(0.0))).first()
    assert list(none) == [None, None, None]


def test_describe(scores):
    got = {r.provider: r for r in S.describe(scores, "provider", "score").collect()}
    for p, v in SCORES.items():
        r = got[p]
        assert np.allclose([r["mean"], r["std"], r["min"], r["max"]], [np.mean(v), np.std(v, ddof=1), min(v), max(v)])
        assert np.allclose([r["q25"], r["median"], r["q75"]], np.percentile(v, [25, 50, 75]))


def test_interval(scores, spark):
    r = S.with_interval(S.moments(scores, "provider", "score")).where("grp = 'groq'").first()
    v = SCORES["groq"]
    margin = 2.7764451 * np.std(v, ddof=1) / math.sqrt(5)
    assert abs(r.ci_low - (np.mean(v) - margin)) < 1e-6 and abs(r.ci_high - (np.mean(v) + margin)) < 1e-6
    one = spark.createDataFrame([("a", 3.0)], "provider string, score double")
    r = S.with_interval(S.moments(one, "provider", "score")).first()
    assert (r.ci_low, r.ci_high) == (3.0, 3.0)


def test_pairs_and_t_test(scores):
    out = {(r.a_grp, r.b_grp): r for r in S.with_p(S.pairs(S.moments(scores, "provider", "score"))).collect()}
    assert len(out) == 6
    a, b = SCORES["groq"], SCORES["openrouter"]
    pooled = math.sqrt((np.var(a, ddof=1) + np.var(b, ddof=1)) / 2)
    d = (np.mean(a) - np.mean(b)) / pooled
    r = out[("groq", "openrouter")]
    assert abs(r.effect_size - d) < 1e-9 and abs(r.statistic - d * math.sqrt(2.5)) < 1e-9
    assert not r.significant and "5 vs 5" in r.description
    less = S.with_p(S.t_test(scores, "provider", "score", "groq", "gemini"), "less").first().p_value
    greater = S.with_p(S.t_test(scores, "provider", "score", "groq", "gemini"), "greater").first().p_value
    assert abs(less + greater - 1) < 1e-9


def test_anova(scores, spark):
    r = S.anova_p(S.anova(S.moments(scores, "provider", "score"))).first()
    every = np.concatenate([np.array(v) for v in SCORES.values()])
    between = sum(5 * (np.mean(v) - every.mean()) ** 2 for v in SCORES.values())
    total = ((every - every.mean()) ** 2).sum()
    f = (between / 2) / ((total - between) / 12)
    assert abs(r.statistic - f) < 1e-9 and abs(r.effect_size - between / total) < 1e-9 and r.p_value > .05
    single = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "provider string, score double")
    r = S.anova_p(S.anova(S.moments(single, "provider", "score"))).first()
    assert (r.statistic, r.p_value, r.description) == (0.0, 1.0, "Insufficient groups for ANOVA")


def test_equal_values_have_no_effect_size(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 1.0)], "provider string, score double")
    assert S.pairs(S.moments(df, "provider", "score")).first().effect_size is None


def test_correlations(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 9, 200).astype(float)
    y = x + rng.normal(size=200).round(1)
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x double, y double")

    def ranks(v):
        return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])

    assert abs(S.pearson(df, "x", "y").first().r - np.corrcoef(x, y)[0, 1]) < 1e-12
    assert abs(S.spearman(df, "x", "y").first().r - np.corrcoef(ranks(x), ranks(y))[0, 1]) < 1e-12
    assert S.correlation_p(S.pearson(df, "x", "y"), "r", "n").first().p_value < 1e-6


def test_rank_and_best(scores):
    ranked = {r.grp: r for r in S.rank_groups(S.moments(scores, "provider", "score")).collect()}
    assert {r["rank"] for r in ranked.values()} == {1, 2, 3}
    assert ranked["groq"]["rank"] == 1 and ranked["groq"].percentile == 100.0
    names = {r.comparison for r in S.effect_vs_best(S.moments(scores, "provider", "score")).collect()}
    assert names == {"groq_vs_gemini", "groq_vs_openrouter"}


def test_power_and_labels(spark):
    df = spark.createDataFrame([(64.0, .5)], "n double, d double")
    r = df.select(S.power(F.col("n"), F.col("d")).alias("p"), S.effect_label(F.col("d")).alias("l")).first()
    assert abs(r.p - 0.8074) < 1e-3 and r.l == "medium"
