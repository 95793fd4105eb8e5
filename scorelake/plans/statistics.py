"""Inference queries over the score table."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.functions import dist
from scorelake.operators import stats as S
from scorelake.plans import tails
from scorelake.plans.registry import query
from scorelake.plans.views import SCORES_SQL, scores, table

MOMENTS_SQL = f"""{SCORES_SQL}, m AS (SELECT provider AS grp, count(score) AS n, avg(score) AS mean,
    var_samp(score) AS var, min(score) AS min, max(score) AS max FROM scores GROUP BY 1)"""


def score_moments(spark, d):
    return S.moments(scores(spark, d), "provider", "score")


def rounded(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("descriptive", f"""WITH {SCORES_SQL} SELECT provider, count(score) AS n, round(avg(score), 6) AS mean,
    round(stddev_samp(score), 6) AS std, min(score) AS min, max(score) AS max,
    round(quantile_cont(score, 0.25), 6) AS q25, round(quantile_cont(score, 0.5), 6) AS median,
    round(quantile_cont(score, 0.75), 6) AS q75 FROM scores GROUP BY 1""")
def descriptive(spark, d):
    return rounded(S.describe(scores(spark, d), "provider", "score"), 6, "mean", "std", "q25", "median", "q75")


def labelled_lengths(spark, d):
    labels, docs = table(spark, d, "labels"), table(spark, d, "documents")
    return labels.join(docs, "doc_id").select("quality", F.col("n_chars").cast("double").alias("score"))


T_SQL = """g AS (SELECT quality AS grp, count(*) AS n, avg(n_chars) AS mean, var_samp(n_chars) AS var
    FROM labels JOIN documents USING (doc_id) GROUP BY 1),
    t AS (SELECT a.n AS n1, b.n AS n2, a.mean - b.mean AS gap,
    ((a.n - 1) * a.var + (b.n - 1) * b.var) / (a.n + b.n - 2) AS v FROM g a, g b WHERE a.grp = 1 AND b.grp = 0)"""


@query("t_test", f"""WITH {T_SQL} SELECT n1, n2, n1 + n2 - 2 AS df,
    round(gap / sqrt(v * (1 / n1 + 1 / n2)), 6) AS statistic, round(gap / sqrt(v), 6) AS effect_size FROM t""")
def t_test(spark, d):
    out = S.t_test(labelled_lengths(spark, d), "quality", "score", 1, 0)
    return out.select(
        F.col("a_n").alias("n1"), F.col("b_n").alias("n2"), "df",
        F.round("statistic", 6).alias("statistic"), F.round("effect_size", 6).alias("effect_size"),
    )


ANOVA_SQL = f"""{MOMENTS_SQL}, s AS (SELECT count(*) AS k, sum(n) AS total_n, sum(n * mean) / sum(n) AS gm,
    sum((n - 1) * var) AS ssw FROM m), b AS (SELECT sum(n * pow(mean - gm, 2)) AS ssb FROM m, s)"""


@query("anova", f"""WITH {ANOVA_SQL} SELECT k, CAST(total_n AS BIGINT) AS total_n, k - 1 AS df1,
    CAST(total_n - k AS BIGINT) AS df2, round((ssb / (k - 1)) / (ssw / (total_n - k)), 6) AS statistic,
    round(ssb / (ssb + ssw), 8) AS effect_size FROM s, b""")
def anova(spark, d):
    out = S.anova(score_moments(spark, d))
    return out.withColumn("statistic", F.round("statistic", 6)).withColumn("effect_size", F.round("effect_size", 8))


@query("eta_from_f", f"""WITH {ANOVA_SQL} SELECT round(ssb / (ssb + ssw), 8) AS eta_squared FROM s, b""")
def eta_from_f(spark, d):
    out = S.anova(score_moments(spark, d))
    eta = S.eta_squared(F.col("statistic"), F.col("df1"), F.col("df2"))
    return out.select(F.round(eta, 8).alias("eta_squared"))


@query("pearson", """SELECT event_type AS provider, count(*) AS n,
    round(corr(CAST(props->>'k' AS DOUBLE), value), 8) AS r FROM events GROUP BY 1""")
def pearson(spark, d):
    events = table(spark, d, "events").select(
        F.col("event_type").alias("provider"), F.get_json_object("props", "$.k").cast("double").alias("k"), "value")
    out = S.pearson(events, "k", "value", ["provider"])
    return out.withColumn("r", F.round("r", 8))


@query("spearman", f"""WITH e AS (SELECT event_type AS provider, CAST(props->>'k' AS DOUBLE) AS k, value FROM events),
    r AS (SELECT provider, rank() OVER (PARTITION BY provider ORDER BY k)
        + (count(*) OVER (PARTITION BY provider, k) - 1) / 2 AS rk,
        rank() OVER (PARTITION BY provider ORDER BY value)
        + (count(*) OVER (PARTITION BY provider, value) - 1) / 2 AS rv FROM e)
    SELECT provider, count(*) AS n, round(corr(rk, rv), 8) AS rho FROM r GROUP BY 1""")
def spearman(spark, d):
    events = table(spark, d, "events").select(
        F.col("event_type").alias("provider"), F.get_json_object("props", "$.k").cast("double").alias("k"), "value")
    out = S.spearman(events, "k", "value", ["provider"])
    return out.select("provider", "n", F.round("r", 8).alias("rho"))


PAIR_SQL = f"""{MOMENTS_SQL}, p AS (SELECT a.grp AS first, b.grp AS second, a.n AS n1, b.n AS n2, a.mean AS m1,
    a.mean - b.mean AS gap, ((a.n - 1) * a.var + (b.n - 1) * b.var) / (a.n + b.n - 2) AS v
    FROM m a JOIN m b ON a.grp <> b.grp)"""


@query("pairwise", f"""WITH {PAIR_SQL} SELECT first, second, n1 + n2 - 2 AS df,
    round(gap / sqrt(v * (1 / n1 + 1 / n2)), 6) AS statistic, round(gap / sqrt(v), 8) AS effect_size FROM p""")
def pairwise(spark, d):
    return S.pairs(score_moments(spark, d)).select(
        F.col("a_grp").alias("first"), F.col("b_grp").alias("second"), "df",
        F.round("statistic", 6).alias("statistic"), F.round("effect_size", 8).alias("effect_size"),
    )


@query("effect_vs_best", f"""WITH {PAIR_SQL} SELECT first || '_vs_' || second AS comparison,
    round(gap / sqrt(v), 8) AS effect_size,
    CASE WHEN abs(gap / sqrt(v)) < 0.2 THEN 'negligible' WHEN abs(gap / sqrt(v)) < 0.5 THEN 'small'
    WHEN abs(gap / sqrt(v)) < 0.8 THEN 'medium' ELSE 'large' END AS label
    FROM p WHERE m1 = (SELECT max(mean) FROM m)""")
def effect_vs_best(spark, d):
    out = S.effect_vs_best(score_moments(spark, d))
    return out.select("comparison", F.round("effect_size", 8).alias("effect_size"),
                      S.effect_label(F.col("effect_size")).alias("label"))


@query("effect_words", f"""WITH {PAIR_SQL} SELECT first, second, CASE WHEN abs(gap / sqrt(v)) > 0.8 THEN 'Large' WHEN abs(gap / sqrt(v)) > 0.5 THEN 'Medium'
    ELSE 'Small' END AS label, CASE WHEN abs(gap / sqrt(v)) > 0.8 THEN 'strong' WHEN abs(gap / sqrt(v)) > 0.5 THEN 'moderate' ELSE 'weak' END AS significance FROM p""")
def effect_words(spark, d):
    """Both three-step labels of every pair's effect size."""
    d_ = F.col("effect_size")
    return S.pairs(score_moments(spark, d)).select(
        F.col("a_grp").alias("first"), F.col("b_grp").alias("second"), S.effect_word(d_).alias("label"),
        S.effect_word(d_, ("strong", "moderate", "weak")).alias("significance"))


@query("rank_providers", f"""WITH {MOMENTS_SQL}, r AS (SELECT *,
    row_number() OVER (ORDER BY mean DESC, grp) AS rank, count(*) OVER () AS k FROM m)
    SELECT grp AS provider, n, round(mean, 6) AS mean, round(sqrt(var), 6) AS std, min, max, rank,
    (k - rank + 1) / k * 100 AS percentile FROM r""")
def rank_providers(spark, d):
    ranked = S.rank_groups(score_moments(spark, d))
    return ranked.select(
        F.col("grp").alias("provider"), "n", F.round("mean", 6).alias("mean"),
        F.round(F.sqrt("var"), 6).alias("std"), "min", "max", "rank", "percentile",
    )


@query("box_plot", f"""WITH {SCORES_SQL} SELECT provider, min(score) AS low, round(quantile_cont(score, 0.25), 6) AS q25,
    round(quantile_cont(score, 0.5), 6) AS median, round(quantile_cont(score, 0.75), 6) AS q75, max(score) AS high
    FROM scores GROUP BY 1""")
def box_plot(spark, d):
    five = S.describe(scores(spark, d), "provider", "score")
    return five.select("provider", F.col("min").alias("low"), F.round("q25", 6).alias("q25"),
                       F.round("median", 6).alias("median"), F.round("q75", 6).alias("q75"),
                       F.col("max").alias("high"))


@query("intervals", f"""WITH {MOMENTS_SQL}, q AS (SELECT *, CASE WHEN n > 1 THEN {tails.t_quantile(0.975, "(n - 1)")} * sqrt(var / n) ELSE 0.0 END AS h FROM m)
    SELECT grp AS provider, n, round(mean, 6) AS mean, round(mean - h, 6) AS ci_low, round(mean + h, 6) AS ci_high FROM q""")
def intervals(spark, d):
    out = S.with_interval(score_moments(spark, d))
    return rounded(out.select(F.col("grp").alias("provider"), "n", "mean", "ci_low", "ci_high"), 6,
                   "mean", "ci_low", "ci_high")


def verdict_sql(start: str, found: str, none: str) -> str:
    return f"{start} || CASE WHEN p < 0.05 THEN '{found}' ELSE '{none}' END || format('{{:.4f}}', p) || ')'"


T_TEXT = verdict_sql("'T-test comparing ' || n1 || ' vs ' || n2 || ' samples'", " - Significant difference (p=", " - No significant difference (p=")
A_TEXT = verdict_sql("'ANOVA comparing ' || k", " groups - Significant differences found (p=", " groups - No significant differences (p=")
TESTED_SQL = f"""{PAIR_SQL}, tt AS (SELECT *, gap / sqrt(v * (1 / n1 + 1 / n2)) AS t, n1 + n2 - 2 AS df FROM p),
    tp AS (SELECT *, {tails.p_two_sided("t", "df")} AS p FROM tt)"""
ANOVA_P_SQL = f"""s AS (SELECT count(*) AS k, sum(n) AS total_n, sum(n * mean) / sum(n) AS gm, sum((n - 1) * var) AS ssw FROM m),
    b AS (SELECT sum(n * pow(mean - gm, 2)) AS ssb FROM m, s),
    av AS (SELECT k, ssb, ssw, (ssb / (k - 1)) / (ssw / (total_n - k)) AS f, (k - 1) AS d1, (total_n - k) AS d2 FROM s, b),
    ap AS (SELECT *, {tails.p_f("f", "d1", "d2")} AS p FROM av)"""
R_SQL = """ev AS (SELECT event_type AS provider, CAST(props->>'k' AS DOUBLE) AS k, value FROM events),
    rk AS (SELECT *, rank() OVER (PARTITION BY provider ORDER BY k) + (count(*) OVER (PARTITION BY provider, k) - 1) / 2 AS r1,
        rank() OVER (PARTITION BY provider ORDER BY value) + (count(*) OVER (PARTITION BY provider, value) - 1) / 2 AS r2 FROM ev),
    rr AS (SELECT 'pearson' AS test, provider, corr(k, value) AS r, count(*) AS n FROM rk GROUP BY 2
        UNION ALL SELECT 'spearman', provider, corr(r1, r2), count(*) FROM rk GROUP BY 2)"""


@query("p_values", f"""WITH {TESTED_SQL}, {ANOVA_P_SQL}, {R_SQL}
    SELECT 't_test' AS test, first || ' vs ' || second AS subject, round(t, 6) AS statistic, round(p, 6) AS p_value, {T_TEXT} AS description FROM tp
    UNION ALL SELECT 'anova', 'all groups', round(f, 6), round(p, 6), {A_TEXT} FROM ap
    UNION ALL SELECT test, provider, round(r, 6), round({tails.p_two_sided("r * sqrt((n - 2) / (1 - r * r))", "(n - 2)")}, 6), NULL FROM rr""")
def p_values(spark, d):
    """p values of the pairwise t-tests, the one-way test and both correlations."""
    m = score_moments(spark, d)
    t = S.with_p(S.pairs(m)).select(
        F.lit("t_test").alias("test"), F.concat_ws(" vs ", "a_grp", "b_grp").alias("subject"),
        "statistic", "p_value", "description")
    a = S.anova_p(S.anova(m)).select(
        F.lit("anova").alias("test"), F.lit("all groups").alias("subject"), "statistic", "p_value", "description")
    events = table(spark, d, "events").select(
        "event_type", F.get_json_object("props", "$.k").cast("double").alias("k"), "value")

    def correlation(name, frame):
        return S.correlation_p(frame, "r", "n").select(
            F.lit(name).alias("test"), F.col("event_type").alias("subject"),
            F.col("r").alias("statistic"), "p_value", F.lit(None).cast("string").alias("description"))

    both = correlation("pearson", S.pearson(events, "k", "value", ["event_type"])).unionByName(
        correlation("spearman", S.spearman(events, "k", "value", ["event_type"])))
    out = t.unionByName(a).unionByName(both)
    return rounded(out, 6, "statistic", "p_value")


@query("one_sided_tests", f"""WITH {PAIR_SQL}, tt AS (SELECT *, gap / sqrt(v * (1 / n1 + 1 / n2)) AS t, n1 + n2 - 2 AS df FROM p),
    x AS (SELECT first, second, {tails.p_less("t", "df")} AS less FROM tt)
    SELECT first, second, round(less, 6) AS p_less, round(1 - less, 6) AS p_greater FROM x""")
def one_sided_tests(spark, d):
    """Both one-sided alternatives of every pair."""
    p = S.pairs(score_moments(spark, d))
    less, greater = (S.with_p(p, a).select("a_grp", "b_grp", F.round("p_value", 6).alias(f"p_{a}")) for a in ("less", "greater"))
    return less.join(greater, ["a_grp", "b_grp"]).select(F.col("a_grp").alias("first"), F.col("b_grp").alias("second"), "p_less", "p_greater")


@query("test_power", f"""WITH {PAIR_SQL}, best AS (SELECT grp FROM m ORDER BY mean DESC, grp LIMIT 1),
    x AS (SELECT first, second, abs(gap / sqrt(v)) * sqrt(least(n1, n2) / 2) - {dist.normal_quantile(0.975)!r} AS z FROM p JOIN best ON first = best.grp)
    SELECT first AS a_grp, second AS b_grp, round({tails.normal_cdf("z")}, 6) AS power FROM x""")
def test_power(spark, d):
    """Power of each comparison with the best group, at the smaller group size."""
    m = score_moments(spark, d)
    best = m.agg(F.min_by("grp", F.struct(-F.col("mean"), F.col("grp")))).scalar()
    p = S.pairs(m).where(F.col("a_grp") == best)
    n = F.least("a_n", "b_n").cast("double")
    return p.select("a_grp", "b_grp", F.round(S.power(n, F.col("effect_size")), 6).alias("power"))


@query("full_report", f"""WITH {TESTED_SQL}, {ANOVA_P_SQL},
    q AS (SELECT *, {tails.t_quantile(0.975, "(n - 1)")} * sqrt(var / n) AS h FROM m),
    r AS (SELECT *, row_number() OVER (ORDER BY mean DESC, grp) AS rank, count(*) OVER () AS k FROM q),
    long AS (SELECT 'ranking' AS section, grp AS subject, unnest(['n', 'mean', 'min', 'max', 'ci_low', 'ci_high', 'rank', 'percentile']) AS measure,
        unnest([n, mean, min, max, mean - h, mean + h, rank, (k - rank + 1) / k * 100]::DOUBLE[]) AS value FROM r
    UNION ALL SELECT 'anova', 'all groups', unnest(['statistic', 'p_value', 'effect_size']), unnest([f, p, ssb / (ssb + ssw)]::DOUBLE[]) FROM ap
    UNION ALL SELECT 'pairs', first || ' vs ' || second, unnest(['statistic', 'p_value', 'effect_size']), unnest([t, p, gap / sqrt(v)]::DOUBLE[]) FROM tp
    UNION ALL SELECT 'effects', first || '_vs_' || second, 'effect_size', gap / sqrt(v) FROM tp WHERE m1 = (SELECT max(mean) FROM m))
    SELECT section, subject, measure, round(value, 5) AS value FROM long""")
def full_report(spark, d):
    """Ranking, one-way test, pairs and effect sizes of the score table."""
    return rounded(S.full_report(scores(spark, d), "provider", "score"), 5, "value")
