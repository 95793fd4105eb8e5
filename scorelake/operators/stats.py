"""Grouped inference.

One aggregation turns the score table into count, mean and sample variance per group;
all tests are arithmetic on those few rows, so raw scores shuffle once and only as
partial aggregates.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions import dist
from scorelake.operators.ordering import average_ranks, exact_quantiles, row_positions
from scorelake.session import kept


def moments(df: DataFrame, group: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    rows = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    return kept(rows.groupBy(*by, F.col(group).alias("grp")).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"),
        F.var_samp(value).alias("var"), F.min(value).alias("min"), F.max(value).alias("max"),
    ))


def describe(df: DataFrame, group: str, value: str) -> DataFrame:
    basic = moments(df, group, value).select(
        F.col("grp").alias(group), "n", "mean", F.sqrt("var").alias("std"), "min", "max"
    )
    marks = exact_quantiles(
        df.where(F.col(group).isNotNull()), value, {"q25": 0.25, "median": 0.5, "q75": 0.75}, [group]
    )
    return basic.join(marks, group)


def with_interval(m: DataFrame, level: float = 0.95) -> DataFrame:
    """t interval of the mean; a single observation gives (x, x)."""
    margin = dist.t_quantile(1 - (1 - level) / 2, (F.col("n") - 1).cast("double")) * F.sqrt(
        F.col("var") / F.col("n")
    )
    wide = F.when(F.col("n") > 1, margin).otherwise(0.0)
    return m.withColumn("_margin", wide).withColumn("ci_low", F.col("mean") - F.col("_margin")).withColumn(
        "ci_high", F.col("mean") + F.col("_margin")
    ).drop("_margin")


def pooled(prefix_a: str = "a_", prefix_b: str = "b_") -> dict[str, Column]:
    """Statistic, degrees of freedom and Cohen's d of a pooled-variance t-test."""
    n1, n2 = F.col(prefix_a + "n"), F.col(prefix_b + "n")
    v1, v2 = F.coalesce(prefix_a + "var", F.lit(0.0)), F.coalesce(prefix_b + "var", F.lit(0.0))
    df = n1 + n2 - 2
    var = ((n1 - 1) * v1 + (n2 - 1) * v2) / df
    gap = F.col(prefix_a + "mean") - F.col(prefix_b + "mean")
    usable = (df > 0) & (var > 0)
    return {
        "statistic": F.when(usable, gap / F.sqrt(var * (1 / n1 + 1 / n2))),
        "df": df,
        "effect_size": F.when(usable, gap / F.sqrt(var)),
    }


def with_p(tested: DataFrame, alternative: str = "two-sided", alpha: float = 0.05) -> DataFrame:
    t, df = F.col("statistic"), F.col("df").cast("double")
    p = {
        "two-sided": lambda: dist.p_two_sided(t, df),
        "less": lambda: dist.p_less(t, df),
        "greater": lambda: dist.p_less(-t, df),
    }[alternative]()
    labelled = tested.withColumn("p_value", p).withColumn("significant", F.col("p_value") < alpha)
    verdict = F.when(F.col("significant"), " - Significant difference (p=").otherwise(
        " - No significant difference (p="
    )
    return labelled.withColumn(
        "description",
        F.concat(  # fixed values: the words of the sentence
            F.lit("T-test comparing "), F.col("a_n"), F.lit(" vs "), F.col("b_n"), F.lit(" samples"),
            verdict, F.format_string("%.4f", "p_value"), F.lit(")"),
        ),
    )


def pairs(m: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every ordered pair of different groups (of the same metric), from group moments.

    The moments are one short row per group.  They are laid beside every group as an
    array, so the raw scores take no part in the pairing.
    """
    by, others = list(by), [c for c in m.columns if c not in by]
    left = m.select(*by, *[F.col(c).alias("a_" + c) for c in others])
    listed = m.groupBy(*by).agg(F.collect_list(F.struct(*others)).alias("_all"))
    beside = left.join(listed, by) if by else left.withColumn("_all", listed.scalar())
    long = beside.withColumn("_b", F.explode("_all")).select(
        *by, *["a_" + c for c in others], *[F.col(f"_b.{c}").alias("b_" + c) for c in others])
    return long.where(F.col("a_grp") != F.col("b_grp")).withColumns(pooled())


def t_test(df: DataFrame, group: str, value: str, first, second) -> DataFrame:
    m = moments(df.where(F.col(group).isin(first, second)), group, value)
    return pairs(m).where((F.col("a_grp") == first) & (F.col("b_grp") == second))


def anova(m: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row (per ``by``): F, degrees of freedom, eta squared."""
    by = list(by)
    grand = m.groupBy(*by).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand_mean"))
    centred = m.join(grand, by) if by else m.withColumn("grand_mean", grand.scalar())
    sums = centred.groupBy(*by).agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("total_n"),
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand_mean"), 2)).alias("ss_between"),
        F.sum((F.col("n") - 1) * F.coalesce("var", F.lit(0.0))).alias("ss_within"),
    )
    d1, d2 = F.col("k") - 1, F.col("total_n") - F.col("k")
    ratio = (F.col("ss_between") / d1) / (F.col("ss_within") / d2)
    total = F.col("ss_between") + F.col("ss_within")
    enough = F.col("k") >= 2
    return sums.select(
        *by, "k", "total_n",
        F.when(enough, ratio).otherwise(0.0).alias("statistic"), d1.alias("df1"), d2.alias("df2"),
        F.when(enough & (total > 0), F.col("ss_between") / total).when(enough, 0.0).alias("effect_size"),
    )


def anova_p(tested: DataFrame, alpha: float = 0.05) -> DataFrame:
    d = [F.col(c).cast("double") for c in ("statistic", "df1", "df2")]
    p = F.when(F.col("k") < 2, 1.0).otherwise(dist.p_f(*d))
    found = F.when(F.col("p_value") < alpha, " groups - Significant differences found (p=").otherwise(
        " groups - No significant differences (p="
    )
    text = F.concat(
        F.lit("ANOVA comparing "), F.col("k"), found, F.format_string("%.4f", "p_value"), F.lit(")")
    )
    return (
        tested.withColumn("p_value", p)
        .withColumn("significant", F.col("p_value") < alpha)
        .withColumn("description", F.when(F.col("k") < 2, "Insufficient groups for ANOVA").otherwise(text))
    )


def eta_squared(f: Column, df1: Column, df2: Column) -> Column:
    return f * df1 / (f * df1 + df2)


def correlation_p(table: DataFrame, r: str, n: str) -> DataFrame:
    """Adds the two-sided p value of a correlation from its r and n."""
    df = (F.col(n) - 2).cast("double")
    t = F.col(r) * F.sqrt(df / (1 - F.col(r) * F.col(r)))
    exact = F.abs(r) >= 1
    return table.withColumn("p_value", F.when(exact, 0.0).otherwise(dist.p_two_sided(t, df)))


def pearson(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return rows.groupBy(*by).agg(F.corr(x, y).alias("r"), F.count(F.lit(1)).alias("n"))


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of average ranks, over counted (x, y) pairs."""
    by = list(by)
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if not by:
        rows, keys = rows.withColumn("_all", F.lit(0)), ["_all"]
    else:
        keys = by
    # the rows are read once, for the counted pairs; both ranks follow from those
    cells = kept(rows.groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("c")))

    def ranks(value: str, name: str) -> DataFrame:
        counted = cells.groupBy(*keys, value).agg(F.sum("c").alias("n_rows"))
        return average_ranks(cells, value, keys, name, counted)

    rx, ry = ranks(x, "rx").drop("n_group"), ranks(y, "ry")
    ranked = cells.join(rx, [*keys, x]).join(ry, [*keys, y])
    middle = (F.col("n_group") + 1) / 2
    dx, dy = F.col("rx") - middle, F.col("ry") - middle
    sums = ranked.groupBy(*keys).agg(
        F.sum(F.col("c") * dx * dy).alias("xy"), F.sum(F.col("c") * dx * dx).alias("xx"),
        F.sum(F.col("c") * dy * dy).alias("yy"), F.sum("c").alias("n"),
    )
    return sums.select(*by, (F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).alias("r"), "n")


def effect_vs_best(m: DataFrame) -> DataFrame:
    """Cohen's d of the group with the best mean against every other group."""
    columns = ["grp", "n", "mean", "var"]
    top = m.agg(F.min_by(F.struct(*columns), F.struct(-F.col("mean"), F.col("grp")))).scalar()
    other = m.select(*[F.col(c).alias("b_" + c) for c in columns]).withColumn("_top", top)
    both = other.select(*[F.col(f"_top.{c}").alias("a_" + c) for c in columns], *["b_" + c for c in columns])
    tested = both.where(F.col("a_grp") != F.col("b_grp")).withColumns(pooled())
    return tested.select(F.concat("a_grp", F.lit("_vs_"), "b_grp").alias("comparison"), "effect_size")


def rank_groups(m: DataFrame) -> DataFrame:
    """Unique ranks by descending mean and the percentile each rank stands for."""
    total = m.agg(F.count(F.lit(1)))
    placed = row_positions(m.withColumn("_neg", -F.col("mean")), "_neg", name="_position", ties=["grp"])
    rank = F.col("_position") + 1
    return (
        placed.withColumn("rank", rank)
        .withColumn("percentile", (total.scalar() - rank + 1) / total.scalar() * 100)
        .drop("_neg", "_position")
    )


def effect_label(d: Column) -> Column:
    a = F.abs(d)
    return (
        F.when(a < 0.2, "negligible").when(a < 0.5, "small").when(a < 0.8, "medium").when(a.isNotNull(), "large")
    )


def power(n: Column, d: Column, alpha: float = 0.05) -> Column:
    """Normal-approximation power of a two-sided two-sample test with n per group."""
    critical = dist.normal_quantile(1 - alpha / 2)
    return dist.normal_cdf(F.abs(d) * F.sqrt(n / 2) - critical)


def tukey_pairs(m: DataFrame) -> DataFrame:
    """Tukey's honest significant differences of all pairs of groups."""
    whole = anova(m).select("k", "df2")
    within = m.agg(F.sum((F.col("n") - 1) * F.coalesce("var", F.lit(0.0)))).scalar()
    df2, k = whole.select("df2").scalar(), whole.select("k").scalar()
    both = pairs(m).where(F.col("a_grp") < F.col("b_grp"))
    error = F.sqrt(within / df2 / 2 * (1 / F.col("a_n") + 1 / F.col("b_n")))
    tested = both.select(
        "a_grp", "b_grp", (F.col("a_mean") - F.col("b_mean")).alias("difference"),
        (F.abs(F.col("a_mean") - F.col("b_mean")) / error).alias("q"), k.cast("double").alias("k"), df2.cast("double").alias("df"))
    return tested.withColumn("p_value", dist.p_studentized_range("q", "k", "df"))


#: Draws that one digest gives, hexadecimal digits of each.
DRAWS, DIGITS = 8, 4


def poisson_steps(most: int = 9) -> list[int]:
    """A 16-bit number is a weight of w if it reaches w of these steps: the distribution of Poisson(1)."""
    steps, upto, term = [], 0.0, math.exp(-1)
    for w in range(most):
        upto += term
        steps.append(math.floor(upto * 16**DIGITS))
        term /= w + 1
    return [x for x in steps if x < 16**DIGITS]


def bootstrap_intervals(
    df: DataFrame, group: str, value: str, key: str, replicates: int = 1000, level: float = 0.95
) -> DataFrame:
    """Percentile interval of the mean over Poisson-weighted resamples.

    A row's weights come from the md5 of its key and the number of a block of replicates, by the
    inverse distribution, so any engine and any retried task draws the same.  The products of rows
    and blocks are added up where they are made; only sums per group and block travel.
    """
    rows = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(
        F.col(group).alias("grp"), F.col(value).cast("double").alias("x"), F.col(key).cast("string").alias("key"))
    blocks = -(-replicates // DRAWS)
    drawn = rows.select("grp", "x", "key", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).select(
        "grp", "x", "block", F.md5(F.concat_ws("-", "key", "block").cast("binary")).alias("digest"))

    def weight(j: int) -> Column:
        u = F.conv(F.substring("digest", 1 + DIGITS * j, DIGITS), 16, 10).cast("int")
        return sum((F.when(u >= step, 1.0).otherwise(0.0) for step in poisson_steps()), F.lit(0.0))

    weights = drawn.select("grp", "x", "block", *[weight(j).alias(f"w{j}") for j in range(DRAWS)])
    sums = weights.groupBy("grp", "block").agg(*[F.sum(f"w{j}").alias(f"w{j}") for j in range(DRAWS)], *[F.sum(F.col(f"w{j}") * F.col("x")).alias(f"s{j}") for j in range(DRAWS)])
    each = F.explode(F.array(*[F.struct((F.col("block") * DRAWS + j).alias("replicate"), (F.col(f"s{j}") / F.nullif(F.col(f"w{j}"), F.lit(0.0))).alias("m")) for j in range(DRAWS)]))
    means = sums.select("grp", each.alias("r")).select("grp", "r.replicate", "r.m").where(F.col("replicate") < replicates)
    tail = (1 - level) / 2
    ends = F.percentile("m", F.array(F.lit(tail), F.lit(1 - tail)))
    return means.groupBy("grp").agg(ends.alias("_e"), F.avg("m").alias("mean")).select(
        F.col("grp").alias(group), "mean", F.col("_e")[0].alias("ci_low"), F.col("_e")[1].alias("ci_high"))


def full_report(df: DataFrame, group: str, value: str) -> DataFrame:
    """Ranking, one-way test, pairs and effect sizes as one long table."""
    m = moments(df, group, value)
    ranked = rank_groups(with_interval(m))

    def long(section: str, frame: DataFrame, key: Column, names: Sequence[str]) -> DataFrame:
        wide = frame.select(key.alias("subject"), *[F.col(n).cast("double").alias(n) for n in names])
        return wide.unpivot("subject", list(names), "measure", "value").select(F.lit(section).alias("section"), "subject", "measure", "value")

    return (
        long("ranking", ranked, F.col("grp"), ["n", "mean", "min", "max", "ci_low", "ci_high", "rank", "percentile"])
        .unionByName(long("anova", anova_p(anova(m)), F.lit("all groups"), ["statistic", "p_value", "effect_size"]))
        .unionByName(long("pairs", with_p(pairs(m)), F.concat_ws(" vs ", "a_grp", "b_grp"), ["statistic", "p_value", "effect_size"]))
        .unionByName(long("effects", effect_vs_best(m), F.col("comparison"), ["effect_size"]))
    )


def effect_word(d: Column, words: Sequence[str] = ("Large", "Medium", "Small")) -> Column:
    """Three-step label of an effect size: beyond 0.8, beyond 0.5, the rest."""
    large, medium, small = words
    a = F.abs(d)
    return F.when(a > 0.8, large).when(a > 0.5, medium).when(a.isNotNull(), small)
