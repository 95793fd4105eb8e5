"""Roll-ups of evaluation, batch and health logs.

Per-group and overall rows come from one pass with ``rollup`` or grouping sets; the
pivoted status values are given, not discovered, so no extra job runs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OVERALL = "(overall)"


def per_group_and_overall(df: DataFrame, group: str, aggregates: Sequence[Column]) -> DataFrame:
    rolled = df.where(F.col(group).isNotNull()).rollup(group)
    return rolled.agg(*aggregates).withColumn(group, F.coalesce(group, F.lit(OVERALL)))


def provider_summary(
    df: DataFrame, provider: str, overall: str, means: Mapping[str, str] | None = None
) -> DataFrame:
    extra = [F.avg(c).alias(n) for n, c in (means or {}).items()]
    return per_group_and_overall(df, provider, [
        F.count(F.lit(1)).alias("total_evaluations"), F.avg(overall).alias("avg_overall"),
        F.stddev_pop(overall).alias("std_overall"), F.min(overall).alias("min_overall"),
        F.max(overall).alias("max_overall"), *extra,
    ])


def best_and_worst(means: DataFrame, key: str, measure: str) -> DataFrame:
    """Keys with the largest and smallest measure; ties go to the first key."""
    return means.agg(
        F.min(F.struct(-F.col(measure), F.col(key)))[key].alias("best"),
        F.min(F.struct(F.col(measure), F.col(key)))[key].alias("worst"),
    )


def compare_by_question(
    df: DataFrame, question: str, provider: str, score: str, truth_coverage: float = 1.0,
    response_coverage: float = 0.4,
) -> DataFrame:
    """Answers per question: mean, range, best and worst provider, coverage gap."""
    scored = df.where(F.col(score).isNotNull())
    return scored.groupBy(question).agg(
        F.count(F.lit(1)).alias("n_responses"), F.avg(score).alias("avg_accuracy"),
        F.min(score).alias("min_accuracy"), F.max(score).alias("max_accuracy"),
        F.min(F.struct(-F.col(score), F.col(provider)))[provider].alias("best_provider"),
        F.min(F.struct(F.col(score), F.col(provider)))[provider].alias("worst_provider"),
    ).withColumns({
        "truth_coverage": F.lit(truth_coverage), "response_coverage": F.lit(response_coverage),
        "coverage_gap": F.lit(truth_coverage - response_coverage),
    })


def counts_by_each(df: DataFrame, *keys: str, length: str | None = None) -> DataFrame:
    """Row counts by each key on its own and in total, in one pass."""
    sets = [[k] for k in keys] + [[]]
    grouped = df.groupingSets(sets, *keys)
    aggregates = [F.count(F.lit(1)).alias("n")]
    if length:
        aggregates.append(F.avg(F.length(length)).alias("avg_length"))
    tagged = grouped.agg(F.grouping_id().alias("_gid"), *aggregates)
    width = len(keys)
    dimension, value = F.lit("total"), F.lit(None).cast("string")
    for i, k in enumerate(keys):
        only_k = (2**width - 1) - 2 ** (width - 1 - i)
        dimension = F.when(F.col("_gid") == only_k, F.lit(k)).otherwise(dimension)
        value = F.when(F.col("_gid") == only_k, F.col(k).cast("string")).otherwise(value)
    return tagged.select(
        dimension.alias("dimension"), value.alias("value"), *[c for c in tagged.columns if c in ("n", "avg_length")]
    )


def run_summary(
    df: DataFrame, group: str, ok: Column, means: Mapping[str, str], totals: Mapping[str, str] | None = None
) -> DataFrame:
    """Total, successful, failed, success rate; means over successful rows, zero when none."""
    aggregates = [
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("successful"),
        F.count_if(~ok).alias("failed"), (F.count_if(ok) / F.count(F.lit(1)) * 100).alias("success_rate"),
        *[F.coalesce(F.avg(F.when(ok, F.col(c))), F.lit(0.0)).alias(n) for n, c in means.items()],
        *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in (totals or {}).items()],
    ]
    return per_group_and_overall(df, group, aggregates)


def status_matrix(df: DataFrame, keys: Sequence[str], status: str, values: Sequence[str]) -> DataFrame:
    """One column per status, zero where it never occurs."""
    return df.groupBy(*keys).agg(
        *[F.count_if(F.col(status) == v).alias(v) for v in values]
    )


# fixed values: error keyword families in the order they are tried
RATE_LIMITED = ("rate limit", "quota", "429", "too many requests")
OVERLOADED = ("overloaded", "503", "unavailable")
DEPRECATED = ("decommissioned", "not found", "404")


def _any(text: Column, phrases: Sequence[str]) -> Column:
    return text.rlike("|".join(phrases))


def error_class(error: str) -> Column:
    lowered = F.lower(error)
    return (
        F.when(F.col(error).isNull(), "ok")
        .when(_any(lowered, RATE_LIMITED), "rate_limited")
        .when(_any(lowered, OVERLOADED), "overloaded")
        .when(_any(lowered, DEPRECATED), "deprecated")
        .otherwise("error")
    )


def error_flags(error: str) -> dict[str, Column]:
    lowered = F.lower(F.coalesce(error, F.lit("")))
    return {
        "is_rate_limit": _any(lowered, (*RATE_LIMITED, "exceeded")),
        "is_overloaded": _any(lowered, OVERLOADED),
        "is_deprecated": _any(lowered, DEPRECATED),
    }


def question_completion(df: DataFrame, keys: Sequence[str], failed: Column, expected: int) -> DataFrame:
    done = F.count_if(~failed)
    return df.groupBy(*keys).agg(
        done.alias("successful"), F.count(F.lit(1)).alias("total"),
        (done == expected).alias("fully_answered"), (done < expected).alias("needs_retry"),
    )
