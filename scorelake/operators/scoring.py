"""Scoring jobs over tables of (query, response, context, truth, tokens, time) rows."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.functions import similarity, text

UNSHARED_IDF = 1 + math.log(3 / 2)


def tfidf_relevance(
    df: DataFrame, key: str, query: str, response: str, context: str | None = None,
    stop_words: Sequence[str] = text.RELEVANCE_STOP_WORDS, max_terms: int | None = None,
) -> DataFrame:
    """Cosine of the two texts of each row under TF-IDF fitted on just those two texts.

    The fit concerns one row, so rows are dealt out by their key once and its terms are counted,
    weighted and summed where they are.  ``max_terms`` keeps a row's most frequent terms only.
    """
    asked = F.col(query)
    if context:
        asked = F.when(F.length(context) > 0, F.concat_ws(" ", query, context)).otherwise(asked)
    both = df.select(key, asked.alias("_asked"), F.col(response).alias("_said")).repartition(key).select(
        key,
        F.explode_outer(
            F.concat(
                F.transform(text.terms("_asked", stop_words), lambda t: F.struct(t.alias("term"), F.lit(1).alias("q"), F.lit(0).alias("r"))),
                F.transform(text.terms("_said", stop_words), lambda t: F.struct(t.alias("term"), F.lit(0).alias("q"), F.lit(1).alias("r"))),
            )
        ).alias("x"),
    )
    counted = both.groupBy(key, F.col("x.term").alias("term")).agg(
        F.coalesce(F.sum("x.q"), F.lit(0)).alias("q"), F.coalesce(F.sum("x.r"), F.lit(0)).alias("r")
    )
    kept = counted
    if max_terms:
        order = Window.partitionBy(key).orderBy((F.col("q") + F.col("r")).desc(), "term")
        kept = counted.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= max_terms)
    shared = (F.col("q") > 0) & (F.col("r") > 0)
    idf = F.when(shared, 1.0).otherwise(UNSHARED_IDF)
    sums = kept.groupBy(key).agg(
        F.sum(F.col("q") * F.col("r")).alias("dot"),
        F.sum(F.pow(F.col("q") * idf, 2)).alias("qq"),
        F.sum(F.pow(F.col("r") * idf, 2)).alias("rr"),
    )
    both_present = (F.col("qq") > 0) & (F.col("rr") > 0)
    return sums.select(
        key,
        F.when(both_present, F.col("dot") / F.sqrt(F.col("qq") * F.col("rr"))).otherwise(0.0).alias("relevance"),
    )


def coherence(response: str) -> Column:
    similar = similarity.adjacent_ratio(text.sentences(response))
    return F.when(
        F.size(text.sentences(response)) >= 2, 0.7 * similar + 0.3 * text.connector_score(response)
    ).otherwise(1.0)


def population_std(columns: Sequence[Column]) -> Column:
    mean = sum(columns[1:], columns[0]) / len(columns)
    squares = [(c - mean) * (c - mean) for c in columns]
    return F.sqrt(sum(squares[1:], squares[0]) / len(columns))


def overall(weights: Mapping[str, float] = text.OVERALL_WEIGHTS) -> dict[str, Column]:
    """Weighted score and its interval of one population deviation, within [0, 1]."""
    parts = [F.col(c) for c in weights]
    score = sum((w * F.col(c) for c, w in weights.items()), F.lit(0.0))
    std = population_std(parts)
    return {
        "overall_score": score,
        "ci_low": F.greatest(score - std, F.lit(0.0)),
        "ci_high": F.least(score + std, F.lit(1.0)),
    }


def score_responses(
    df: DataFrame, key: str = "id", query: str = "query", response: str = "response",
    truth: str = "truth", ms: str = "response_time_ms", tokens: str = "tokens_used",
    context: str | None = None,
) -> DataFrame:
    """All six metrics, the overall score and its interval for every response.

    A response without a reference answer keeps its row with zero scores.
    """
    relevance = tfidf_relevance(df, key, query, response, context)
    known = F.col(truth).isNotNull()
    scored = df.join(relevance, key).withColumns({
        "factual_accuracy": text.fact_f1(response, truth),
        "token_efficiency": text.token_efficiency(response, tokens, query),
        "coherence": coherence(response),
        "completeness": text.completeness(response, query),
        "time_efficiency": text.time_efficiency(ms, F.length(response)),
    })
    zeroed = scored.withColumns({c: F.when(known, F.col(c)).otherwise(0.0) for c in text.OVERALL_WEIGHTS})
    return zeroed.withColumns(overall())
