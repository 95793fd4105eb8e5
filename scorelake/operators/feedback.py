"""Session and feedback roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def is_feedback():
    return F.col("record_type") == "industry_feedback"


def session_feedback(log: DataFrame, session_id) -> DataFrame:
    return log.where(F.col("session_id") == session_id)


def industry_feedback(log: DataFrame, industry: str) -> DataFrame:
    return log.where(is_feedback() & (F.col("industry") == industry))


def feedback_summary(log: DataFrame) -> DataFrame:
    return log.agg(
        F.count_if(is_feedback()).alias("feedback_records"),
        F.countDistinct("session_id").alias("sessions"),
        F.count_if(F.col("event_name") == "session_completion").alias("completed_sessions"),
    )


def industry_counts(log: DataFrame) -> DataFrame:
    named = log.where(is_feedback()).withColumn("industry", F.coalesce("industry", F.lit("unknown")))
    return named.groupBy("industry").agg(F.count(F.lit(1)).alias("n"))


def session_stats(log: DataFrame) -> DataFrame:
    """Responses, industries, life cycle and the mean over all single rating values."""
    rating_sum = F.aggregate(F.map_values("ratings"), F.lit(0), lambda a, r: a + r)
    enriched = log.withColumn("_sum", rating_sum).withColumn("_n", F.size(F.map_values("ratings")))
    rated = F.when(is_feedback(), F.col("_n"))
    mean = F.sum(F.when(is_feedback(), F.col("_sum"))) / F.sum(rated)
    return enriched.groupBy("session_id").agg(
        F.count_if(is_feedback()).alias("responses"),
        F.countDistinct(F.when(is_feedback(), F.col("industry"))).alias("industries"),
        F.bool_or(F.coalesce(F.col("event_name") == "session_start", F.lit(False))).alias("started"),
        F.bool_or(F.coalesce(F.col("event_name") == "session_completion", F.lit(False))).alias("completed"),
        F.coalesce(mean, F.lit(0.0)).alias("mean_rating"),
        (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))).alias("duration_us"),
    )


def completion_grid(log: DataFrame, industries: Sequence[str]) -> DataFrame:
    """Completion flag of every session for every industry of the fixed list."""
    done = [
        F.bool_or(F.coalesce(is_feedback() & (F.col("industry") == i), F.lit(False))).alias(i) for i in industries
    ]
    wide = log.groupBy("session_id").agg(*done)
    return wide.unpivot("session_id", list(industries), "industry", "completed")


def final_stats(log: DataFrame, user: str) -> DataFrame:
    given = log.where(is_feedback())
    return given.groupBy(user).agg(
        F.count(F.lit(1)).alias("evaluations"), F.countDistinct("industry").alias("domains"),
        F.avg("confidence").alias("mean_confidence"), F.count_if(F.trim("comment") != "").alias("comments"),
    )


def progress(log: DataFrame, user: str, target: int = 5) -> DataFrame:
    counted = log.where(is_feedback()).groupBy(user, "industry").agg(F.count(F.lit(1)).alias("done"))
    return counted.withColumn("percent", F.least(F.col("done") / target * 100, F.lit(100.0)))


def flatten_map(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """Turns the entries of the given keys into columns; ``map_entries`` is the form for keys not known beforehand."""
    others = [c for c in df.columns if c != column]
    return df.select(*others, *[F.try_element_at(F.col(column), F.lit(k)).alias(k) for k in keys])


def map_entries(df: DataFrame, column: str) -> DataFrame:
    """Map entries as rows: the other columns, ``key`` and ``value``."""
    return df.select(*[c for c in df.columns if c != column], F.explode(column).alias("key", "value"))
