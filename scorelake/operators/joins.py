"""Lookups, work plans, enrichment and patching as equi-joins.

No side is force-broadcast: small dimensions fall under the optimizer's own size check,
large ones shuffle, and adaptive execution splits hot keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_truth(responses: DataFrame, truth: DataFrame, key: str, scores: Sequence[str] = ()) -> DataFrame:
    """Left join that keeps rows without truth, with zero scores and an empty query."""
    joined = responses.join(truth.withColumn("_known", F.lit(True)), key, "left")
    known = F.coalesce("_known", F.lit(False))
    out = joined.withColumns({c: F.when(known, F.col(c)).otherwise(0.0) for c in scores})
    return out.withColumn("has_truth", known).drop("_known")


def work_plan(
    questions: DataFrame, models: DataFrame, provider: str = "provider", model: str = "model",
    only_models: DataFrame | None = None,
) -> DataFrame:
    """Every question for every provider, with each provider's (listed) models.

    The provider list is one small array laid beside each question; the models then
    follow by an equi-join on the provider.
    """
    chosen = models if only_models is None else models.join(only_models, model, "left_semi")
    providers = chosen.agg(F.sort_array(F.collect_set(provider)))
    return questions.withColumn(provider, F.explode(providers.scalar())).join(chosen, provider)


def enrich(log: DataFrame, metadata: DataFrame, keys: Sequence[str], tags: str = "tags") -> DataFrame:
    joined = log.join(metadata, list(keys), "left")
    return joined.withColumn(tags, F.coalesce(tags, F.array().cast("array<string>")))


def with_tag(metadata: DataFrame, tag: str, tags: str = "tags") -> DataFrame:
    return metadata.where(F.array_contains(tags, tag))


def remaining_work(assigned: DataFrame, completed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return assigned.join(completed.select(*keys), list(keys), "left_anti")


def can_continue(registered: DataFrame, submitted: DataFrame, email: str = "email") -> DataFrame:
    """Registered e-mails without a submission; letter case does not matter."""
    left = registered.withColumn("_email", F.lower(email))
    right = submitted.select(F.lower(email).alias("_email"))
    return left.join(right, "_email", "left_anti").drop("_email")


def already_submitted(registered: DataFrame, submitted: DataFrame, email: str = "email") -> DataFrame:
    left = registered.withColumn("_email", F.lower(email))
    right = submitted.select(F.lower(email).alias("_email"))
    return left.join(right, "_email", "left_semi").drop("_email")


def retry_plan(failed: DataFrame, status: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Failures whose question still lacks answers; unknown questions are retried."""
    known = status.select(*keys, "needs_retry")
    return failed.join(known, list(keys), "left").where(F.coalesce("needs_retry", F.lit(True))).drop("needs_retry")


def patch(base: DataFrame, recovered: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Replaces the listed columns wherever a recovered row carries a value."""
    fixes = recovered.select(*keys, *[F.col(c).alias(f"_fix_{c}") for c in columns])
    joined = base.join(fixes, list(keys), "left")
    return joined.withColumns(
        {c: F.coalesce(f"_fix_{c}", F.col(c)) for c in columns}
    ).drop(*[f"_fix_{c}" for c in columns])


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """The record with the key; no row when there is none."""
    return df.where(F.col(key) == value)


def lookup_many(ids: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """A row per asked id; unknown ids keep nulls."""
    return ids.join(df, key, "left")


def attach_context(rows: DataFrame, contexts: DataFrame, domain: str = "domain") -> DataFrame:
    """Dataset context and evaluation criteria of each row's domain."""
    return rows.join(contexts.select(domain, "context", "evaluation_criteria"), domain, "left")


def upsert(base: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """New keys are added; for known keys every non-null value of the delta wins."""
    changed = delta.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_d_{c}") for c in delta.columns if c != key])
    joined = base.join(changed, F.col(key) == F.col("_key"), "full_outer")
    columns = [F.coalesce(key, F.col("_key")).alias(key)]
    for c in base.columns:
        if c != key:
            columns.append(F.coalesce(f"_d_{c}", F.col(c)).alias(c) if c in delta.columns else F.col(c))
    return joined.select(*columns)


def delete(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return base.join(keys.select(key), key, "left_anti")


def remove_models(log: DataFrame, removed: DataFrame, model: str = "model") -> DataFrame:
    return log.join(removed.select(model), model, "left_anti")
