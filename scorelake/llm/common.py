"""Small helpers that the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.session import saved, scratch_path, shared_dir, shuffle_width  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def text_key(column: str = "text") -> Column:
    """With doc_id, tells rows apart: rows equal in both are repeats of one row."""
    return F.xxhash64(text_of(column))


def plain(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and text alone, so that no other column can clash with the operator's own."""
    return docs.select("doc_id", text_key().alias("text_key"), text_of().alias("text"))


def keep_rows(docs: DataFrame, keys: DataFrame, one_of_each: bool = False, keep: bool = True) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, text) is among ``keys`` (doc_id, text_key), or is not; all columns kept.

    ``one_of_each``: of rows that repeat both, one stays.  Texts are dealt out once, by both keys,
    and repeats meet in that same exchange.
    """
    names = [_unused(docs, n) for n in ("row_id", "row_without_id", "row_key")]  # a missing doc_id is an id of its own
    wanted = keys.select(*[c.alias(n) for c, n in zip(_identity("text_key"), names)]).distinct()
    here = docs.withColumns(dict(zip(names, _identity(None))))
    kept = here.join(wanted, names, "left_semi" if keep else "left_anti")
    if one_of_each:
        kept = kept.dropDuplicates(names)
    return kept.select(docs.columns)


def _identity(key: str | None) -> list[Column]:
    """What tells rows apart, in columns that are never null: then one exchange serves the join and the repeats."""
    return [F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull(), F.col(key) if key else text_key()]


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name += "_"
    return name

