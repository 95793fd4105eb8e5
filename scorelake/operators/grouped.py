"""Grouped business aggregates: shares, crosstabs, bands, top lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.operators.ordering import exact_quantiles
from scorelake.session import kept


def present(df: DataFrame, *columns: str) -> DataFrame:
    """Group keys that are missing are dropped, not kept as a null group."""
    for c in columns:
        df = df.where(F.col(c).isNotNull())
    return df


def share_of_total(df: DataFrame, measure: str, name: str, digits: int | None = None) -> DataFrame:
    """Percent of the grand total of an aggregated measure; the total is a scalar
    subquery, so the rows never meet in one task."""
    df = kept(df)
    total = df.agg(F.sum(measure).alias("total"))
    share = F.col(measure) / total.scalar() * 100
    return df.withColumn(name, share if digits is None else F.round(share, digits))


def band(column: str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins; values outside every bin are null."""
    chain = None
    for low, high, label in zip(edges, edges[1:], labels):
        inside = (F.col(column) > low) & (F.col(column) <= high)
        chain = F.when(inside, label) if chain is None else chain.when(inside, label)
    return chain


def totals_by(df: DataFrame, key: str, amount: str) -> DataFrame:
    return (
        present(df, key)
        .groupBy(key)
        .agg(
            F.round(F.sum(amount), 2).alias("total_sales"),
            F.count(amount).alias("transaction_count"),
            F.round(F.avg(amount), 2).alias("avg_per_transaction"),
        )
    )


def category_breakdown(df: DataFrame, key: str, amount: str, top: int = 3) -> DataFrame:
    """Sales per category with its share and the joint share of the leading ``top``."""
    shared = share_of_total(totals_by(df, key, amount), "total_sales", "market_share", 1)
    leading = shared.orderBy(F.desc("total_sales"), key).limit(top)
    joint = leading.agg(F.round(F.sum("market_share"), 1).alias("concentration"))
    return shared.withColumn("concentration", joint.scalar())


def spread_by(
    df: DataFrame, key: str, amount: str, extra_means: Mapping[str, str] | None = None
) -> DataFrame:
    """Mean, exact median, sample deviation, count and sum per group; the means come from the median's first read."""
    rows = present(df, key)
    also = [
        F.round(F.avg(amount), 2).alias("mean_spend"), F.round(F.stddev_samp(amount), 2).alias("std_spend"),
        F.count(amount).alias("customer_count"), F.round(F.sum(amount), 2).alias("total_revenue"),
        *[F.round(F.avg(c), 2).alias(n) for n, c in (extra_means or {}).items()]]
    found = exact_quantiles(rows, amount, {"median_spend": 0.5}, [key], also)
    return found.withColumn("median_spend", F.round("median_spend", 3))


def crosstab_share(df: DataFrame, row: str, column: str) -> DataFrame:
    """Percent of each column value within a row value; absent cells are zero.

    The result is the whole grid of row and column values, in long form.
    """
    counts = kept(present(df, row, column).groupBy(row, column).agg(F.count(F.lit(1)).alias("n")))
    keys = counts.agg(F.sort_array(F.collect_set(column)).alias("keys"))
    sums = counts.groupBy(row).agg(F.sum("n").alias("row_total"))
    dense = sums.withColumn(column, F.explode(keys.scalar()))
    filled = dense.join(counts, [row, column], "left")
    n = F.coalesce("n", F.lit(0))
    return filled.select(row, column, n.alias("n"), (n / F.col("row_total") * 100).alias("pct"))


def extremes(df: DataFrame, key: str, measure: str) -> DataFrame:
    """One row: the keys with the largest and the smallest measure, ties to the first key."""
    return df.agg(
        F.min(F.struct(-F.col(measure), F.col(key)))[key].alias("highest"),
        F.min(F.struct(F.col(measure), F.col(key)))[key].alias("lowest"),
    )


def variation_by_column(crosstab: DataFrame, column: str) -> DataFrame:
    """Sample deviation of each column's row shares (zero cells count)."""
    return kept(crosstab.groupBy(column).agg(F.stddev_samp("pct").alias("share_std")))


def value_counts(df: DataFrame, *keys: str) -> DataFrame:
    return present(df, *keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def above_own_quantile(df: DataFrame, value: str, p: float) -> DataFrame:
    """Rows strictly above the table's own exact quantile."""
    cut = exact_quantiles(df, value, {"cut": p})
    return df.where(F.col(value) > cut.scalar())


def uplift_percent(high: Column, low: Column) -> Column:
    return (high - low) / low * 100
