"""Daily price bars: derived columns, returns, extremes, periods.

A series has at most one row per calendar day, so windows run per series over a bounded
number of rows; everything else is a plain grouped aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRADING_DAYS = 252
DAYS_PER_YEAR = 365.25


def with_bar_columns(bars: DataFrame) -> DataFrame:
    change = F.col("close") - F.col("open")
    spread = F.col("high") - F.col("low")
    return bars.withColumns({
        "change": change,
        "change_pct": change / F.col("open") * 100,
        "price_range": spread,
        "volatility": spread / F.col("close") * 100,
        "closed_higher": F.col("close") > F.col("open"),
    })


def pct_change(value: str, lag: int, order: str, by: Sequence[str]) -> Column:
    """Percent change against the row ``lag`` places earlier in date order."""
    earlier = F.lag(value, lag).over(Window.partitionBy(*by).orderBy(order))
    return (F.col(value) / earlier - 1) * 100


def total_return(bars: DataFrame, by: Sequence[str]) -> DataFrame:
    """First and last close, total return, yearly compound growth, annualised volatility."""
    daily = bars.withColumn("daily_return", pct_change("close", 1, "date", by))
    ends = daily.groupBy(*by).agg(
        F.min_by("close", "date").alias("first_close"),
        F.max_by("close", "date").alias("last_close"),
        (F.date_diff(F.max("date"), F.min("date")) / DAYS_PER_YEAR).alias("years"),
        (F.stddev_samp("daily_return") * F.sqrt(F.lit(TRADING_DAYS))).alias("annual_volatility"),
    )
    ratio = F.col("last_close") / F.col("first_close")
    return ends.withColumn("total_return", (ratio - 1) * 100).withColumn(
        "cagr", F.when(F.col("years") > 0, (F.pow(ratio, 1 / F.col("years")) - 1) * 100)
    )


def yearly_returns(bars: DataFrame, by: Sequence[str]) -> DataFrame:
    years = bars.groupBy(*by, F.year("date").alias("year")).agg(
        F.round(F.min_by("close", "date"), 2).alias("year_start"),
        F.round(F.max_by("close", "date"), 2).alias("year_end"),
        F.round(F.max("high"), 2).alias("year_high"),
        F.round(F.min("low"), 2).alias("year_low"),
    )
    growth = (F.col("year_end") - F.col("year_start")) / F.col("year_start") * 100
    return years.withColumn("annual_return", F.round(growth, 1))


def recent_against_earlier(yearly: DataFrame, measure: str, by: Sequence[str], recent: int = 5) -> DataFrame:
    """Mean of the newest yearly values against the mean of all older ones."""
    age = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("year")))
    aged = yearly.withColumn("_age", age)
    both = aged.groupBy(*by).agg(
        F.avg(F.when(F.col("_age") <= recent, F.col(measure))).alias("recent_avg"),
        F.avg(F.when(F.col("_age") > recent, F.col(measure))).alias("earlier_avg"),
    )
    change = (F.col("recent_avg") - F.col("earlier_avg")) / F.col("earlier_avg") * 100
    return both.withColumn("change_pct", change)


def strength_label(r: Column) -> Column:
    return (
        F.when(F.abs(r) > 0.5, "Strong").when(F.abs(r) > 0.3, "Moderate").when(r.isNotNull(), "Weak")
    )


def trend_label(r: Column) -> Column:
    return F.when(r > 0.1, "increasing").when(r < -0.1, "decreasing").otherwise("stable")


def quarter_key(date: str) -> Column:
    return F.concat(F.year(date), F.lit("-Q"), F.quarter(date))
