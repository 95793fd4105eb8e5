"""Price-series answers over daily bars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scorelake.operators import series as S
from scorelake.operators.ordering import exact_quantiles
from scorelake.plans.registry import query
from scorelake.plans.views import BARS_SQL, bars

BY = ["symbol"]
DERIVED_SQL = f"""{BARS_SQL}, b AS (SELECT *, close - open AS change, (close - open) / open * 100 AS change_pct,
    high - low AS price_range, (high - low) / close * 100 AS volatility, close > open AS closed_higher FROM bars)"""


def derived(spark, d):
    return S.with_bar_columns(bars(spark, d))


@query("bar_columns", f"""WITH {DERIVED_SQL} SELECT symbol, CAST(date AS VARCHAR) AS date, round(change, 4) AS change,
    round(change_pct, 4) AS change_pct, round(price_range, 4) AS price_range,
    round(volatility, 4) AS volatility, closed_higher FROM b""")
def bar_columns(spark, d):
    numbers = ["change", "change_pct", "price_range", "volatility"]
    return derived(spark, d).select(
        "symbol", F.col("date").cast("string").alias("date"),
        *[F.round(c, 4).alias(c) for c in numbers], "closed_higher",
    )


@query("volume_stats", f"""WITH {BARS_SQL} SELECT symbol, count(volume) AS n, round(avg(volume), 4) AS mean,
    round(stddev_samp(volume), 4) AS std, CAST(min(volume) AS DOUBLE) AS low, CAST(max(volume) AS DOUBLE) AS high,
    quantile_cont(volume, 0.25) AS q25, quantile_cont(volume, 0.5) AS median, quantile_cont(volume, 0.75) AS q75
    FROM bars GROUP BY 1""")
def volume_stats(spark, d):
    frame = bars(spark, d)
    simple = frame.groupBy(*BY).agg(
        F.count("volume").alias("n"), F.round(F.avg("volume"), 4).alias("mean"),
        F.round(F.stddev_samp("volume"), 4).alias("std"),
        F.min("volume").cast("double").alias("low"), F.max("volume").cast("double").alias("high"),
    )
    return simple.join(exact_quantiles(frame, "volume", {"q25": .25, "median": .5, "q75": .75}, BY), BY)


@query("yearly_volume", f"""WITH {BARS_SQL} SELECT symbol, year(date) AS year, round(avg(volume), 4) AS mean_volume,
    round(stddev_samp(volume), 4) AS std_volume, count(volume) AS days,
    quantile_cont(volume, 0.5) AS median_volume FROM bars GROUP BY 1, 2""", year="INTEGER")
def yearly_volume(spark, d):
    frame = bars(spark, d).withColumn("year", F.year("date"))
    keys = ["symbol", "year"]
    simple = frame.groupBy(*keys).agg(
        F.round(F.avg("volume"), 4).alias("mean_volume"),
        F.round(F.stddev_samp("volume"), 4).alias("std_volume"), F.count("volume").alias("days"),
    )
    return simple.join(exact_quantiles(frame, "volume", {"median_volume": .5}, keys), keys)


@query("recent_vs_history", f"""WITH {BARS_SQL}, y AS (SELECT symbol, year(date) AS year, avg(volume) AS v,
    row_number() OVER (PARTITION BY symbol ORDER BY year(date) DESC) AS age FROM bars GROUP BY 1, 2),
    m AS (SELECT symbol, avg(v) FILTER (age <= 5) AS r, avg(v) FILTER (age > 5) AS e FROM y GROUP BY 1)
    SELECT symbol, round(r, 4) AS recent_avg, round(e, 4) AS earlier_avg,
    round((r - e) / e * 100, 4) AS change_pct FROM m""")
def recent_vs_history(spark, d):
    yearly = bars(spark, d).groupBy("symbol", F.year("date").alias("year")).agg(F.avg("volume").alias("v"))
    out = S.recent_against_earlier(yearly, "v", BY)
    return out.select("symbol", *[F.round(c, 4).alias(c) for c in ("recent_avg", "earlier_avg", "change_pct")])


@query("high_volume_days", f"""WITH {BARS_SQL}, q AS (SELECT symbol, quantile_cont(volume, 0.9) AS threshold
    FROM bars GROUP BY 1) SELECT symbol, round(any_value(threshold), 4) AS threshold,
    count(*) FILTER (volume > threshold) AS high_days,
    round(count(*) FILTER (volume > threshold) / count(*) * 100, 4) AS high_pct
    FROM bars JOIN q USING (symbol) GROUP BY 1""")
def high_volume_days(spark, d):
    frame = bars(spark, d)
    cut = exact_quantiles(frame, "volume", {"threshold": .9}, BY)
    high = F.count_if(F.col("volume") > F.col("threshold"))
    return frame.join(cut, BY).groupBy(*BY).agg(
        F.round(F.max("threshold"), 4).alias("threshold"), high.alias("high_days"),
        F.round(high / F.count(F.lit(1)) * 100, 4).alias("high_pct"),
    )


@query("total_return_cagr", f"""WITH {BARS_SQL}, r AS (SELECT *,
    (close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1) * 100 AS ret FROM bars),
    m AS (SELECT symbol, min_by(close, date) AS f, max_by(close, date) AS l,
    date_diff('day', min(date), max(date)) / 365.25 AS yrs, stddev_samp(ret) * sqrt(252) AS vol FROM r GROUP BY 1)
    SELECT symbol, round(f, 4) AS first_close, round(l, 4) AS last_close, round(yrs, 4) AS years,
    round((l / f - 1) * 100, 4) AS total_return, round((pow(l / f, 1 / yrs) - 1) * 100, 4) AS cagr,
    round(vol, 4) AS annual_volatility FROM m""")
def total_return_cagr(spark, d):
    out = S.total_return(bars(spark, d), BY)
    return out.select("symbol", *[F.round(c, 4).alias(c) for c in out.columns if c != "symbol"])


YEARLY_SQL = f"""{BARS_SQL}, y AS (SELECT symbol, year(date) AS year, round(min_by(close, date), 2) AS year_start,
    round(max_by(close, date), 2) AS year_end, round(max(high), 2) AS year_high, round(min(low), 2) AS year_low
    FROM bars GROUP BY 1, 2), yr AS (SELECT *,
    round((year_end - year_start) / year_start * 100, 1) AS annual_return FROM y)"""


@query("yearly_returns", f"WITH {YEARLY_SQL} SELECT * FROM yr", year="INTEGER")
def yearly_returns(spark, d):
    return S.yearly_returns(bars(spark, d), BY)


@query("positive_years", f"""WITH {YEARLY_SQL} SELECT symbol, count(*) FILTER (annual_return > 0) AS positive_years,
    count(*) AS total_years, round(count(*) FILTER (annual_return > 0) / count(*) * 100, 4) AS positive_rate
    FROM yr GROUP BY 1""")
def positive_years(spark, d):
    good = F.count_if(F.col("annual_return") > 0)
    return S.yearly_returns(bars(spark, d), BY).groupBy(*BY).agg(
        good.alias("positive_years"), F.count(F.lit(1)).alias("total_years"),
        F.round(good / F.count(F.lit(1)) * 100, 4).alias("positive_rate"),
    )


@query("price_extremes", f"""WITH {BARS_SQL} SELECT symbol, max(high) AS all_time_high,
    CAST(max_by(date, high) AS VARCHAR) AS high_date, min(low) AS all_time_low,
    CAST(min_by(date, low) AS VARCHAR) AS low_date, round(max(high) / min(low), 4) AS high_low_ratio
    FROM bars GROUP BY 1""")
def price_extremes(spark, d):
    return bars(spark, d).groupBy(*BY).agg(
        F.max("high").alias("all_time_high"), F.max_by("date", "high").cast("string").alias("high_date"),
        F.min("low").alias("all_time_low"), F.min_by("date", "low").cast("string").alias("low_date"),
        F.round(F.max("high") / F.min("low"), 4).alias("high_low_ratio"),
    )


@query("largest_days", f"""WITH {DERIVED_SQL} SELECT symbol, CAST(max_by(date, change_pct) AS VARCHAR) AS gain_date,
    round(max(change_pct), 4) AS gain_pct, round(max_by(change, change_pct), 4) AS gain_change,
    CAST(min_by(date, change_pct) AS VARCHAR) AS loss_date, round(min(change_pct), 4) AS loss_pct,
    round(min_by(change, change_pct), 4) AS loss_change FROM b GROUP BY 1""")
def largest_days(spark, d):
    gain = F.max(F.struct("change_pct", "date", "change"))
    loss = F.min(F.struct("change_pct", "date", "change"))
    best = derived(spark, d).groupBy(*BY).agg(gain.alias("g"), loss.alias("l"))
    return best.select(
        "symbol", F.col("g.date").cast("string").alias("gain_date"),
        F.round("g.change_pct", 4).alias("gain_pct"), F.round("g.change", 4).alias("gain_change"),
        F.col("l.date").cast("string").alias("loss_date"),
        F.round("l.change_pct", 4).alias("loss_pct"), F.round("l.change", 4).alias("loss_change"),
    )


@query("vol_corr", f"""WITH {DERIVED_SQL}, c AS (SELECT symbol, corr(volume, volatility) AS rv,
    corr(volume, close) AS rc, avg(volatility) AS mv FROM b GROUP BY 1)
    SELECT symbol, round(rv, 6) AS volume_volatility_r, rv > 0.3 AS moves_together,
    round(mv, 4) AS mean_volatility, round(rc, 6) AS volume_close_r,
    CASE WHEN abs(rc) > 0.5 THEN 'Strong' WHEN abs(rc) > 0.3 THEN 'Moderate' ELSE 'Weak' END AS volume_close_strength
    FROM c""")
def vol_corr(spark, d):
    c = derived(spark, d).groupBy(*BY).agg(
        F.corr("volume", "volatility").alias("rv"), F.corr("volume", "close").alias("rc"),
        F.avg("volatility").alias("mv"),
    )
    return c.select(
        "symbol", F.round("rv", 6).alias("volume_volatility_r"), (F.col("rv") > 0.3).alias("moves_together"),
        F.round("mv", 4).alias("mean_volatility"), F.round("rc", 6).alias("volume_close_r"),
        S.strength_label(F.col("rc")).alias("volume_close_strength"),
    )


@query("monthly_diff", f"""WITH {DERIVED_SQL}, m AS (SELECT symbol, strftime(date, '%Y-%m') AS month,
    avg(change) AS v FROM b GROUP BY 1, 2)
    SELECT symbol, month, round(v, 8) AS mean_change,
    max_by(month, v) OVER (PARTITION BY symbol) AS best_month, min_by(month, v) OVER (PARTITION BY symbol) AS worst_month,
    round(avg(v) OVER (PARTITION BY symbol), 4) AS mean_of_months,
    row_number() OVER (PARTITION BY symbol ORDER BY month) <= 12 AS in_first_year FROM m""")
def monthly_diff(spark, d):
    months = derived(spark, d).groupBy("symbol", F.date_format("date", "yyyy-MM").alias("month")).agg(
        F.avg("change").alias("v"))
    whole, ordered = Window.partitionBy("symbol"), Window.partitionBy("symbol").orderBy("month")
    return months.select(
        "symbol", "month", F.round("v", 8).alias("mean_change"),
        F.max_by("month", "v").over(whole).alias("best_month"),
        F.min_by("month", "v").over(whole).alias("worst_month"),
        F.round(F.avg("v").over(whole), 4).alias("mean_of_months"),
        (F.row_number().over(ordered) <= 12).alias("in_first_year"),
    )


@query("growth_periods", f"""WITH {BARS_SQL}, r AS (SELECT *,
    (close / lag(close, 7) OVER w - 1) * 100 AS r7, (close / lag(close, 30) OVER w - 1) * 100 AS r30
    FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date))
    SELECT symbol, count(*) FILTER (r7 > 5) AS growth_periods, round(max(r7), 4) AS max_7_day,
    round(max(r30), 4) AS max_30_day, CAST(max_by(date, r7) AS VARCHAR) AS best_7_day_date FROM r GROUP BY 1""")
def growth_periods(spark, d):
    moved = bars(spark, d).withColumns({
        "r7": S.pct_change("close", 7, "date", BY), "r30": S.pct_change("close", 30, "date", BY)})
    return moved.groupBy(*BY).agg(
        F.count_if(F.col("r7") > 5).alias("growth_periods"), F.round(F.max("r7"), 4).alias("max_7_day"),
        F.round(F.max("r30"), 4).alias("max_30_day"),
        F.max_by("date", "r7").cast("string").alias("best_7_day_date"),
    )


@query("big_moves", f"""WITH {DERIVED_SQL} SELECT symbol, count(*) AS moves,
    round(avg(abs(change_pct)), 4) AS mean_abs_move FROM b WHERE abs(change_pct) > 10 GROUP BY 1""")
def big_moves(spark, d):
    return derived(spark, d).where(F.abs("change_pct") > 10).groupBy(*BY).agg(
        F.count(F.lit(1)).alias("moves"), F.round(F.avg(F.abs("change_pct")), 4).alias("mean_abs_move"))


def register_largest(name, measure, sql_measure):
    @query(name, f"""WITH {DERIVED_SQL} SELECT symbol, CAST(date AS VARCHAR) AS date,
        round(change_pct, 4) AS change_pct FROM b WHERE abs(change_pct) > 10
        ORDER BY {sql_measure} DESC, symbol, b.date LIMIT 5""")
    def run(spark, d):
        big = derived(spark, d).where(F.abs("change_pct") > 10)
        top = big.orderBy(measure(F.col("change_pct")).desc(), "symbol", "date").limit(5)
        return top.select("symbol", F.col("date").cast("string").alias("date"),
                          F.round("change_pct", 4).alias("change_pct"))


register_largest("big_moves_signed_top", lambda c: c, "b.change_pct")
register_largest("big_moves_absolute_top", F.abs, "abs(b.change_pct)")


@query("up_day_share", f"""WITH {DERIVED_SQL} SELECT symbol, year(date) AS year, count(*) AS days,
    count(*) FILTER (closed_higher) AS up_days, round(avg(CASE WHEN closed_higher THEN 1.0 ELSE 0.0 END) * 100, 4) AS up_pct
    FROM b GROUP BY GROUPING SETS ((symbol, year(date)), (symbol))""", year="INTEGER")
def up_day_share(spark, d):
    up = F.when(F.col("closed_higher"), 1.0).otherwise(0.0)
    frame = derived(spark, d).withColumn("year", F.year("date"))
    cube = frame.groupingSets([["symbol", "year"], ["symbol"]], "symbol", "year")
    return cube.agg(
        F.count(F.lit(1)).alias("days"), F.count_if(F.col("closed_higher")).alias("up_days"),
        F.round(F.avg(up) * 100, 4).alias("up_pct"),
    )


@query("quarter_volatility", f"""WITH {DERIVED_SQL}, q AS (SELECT 'quarter' AS period,
    year(date) || '-Q' || quarter(date) AS key, avg(volatility) AS v FROM b GROUP BY 2
    UNION ALL SELECT 'month', strftime(date, '%Y-%m'), avg(volatility) FROM b GROUP BY 2)
    SELECT period, key, round(v, 4) AS mean_volatility FROM q
    QUALIFY row_number() OVER (PARTITION BY period ORDER BY v DESC, key) <= 5""")
def quarter_volatility(spark, d):
    frame = derived(spark, d)

    def top(period, key):
        means = frame.groupBy(key.alias("key")).agg(F.avg("volatility").alias("v"))
        best = means.orderBy(F.desc("v"), "key").limit(5)
        return best.select(F.lit(period).alias("period"), "key", F.round("v", 4).alias("mean_volatility"))

    return top("quarter", S.quarter_key("date")).unionByName(top("month", F.date_format("date", "yyyy-MM")))
