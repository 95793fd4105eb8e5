"""Retail answers over order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.operators import grouped as G
from scorelake.operators.ordering import exact_quantiles
from scorelake.plans.registry import query
from scorelake.plans.views import SALES_SQL, sales
from scorelake.session import kept

AGE_EDGES = (0, 12, 25, 38, 50)
AGE_LABELS = ("1-12", "13-25", "26-38", "39-50")
AGE_SQL = """CASE WHEN age > 0 AND age <= 12 THEN '1-12' WHEN age > 12 AND age <= 25 THEN '13-25'
    WHEN age > 25 AND age <= 38 THEN '26-38' WHEN age > 38 AND age <= 50 THEN '39-50' END"""


def banded(spark, d):
    return sales(spark, d, "age", "amount").withColumn("age_band", G.band("age", AGE_EDGES, AGE_LABELS))


@query("category_sales", f"""WITH {SALES_SQL}, g AS (
    SELECT category, round(sum(amount), 2) AS total_sales, count(amount) AS transaction_count,
    round(avg(amount), 2) AS avg_per_transaction FROM sales WHERE category IS NOT NULL GROUP BY 1),
    s AS (SELECT *, round(total_sales / (SELECT sum(total_sales) FROM g) * 100, 1) AS market_share FROM g)
    SELECT *, (SELECT round(sum(market_share), 1) FROM
        (SELECT market_share FROM s ORDER BY total_sales DESC, category LIMIT 3)) AS concentration FROM s""")
def category_sales(spark, d):
    return G.category_breakdown(sales(spark, d, "category", "amount"), "category", "amount")


@query("age_band_spend", f"""WITH {SALES_SQL}, b AS (SELECT *, {AGE_SQL} AS age_band FROM sales)
    SELECT age_band, round(avg(amount), 2) AS mean_spend, round(stddev_samp(amount), 2) AS std_spend,
    count(amount) AS customer_count, round(sum(amount), 2) AS total_revenue,
    round(quantile_cont(amount, 0.5), 3) AS median_spend FROM b WHERE age_band IS NOT NULL GROUP BY 1""")
def age_band_spend(spark, d):
    return G.spread_by(banded(spark, d), "age_band", "amount")


@query("age_band_lead", f"""WITH {SALES_SQL}, g AS (SELECT {AGE_SQL} AS age_band, avg(amount) AS m
    FROM sales GROUP BY 1 HAVING age_band IS NOT NULL)
    SELECT max_by(age_band, m) AS top_band, min_by(age_band, m) AS low_band,
    round((max(m) - min(m)) / min(m) * 100, 3) AS lead_pct FROM g""")
def age_band_lead(spark, d):
    means = G.present(banded(spark, d), "age_band").groupBy("age_band").agg(F.avg("amount").alias("m"))
    return means.agg(
        F.max_by("age_band", "m").alias("top_band"), F.min_by("age_band", "m").alias("low_band"),
        F.round(G.uplift_percent(F.max("m"), F.min("m")), 3).alias("lead_pct"),
    )


@query("season_category", f"""WITH {SALES_SQL} SELECT season, category, count(amount) AS transaction_count,
    round(sum(amount), 2) AS total_revenue, round(avg(amount), 2) AS avg_transaction FROM sales
    WHERE season IS NOT NULL AND category IS NOT NULL GROUP BY 1, 2""")
def season_category(spark, d):
    rows = G.present(sales(spark, d, "season", "category", "amount"), "season", "category")
    return rows.groupBy("season", "category").agg(
        F.count("amount").alias("transaction_count"), F.round(F.sum("amount"), 2).alias("total_revenue"),
        F.round(F.avg("amount"), 2).alias("avg_transaction"),
    )


SEASON_SQL = f"""{SALES_SQL}, season_totals AS (SELECT season, count(amount) AS total_transactions,
    round(sum(amount), 2) AS total_revenue, round(avg(amount), 2) AS avg_spend,
    round(avg(rating), 2) AS avg_rating, round(avg(age), 2) AS avg_customer_age
    FROM sales WHERE season IS NOT NULL GROUP BY 1)"""


def season_totals_frame(spark, d):
    rows = G.present(sales(spark, d, "season", "amount", "rating", "age"), "season")
    return rows.groupBy("season").agg(
        F.count("amount").alias("total_transactions"), F.round(F.sum("amount"), 2).alias("total_revenue"),
        F.round(F.avg("amount"), 2).alias("avg_spend"), F.round(F.avg("rating"), 2).alias("avg_rating"),
        F.round(F.avg("age"), 2).alias("avg_customer_age"),
    )


@query("season_totals", f"""WITH {SEASON_SQL} SELECT *, round(total_revenue /
    (SELECT sum(total_revenue) FROM season_totals) * 100, 4) AS market_share_percent FROM season_totals""")
def season_totals(spark, d):
    return G.share_of_total(season_totals_frame(spark, d), "total_revenue", "market_share_percent", 4)


def crosstab_sql(row: str, column: str) -> str:
    return f"""ct AS (SELECT r.{row}, c.{column}, coalesce(n.n, 0) AS n,
        coalesce(n.n, 0) / t.t * 100 AS pct
        FROM (SELECT DISTINCT {row} FROM sales WHERE {row} IS NOT NULL AND {column} IS NOT NULL) r
        CROSS JOIN (SELECT DISTINCT {column} FROM sales WHERE {row} IS NOT NULL AND {column} IS NOT NULL) c
        LEFT JOIN (SELECT {row}, {column}, count(*) AS n FROM sales GROUP BY 1, 2) n
            ON n.{row} = r.{row} AND n.{column} = c.{column}
        JOIN (SELECT {row}, count(*) AS t FROM sales WHERE {column} IS NOT NULL GROUP BY 1) t ON t.{row} = r.{row})"""


def register_crosstab(name: str, row: str, column: str) -> None:
    @query(name, f"""WITH {SALES_SQL}, {crosstab_sql(row, column)}
        SELECT {row}, {column}, n, round(pct, 4) AS pct FROM ct""")
    def run(spark, d):
        table = G.crosstab_share(sales(spark, d, row, column), row, column)
        return table.withColumn("pct", F.round("pct", 4))


register_crosstab("crosstab_season_category", "season", "category")
register_crosstab("crosstab_segment_category", "segment", "category")
register_crosstab("crosstab_segment_payment", "segment", "payment")


@query("seasonal_variation", f"""WITH {SALES_SQL}, {crosstab_sql("season", "category")}
    SELECT category, round(stddev_samp(pct), 4) AS share_std,
    first_value(category) OVER (ORDER BY stddev_samp(pct) DESC, category) AS most_seasonal,
    first_value(category) OVER (ORDER BY stddev_samp(pct), category) AS least_seasonal
    FROM ct GROUP BY category""")
def seasonal_variation(spark, d):
    table = G.crosstab_share(sales(spark, d, "season", "category"), "season", "category")
    spread = G.variation_by_column(table, "category")
    ends = G.extremes(spread, "category", "share_std")
    return spread.select(
        "category", F.round("share_std", 4).alias("share_std"),
        ends.select("highest").scalar().alias("most_seasonal"),
        ends.select("lowest").scalar().alias("least_seasonal"),
    )


@query("season_extremes", f"""WITH {SEASON_SQL} SELECT max_by(season, total_revenue) AS peak_season,
    min_by(season, total_revenue) AS low_season,
    round((max(total_revenue) - min(total_revenue)) / min(total_revenue) * 100, 4) AS revenue_variation,
    round(max(total_revenue) / min(total_revenue), 4) AS peak_to_low_ratio,
    round(stddev_samp(total_revenue) / avg(total_revenue) * 100, 4) AS revenue_cv FROM season_totals""")
def season_extremes(spark, d):
    t = F.col("total_revenue")
    return season_totals_frame(spark, d).agg(
        F.max_by("season", t).alias("peak_season"), F.min_by("season", t).alias("low_season"),
        F.round(G.uplift_percent(F.max(t), F.min(t)), 4).alias("revenue_variation"),
        F.round(F.max(t) / F.min(t), 4).alias("peak_to_low_ratio"),
        F.round(F.stddev_samp(t) / F.avg(t) * 100, 4).alias("revenue_cv"),
    )


@query("value_counts_members", f"""WITH {SALES_SQL} SELECT payment, count(*) AS n,
    (SELECT round(avg(CASE WHEN member THEN 1.0 ELSE 0.0 END) * 100, 4) FROM sales) AS member_pct
    FROM sales WHERE member AND payment IS NOT NULL GROUP BY 1""")
def value_counts_members(spark, d):
    rows = sales(spark, d, "member", "payment")
    loyal = F.when(F.col("member"), 1.0).otherwise(0.0)
    percent = rows.agg(F.round(F.avg(loyal) * 100, 4))
    return G.value_counts(rows.where("member"), "payment").withColumn("member_pct", percent.scalar())


@query("group_profile", f"""WITH {SALES_SQL}, g AS (SELECT segment, round(avg(amount), 2) AS mean_spend,
    round(stddev_samp(amount), 2) AS std_spend, count(amount) AS customer_count,
    round(sum(amount), 2) AS total_revenue, round(avg(previous), 2) AS avg_previous,
    round(avg(rating), 2) AS avg_rating, round(avg(age), 2) AS avg_age,
    round(quantile_cont(amount, 0.5), 3) AS median_spend FROM sales WHERE segment IS NOT NULL GROUP BY 1)
    SELECT *, round(customer_count / (SELECT sum(customer_count) FROM g) * 100, 4) AS customer_share,
    round(total_revenue / (SELECT sum(total_revenue) FROM g) * 100, 4) AS revenue_share FROM g""")
def group_profile(spark, d):
    rows = sales(spark, d, "segment", "amount", "previous", "rating", "age")
    profile = G.spread_by(rows, "segment", "amount",
                          {"avg_previous": "previous", "avg_rating": "rating", "avg_age": "age"})
    profile = G.share_of_total(profile, "customer_count", "customer_share", 4)
    return G.share_of_total(profile, "total_revenue", "revenue_share", 4)


@query("location_rating_top", f"""WITH {SALES_SQL} SELECT location, round(avg(rating), 6) AS avg_rating
    FROM sales WHERE location IS NOT NULL GROUP BY 1 ORDER BY avg_rating DESC, location LIMIT 10""")
def location_rating_top(spark, d):
    rows = G.present(sales(spark, d, "location", "rating"), "location")
    means = rows.groupBy("location").agg(F.round(F.avg("rating"), 6).alias("avg_rating"))
    return G.top_n(means, 10, F.desc("avg_rating"), F.asc("location"))


@query("conditional_means", f"""WITH {SALES_SQL}, m AS (SELECT
    avg(amount) FILTER (discounted) AS dy, avg(amount) FILTER (NOT discounted) AS dn,
    avg(amount) FILTER (promo) AS py, avg(amount) FILTER (NOT promo) AS pn FROM sales)
    SELECT round(dy, 4) AS discount_avg, round(dn, 4) AS no_discount_avg, round(py, 4) AS promo_avg,
    round(pn, 4) AS no_promo_avg, round((dy - dn) / dn * 100, 4) AS discount_uplift FROM m""")
def conditional_means(spark, d):
    rows = sales(spark, d, "amount", "discounted", "promo")

    def mean_if(condition):
        return F.avg(F.when(condition, F.col("amount")))

    m = rows.agg(
        mean_if(F.col("discounted")).alias("dy"), mean_if(~F.col("discounted")).alias("dn"),
        mean_if(F.col("promo")).alias("py"), mean_if(~F.col("promo")).alias("pn"),
    )
    return m.select(
        F.round("dy", 4).alias("discount_avg"), F.round("dn", 4).alias("no_discount_avg"),
        F.round("py", 4).alias("promo_avg"), F.round("pn", 4).alias("no_promo_avg"),
        F.round(G.uplift_percent(F.col("dy"), F.col("dn")), 4).alias("discount_uplift"),
    )


@query("freq_by_group", f"""WITH {SALES_SQL}, c AS (SELECT member, shipping, count(*) AS n FROM sales
    WHERE member IS NOT NULL AND shipping IS NOT NULL GROUP BY 1, 2)
    SELECT *, row_number() OVER (PARTITION BY member ORDER BY n DESC, shipping) = 1 AS is_top FROM c""")
def freq_by_group(spark, d):
    counts = kept(G.value_counts(sales(spark, d, "member", "shipping"), "member", "shipping"))
    top = counts.groupBy("member").agg(F.min(F.struct(-F.col("n"), F.col("shipping"))).shipping.alias("_top"))
    return counts.join(top, "member").select(
        "member", "shipping", "n", (F.col("shipping") == F.col("_top")).alias("is_top")
    )


@query("high_value_shipping", f"""WITH {SALES_SQL}, q AS (SELECT quantile_cont(amount, 0.75) AS cut FROM sales)
    SELECT shipping, count(*) AS n, round(any_value(cut), 3) AS threshold FROM sales, q
    WHERE amount > cut AND shipping IS NOT NULL GROUP BY 1""")
def high_value_shipping(spark, d):
    rows = sales(spark, d, "shipping", "amount")
    cut = exact_quantiles(rows, "amount", {"cut": 0.75})
    counts = G.value_counts(rows.where(F.col("amount") > cut.scalar()), "shipping")
    return counts.withColumn("threshold", F.round(cut.scalar(), 3))


@query("repeat_pattern", f"""WITH {SALES_SQL}, g AS (SELECT previous, count(amount) AS n,
    round(avg(amount), 4) AS avg_amount FROM sales WHERE previous > 0 GROUP BY 1)
    SELECT *, (SELECT previous FROM g ORDER BY n DESC, previous LIMIT 1) AS modal_previous,
    (SELECT round(count(*) FILTER (previous > 0) / count(*) * 100, 4) FROM sales) AS repeat_pct FROM g""")
def repeat_pattern(spark, d):
    rows = sales(spark, d, "previous", "amount")
    groups = kept(rows.where("previous > 0").groupBy("previous").agg(
        F.count("amount").alias("n"), F.round(F.avg("amount"), 4).alias("avg_amount")
    ))
    repeat = rows.agg(F.round(F.count_if(F.col("previous") > 0) / F.count(F.lit(1)) * 100, 4))
    return groups.withColumn(
        "modal_previous", G.extremes(groups, "previous", "n").select("highest").scalar()
    ).withColumn("repeat_pct", repeat.scalar())


@query("top_categories_by_rows", f"""WITH {SALES_SQL} SELECT category, count(*) AS n FROM sales
    WHERE category IS NOT NULL GROUP BY 1 ORDER BY n DESC, category LIMIT 5""")
def top_categories_by_rows(spark, d):
    return G.top_n(G.value_counts(sales(spark, d, "category"), "category"), 5, F.desc("n"), F.asc("category"))


@query("share_of_total", f"""WITH {SALES_SQL}, g AS (SELECT location, sum(amount) AS total FROM sales
    WHERE location IS NOT NULL GROUP BY 1) SELECT location, round(total, 2) AS total,
    round(total / (SELECT sum(total) FROM g) * 100, 4) AS pct FROM g""")
def share_of_total(spark, d):
    sums = G.present(sales(spark, d, "location", "amount"), "location").groupBy("location").agg(
        F.sum("amount").alias("total"))
    return G.share_of_total(sums, "total", "pct", 4).withColumn("total", F.round("total", 2))


@query("answer_sentences", f"""WITH {SEASON_SQL} SELECT season, season || ': $' ||
    format('{{:,.0f}}', total_revenue) || ' revenue (' || format('{{:,}}', total_transactions) ||
    ' transactions, average $' || format('{{:.2f}}', avg_spend) || ')' AS answer FROM season_totals""")
def answer_sentences(spark, d):
    return season_totals_frame(spark, d).select(
        "season",
        F.concat(
            F.col("season"), F.lit(": $"), F.format_number("total_revenue", 0), F.lit(" revenue ("),
            F.format_number("total_transactions", 0), F.lit(" transactions, average $"),
            F.format_string("%.2f", "avg_spend"), F.lit(")"),
        ).alias("answer"),
    )
