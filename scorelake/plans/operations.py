"""Health-log and request-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.operators import evallog as E
from scorelake.plans.registry import query
from scorelake.plans.statistics import rounded
from scorelake.plans.views import HEALTH_SQL, health, table


def is_ok():
    return F.col("status") == "ok"


CLASS_SQL = """CASE WHEN error IS NULL THEN 'ok'
    WHEN regexp_matches(lower(error), 'rate limit|quota|429|too many requests') THEN 'rate_limited'
    WHEN regexp_matches(lower(error), 'overloaded|503|unavailable') THEN 'overloaded'
    WHEN regexp_matches(lower(error), 'decommissioned|not found|404') THEN 'deprecated' ELSE 'error' END"""


@query("error_class", f"WITH {HEALTH_SQL} SELECT {CLASS_SQL} AS class, count(*) AS n FROM health GROUP BY 1")
def error_class(spark, d):
    return health(spark, d).groupBy(E.error_class("error").alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("error_flags", f"""WITH {HEALTH_SQL}, f AS (SELECT provider, lower(coalesce(error, '')) AS e FROM health)
    SELECT provider, count(*) FILTER (regexp_matches(e, 'rate limit|quota|429|too many requests|exceeded')) AS is_rate_limit,
    count(*) FILTER (regexp_matches(e, 'overloaded|503|unavailable')) AS is_overloaded,
    count(*) FILTER (regexp_matches(e, 'decommissioned|not found|404')) AS is_deprecated FROM f GROUP BY 1""")
def error_flags(spark, d):
    flags = E.error_flags("error")
    return health(spark, d).groupBy("provider").agg(*[F.count_if(c).alias(n) for n, c in flags.items()])


@query("status_pivot", f"""WITH {HEALTH_SQL}, c AS (SELECT provider, model, {CLASS_SQL} AS class FROM health)
    SELECT provider, model, {", ".join(f"count(*) FILTER (class = '{v}') AS {v}" for v in
    ("ok", "rate_limited", "overloaded", "deprecated", "error"))} FROM c GROUP BY 1, 2""")
def status_pivot(spark, d):
    rows = health(spark, d).withColumn("class", E.error_class("error"))
    return E.status_matrix(rows, ["provider", "model"], "class",
                           ["ok", "rate_limited", "overloaded", "deprecated", "error"])


@query("latency_by_model", f"""WITH {HEALTH_SQL} SELECT provider, model, count(*) AS n, round(avg(latency), 6) AS mean_latency,
    max(latency) AS max_latency, min(latency) AS min_latency FROM health WHERE status = 'ok' GROUP BY 1, 2""")
def latency_by_model(spark, d):
    return health(spark, d).where(is_ok()).groupBy("provider", "model").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("latency"), 6).alias("mean_latency"),
        F.max("latency").alias("max_latency"), F.min("latency").alias("min_latency"))


@query("success_rates", f"""WITH {HEALTH_SQL} SELECT coalesce(provider, '(overall)') AS provider, count(*) AS total,
    count(*) FILTER (status = 'ok') AS working, round(count(*) FILTER (status = 'ok') / count(*) * 100, 4) AS rate
    FROM health GROUP BY ROLLUP (provider)""")
def success_rates(spark, d):
    return E.per_group_and_overall(health(spark, d), "provider", [
        F.count(F.lit(1)).alias("total"), F.count_if(is_ok()).alias("working"),
        F.round(F.count_if(is_ok()) / F.count(F.lit(1)) * 100, 4).alias("rate")])


@query("run_summary", f"""WITH {HEALTH_SQL} SELECT coalesce(provider, '(overall)') AS provider, count(*) AS total,
    count(*) FILTER (status = 'ok') AS successful, count(*) FILTER (status <> 'ok') AS failed,
    round(count(*) FILTER (status = 'ok') / count(*) * 100, 4) AS success_rate,
    round(coalesce(avg(latency) FILTER (status = 'ok'), 0), 6) AS avg_latency,
    round(coalesce(avg(tokens_used) FILTER (status = 'ok'), 0), 6) AS avg_tokens,
    CAST(coalesce(sum(tokens_used), 0) AS BIGINT) AS total_tokens FROM health GROUP BY ROLLUP (provider)""")
def run_summary(spark, d):
    out = E.run_summary(health(spark, d), "provider", is_ok(),
                        {"avg_latency": "latency", "avg_tokens": "tokens_used"}, {"total_tokens": "tokens_used"})
    return rounded(out.withColumn("success_rate", F.round("success_rate", 4)), 6, "avg_latency", "avg_tokens")


@query("log_summary", f"""WITH {HEALTH_SQL} SELECT count(*) AS records, count(DISTINCT provider) AS providers,
    count(DISTINCT model) AS models, round(avg(latency) FILTER (status = 'ok'), 6) AS avg_latency,
    round(count(*) FILTER (status <> 'ok') / count(*) * 100, 4) AS error_rate,
    strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day FROM health""")
def log_summary(spark, d):
    return health(spark, d).agg(
        F.count(F.lit(1)).alias("records"), F.countDistinct("provider").alias("providers"),
        F.countDistinct("model").alias("models"), F.round(F.avg(F.when(is_ok(), F.col("latency"))), 6).alias("avg_latency"),
        F.round(F.count_if(~is_ok()) / F.count(F.lit(1)) * 100, 4).alias("error_rate"),
        F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_day"),
        F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_day"))


@query("quick_health", f"""WITH {HEALTH_SQL}, c AS (SELECT *, {CLASS_SQL} AS class FROM health)
    SELECT count(*) FILTER (class = 'ok') AS working, count(*) FILTER (class NOT IN ('ok', 'rate_limited')) AS errors,
    count(*) FILTER (class = 'rate_limited') AS rate_limited, round(avg(latency) FILTER (class = 'ok'), 6) AS mean_latency FROM c""")
def quick_health(spark, d):
    rows = health(spark, d).withColumn("class", E.error_class("error"))
    ok, limited = F.col("class") == "ok", F.col("class") == "rate_limited"
    return rows.agg(
        F.count_if(ok).alias("working"), F.count_if(~ok & ~limited).alias("errors"),
        F.count_if(limited).alias("rate_limited"), F.round(F.avg(F.when(ok, F.col("latency"))), 6).alias("mean_latency"))


@query("report_table", f"""WITH {HEALTH_SQL} SELECT provider, model, count(*) FILTER (status = 'ok') AS successes,
    round(avg(latency) FILTER (status = 'ok'), 4) AS avg_latency, round(avg(tokens_used) FILTER (status = 'ok'), 4) AS avg_tokens,
    round(count(*) FILTER (status = 'ok') / count(*), 6) AS success_rate FROM health GROUP BY 1, 2""")
def report_table(spark, d):
    def mean_ok(c):
        return F.avg(F.when(is_ok(), F.col(c)))

    return health(spark, d).groupBy("provider", "model").agg(
        F.count_if(is_ok()).alias("successes"), F.round(mean_ok("latency"), 4).alias("avg_latency"),
        F.round(mean_ok("tokens_used"), 4).alias("avg_tokens"),
        F.round(F.count_if(is_ok()) / F.count(F.lit(1)), 6).alias("success_rate"))


@query("fastest_models", f"""WITH {HEALTH_SQL} SELECT provider, model, round(avg(latency), 6) AS mean_latency FROM health
    WHERE status = 'ok' GROUP BY 1, 2 ORDER BY avg(latency), provider, model LIMIT 3""")
def fastest_models(spark, d):
    means = health(spark, d).where(is_ok()).groupBy("provider", "model").agg(F.avg("latency").alias("m"))
    return means.orderBy("m", "provider", "model").limit(3).select(
        "provider", "model", F.round("m", 6).alias("mean_latency"))


@query("threshold_gate", """WITH t(metric, threshold) AS (SELECT event_type, avg(value) FROM events GROUP BY 1)
    SELECT event_type AS metric, count(*) AS n, count(*) FILTER (value >= threshold) AS passed
    FROM events JOIN t ON metric = event_type GROUP BY 1""")
def threshold_gate(spark, d):
    """Each metric against its own row of a threshold table (here the mean)."""
    events = table(spark, d, "events").select(F.col("event_type").alias("metric"), "value")
    thresholds = events.groupBy("metric").agg(F.avg("value").alias("threshold"))
    return events.join(thresholds, "metric").groupBy("metric").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") >= F.col("threshold")).alias("passed"))
