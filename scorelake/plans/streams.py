"""Request limits, timelines, sessions and alerts, as batch queries and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.operators.windows import consecutive_runs, sessions, trailing_count
from scorelake.plans.registry import query
from scorelake.plans.views import HEALTH_SQL, health, table
from scorelake.session import kept, scratch_path
from scorelake.streaming import flows as S
from scorelake.streaming import gate as L

STAMP = "yyyy-MM-dd HH:mm:ss"
#: Rows of a file that a stream is fed with, about.
FILE_ROWS = 1 << 20
# sparse request data, so limits are low enough for refusals to occur
CHECKS = [L.Check("queries_per_minute", 1), L.Check("queries_per_hour", 2)]


HOUR_US = 3600 * 1_000_000
ORDERED_SQL = """o AS (SELECT event_id, user_id, epoch_us(ts) AS t,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"""
# one request an hour: the state is the last admitted time and the time of the block
SINGLE_SQL = f"""{ORDERED_SQL}, s AS (SELECT event_id, user_id, t, rn, NULL::BIGINT AS blocked, t AS held, 'admitted' AS reason FROM o WHERE rn = 1
    UNION ALL SELECT o.event_id, o.user_id, o.t, o.rn,
    CASE WHEN o.t - blocked < {HOUR_US} THEN blocked WHEN held >= o.t - {HOUR_US} THEN o.t END,
    CASE WHEN o.t - blocked < {HOUR_US} OR held >= o.t - {HOUR_US} THEN held ELSE o.t END,
    CASE WHEN o.t - blocked < {HOUR_US} THEN 'blocked' WHEN held >= o.t - {HOUR_US} THEN 'limit' ELSE 'admitted' END
    FROM s JOIN o ON o.user_id = s.user_id AND o.rn = s.rn + 1)"""
# one a minute and two an hour: last minute slot m, last two hour slots h1 and h2
DOUBLE_SQL = f"""{ORDERED_SQL}, s AS (SELECT event_id, user_id, t, rn, NULL::BIGINT AS blocked, t AS m, t AS h1, NULL::BIGINT AS h2, 'admitted' AS reason
    FROM o WHERE rn = 1 UNION ALL SELECT event_id, user_id, t, rn,
    CASE verdict WHEN 'blocked' THEN blocked WHEN 'admitted' THEN NULL ELSE t END,
    CASE WHEN verdict IN ('admitted', 'hour') THEN t ELSE m END, CASE verdict WHEN 'admitted' THEN t ELSE h1 END,
    CASE verdict WHEN 'admitted' THEN h1 ELSE h2 END, CASE WHEN verdict IN ('minute', 'hour') THEN 'limit' ELSE verdict END
    FROM (SELECT o.*, blocked, m, h1, h2, CASE WHEN o.t - blocked < {HOUR_US} THEN 'blocked' WHEN m >= o.t - 60000000 THEN 'minute'
        WHEN h2 >= o.t - {HOUR_US} THEN 'hour' ELSE 'admitted' END AS verdict
        FROM s JOIN o ON o.user_id = s.user_id AND o.rn = s.rn + 1))"""
DECIDED = "SELECT event_id, user_id, reason = 'admitted' AS allowed, reason FROM s"


def stamp(c):
    return F.date_format(c, STAMP)


def requests(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))


@query("rate_limit", f"WITH RECURSIVE {SINGLE_SQL} {DECIDED}")
def rate_limit(spark, d):
    out = L.rate_limit(requests(spark, d), "user_id", "ts", "event_id", [L.Check("queries_per_hour", 1)])
    return out.select("event_id", "user_id", "allowed", "reason")


@query("provider_rate_limit", f"WITH RECURSIVE {DOUBLE_SQL} {DECIDED}")
def provider_rate_limit(spark, d):
    out = L.rate_limit(requests(spark, d), "user_id", "ts", "event_id", CHECKS)
    return out.select("event_id", "user_id", "allowed", "reason")


@query("limiter_stats", f"""WITH RECURSIVE {SINGLE_SQL} SELECT count(DISTINCT user_id) AS identifiers,
    count(DISTINCT user_id) AS actions, count(DISTINCT user_id) FILTER (reason <> 'admitted') AS blocked_identifiers FROM s""")
def limiter_stats(spark, d):
    return L.limiter_stats(L.rate_limit(requests(spark, d), "user_id", "ts", "event_id", [L.Check("queries_per_hour", 1)]), "user_id")


@query("remaining_calls", """SELECT event_id, user_id,
    greatest(0, 60 - count(*) OVER m) AS remaining_requests_per_minute, greatest(0, 2 - count(*) OVER h) AS remaining_requests_per_hour,
    strftime(min(ts) OVER m + INTERVAL 1 MINUTE, '%Y-%m-%d %H:%M:%S') AS reset_minute,
    strftime(min(ts) OVER h + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS reset_hour FROM events
    WINDOW m AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 MINUTE PRECEDING AND CURRENT ROW),
    h AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)""")
def remaining_calls(spark, d):
    checks = [L.Check("requests_per_minute", 60), L.Check("requests_per_hour", 2)]
    out = L.remaining_calls(requests(spark, d), ["user_id"], "ts", checks)
    return out.select(
        "event_id", "user_id", "remaining_requests_per_minute", "remaining_requests_per_hour",
        stamp("reset_requests_per_minute").alias("reset_minute"), stamp("reset_requests_per_hour").alias("reset_hour"))


TIMELINE_SQL = f"""{HEALTH_SQL}, tl AS (SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS bucket, provider, count(*) AS errors
    FROM health WHERE status <> 'ok' GROUP BY 1, 2)"""


@query("error_timeline", f"""WITH {TIMELINE_SQL} SELECT strftime(bucket, '%Y-%m-%d %H:%M:%S') AS bucket, provider, errors FROM tl""")
def error_timeline(spark, d):
    out = S.error_timeline(health(spark, d), "ts", "provider", "status")
    return out.withColumn("bucket", stamp("bucket"))


@query("error_timeline_dense", f"""WITH {TIMELINE_SQL} SELECT strftime(b.bucket, '%Y-%m-%d %H:%M:%S') AS bucket, p.provider,
    coalesce(errors, 0) AS errors FROM (SELECT DISTINCT bucket FROM tl) b CROSS JOIN (SELECT DISTINCT provider FROM tl) p
    LEFT JOIN tl ON tl.bucket = b.bucket AND tl.provider = p.provider""")
def error_timeline_dense(spark, d):
    """The timeline with a zero for every provider that had no error in a bucket."""
    lined = kept(S.error_timeline(health(spark, d), "ts", "provider", "status"))
    names = lined.agg(F.sort_array(F.collect_set("provider")))
    per_bucket = lined.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("provider", "errors"))).alias("m"))
    dense = per_bucket.withColumn("provider", F.explode(names.scalar()))
    return dense.select(stamp("bucket").alias("bucket"), "provider",
                        F.coalesce(F.try_element_at("m", F.col("provider")), F.lit(0)).alias("errors"))


@query("stream_error_timeline", f"""WITH {TIMELINE_SQL} SELECT strftime(bucket, '%Y-%m-%d %H:%M:%S') AS bucket, provider, errors FROM tl
    WHERE bucket + INTERVAL 10 MINUTE <= (SELECT time_bucket(INTERVAL 1 MILLISECOND, max(ts)) FROM events WHERE event_type = 'error') - INTERVAL 10 MINUTE""")
def stream_error_timeline(spark, d):
    """Buckets the watermark has closed, computed as a stream over the event table."""
    stream = S.stream_parquet(spark, f"{d}/events*.parquet")
    lined = S.error_timeline(_stream_health(stream), "ts", "provider", "status")
    return S.drain(lined, "error-timeline").withColumn("bucket", stamp("bucket"))


def _stream_health(events):
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("provider_"), F.col("user_id") % 4).alias("provider"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), F.col("value").alias("latency"),
        "user_id", "event_id")


@query("stream_sessions", """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 6 * 3600 * 1000000::BIGINT THEN 0 ELSE 1 END AS new
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS events FROM s GROUP BY user_id, n
    HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT time_bucket(INTERVAL 1 MILLISECOND, max(ts)) FROM events) - INTERVAL 1 HOUR""")
def stream_sessions(spark, d):
    stream = _stream_health(S.stream_parquet(spark, f"{d}/events*.parquet"))
    out = S.drain(S.session_flow(stream, "ts", "user_id", "6 hours"), "sessions")
    return out.select("user_id", stamp("session_start").alias("session_start"), "events")


@query("stream_rate_limit", f"WITH RECURSIVE {SINGLE_SQL} {DECIDED}")
def stream_rate_limit(spark, d):
    """The earlier half of the time first, then, with the query restarted, the later half in two micro-batches."""
    asked = requests(spark, d)
    low, high, n = asked.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts")), F.count(F.lit(1))).first()
    cuts = [low + (high - low) * k // 4 for k in (2, 3)] if low is not None else [0, 0]
    part = F.when(F.unix_micros("ts") < cuts[0], 0).when(F.unix_micros("ts") < cuts[1], 1).otherwise(2)
    folder, base = scratch_path(spark, "requests"), scratch_path(spark, "limits")
    written = 0
    for rounds in ([0], [1, 2]):
        files = max(1, -(-n // FILE_ROWS))
        for k in rounds:
            asked.where(part == k).repartition(files).write.mode("append").parquet(folder)
            before, written = written, len(spark.read.schema(asked.schema).parquet(folder).inputFiles())
            if k == rounds[0]:  # the part after it fills no more files, so each micro-batch is one whole part
                files = max(1, written - before)
        stream = S.stream_parquet(spark, folder, asked.schema, files_per_trigger=files)
        out = S.drain(L.rate_limit_stream(stream, "user_id", "ts", "event_id", [L.Check("queries_per_hour", 1)]), "limits", base=base)
    return out.select("event_id", "user_id", "allowed", "reason")


@query("session_assembly", """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 6 * 3600 * 1000000::BIGINT THEN 1 ELSE 0 END AS new
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g)
    SELECT user_id, CAST(n AS BIGINT) AS session_number, count(*) AS events, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start,
    strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS session_end, bool_or(event_type = 'signup') AS started,
    bool_or(event_type = 'error') AS completed FROM s GROUP BY 1, 2""")
def session_assembly(spark, d):
    events = table(spark, d, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    out = sessions(events, ["user_id"], "ts", 6 * 3600,
                   F.bool_or(F.col("event_type") == "signup").alias("started"),
                   F.bool_or(F.col("event_type") == "error").alias("completed"))
    return out.withColumn("session_start", stamp("session_start")).withColumn("session_end", stamp("session_end"))


@query("sliding_requests", """WITH w AS (SELECT user_id, unnest(range(6)) AS j, time_bucket(INTERVAL 10 MINUTE, ts) AS b FROM events)
    SELECT strftime(b - j * INTERVAL 10 MINUTE, '%Y-%m-%d %H:%M:%S') AS window_start, user_id, count(*) AS requests FROM w GROUP BY 1, 2""")
def sliding_requests(spark, d):
    out = S.sliding_requests(requests(spark, d), "ts", "user_id")
    return out.select(stamp("window_start").alias("window_start"), "user_id", "requests")


@query("health_rounds", f"""WITH {HEALTH_SQL}, c AS (SELECT CAST(ts AS DATE) AS day, lower(coalesce(error, '')) AS e, error FROM health)
    SELECT day || ' 00:00:00' AS round_start, count(*) AS total, count(*) FILTER (error IS NULL) AS working,
    count(*) FILTER (error IS NOT NULL) AS failed, count(*) FILTER (e LIKE '%429%') AS rate_limited,
    count(*) FILTER (e LIKE '%503%') AS overloaded, count(*) FILTER (e LIKE '%decommissioned%') AS deprecated FROM c GROUP BY 1""")
def health_rounds(spark, d):
    return S.health_rounds(health(spark, d), "ts", "error").withColumn("round_start", stamp("round_start"))


@query("provider_metrics", f"""WITH {HEALTH_SQL} SELECT CAST(ts AS DATE) || ' 00:00:00' AS interval_start, provider, count(*) AS n,
    round(avg(latency), 6) AS mean_latency, min(latency) AS min_latency, max(latency) AS max_latency FROM health GROUP BY 1, 2""")
def provider_metrics(spark, d):
    out = S.provider_metrics(health(spark, d), "ts", "provider", "latency")
    return out.withColumn("interval_start", stamp("interval_start")).withColumn("mean_latency", F.round("mean_latency", 6))


@query("failure_runs", f"""WITH {HEALTH_SQL}, p AS (SELECT provider, id, ts, status, row_number() OVER (PARTITION BY provider ORDER BY ts, id)
    - row_number() OVER (PARTITION BY provider, status ORDER BY ts, id) AS g FROM health)
    SELECT provider, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS run_start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS run_end,
    count(*) AS run_length FROM p WHERE status <> 'ok' GROUP BY provider, g HAVING count(*) >= 3""")
def failure_runs(spark, d):
    runs = consecutive_runs(health(spark, d), ["provider"], "ts", F.col("status") != "ok", ["id"], 3)
    return runs.withColumn("run_start", stamp("run_start")).withColumn("run_end", stamp("run_end"))


@query("usage_alerts", """WITH c AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts
    RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS used FROM events)
    SELECT event_id, user_id, used, round(used / 2, 6) AS usage FROM c WHERE used >= 0.9 * 2""")
def usage_alerts(spark, d):
    counted = trailing_count(requests(spark, d), ["user_id"], "ts", 3600, "used")
    out = S.usage_alerts(counted, "used", 2)
    return out.select("event_id", "user_id", "used", F.round("usage", 6).alias("usage"))


@query("latency_alerts", f"WITH {HEALTH_SQL} SELECT id, provider, latency FROM health WHERE latency > 100")
def latency_alerts(spark, d):
    return S.latency_alerts(health(spark, d), "latency", 100).select("id", "provider", "latency")
