"""The given tables seen as sales rows, price bars, evaluation logs and event logs.

Each view exists twice: as a DataFrame and as SQL text for the check.  A view joins
only the tables its requested columns need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SALES = {
    # column: (expression, tables needed besides lineitem)
    "order_key": ("l_orderkey", ()),
    "line_number": ("l_linenumber", ()),
    "amount": ("l_extendedprice", ()),
    "rating": ("l_quantity", ()),
    "segment": ("l_linestatus", ()),
    "shipping": ("l_returnflag", ()),
    "discounted": ("l_discount > 0.05", ()),
    "previous": ("CAST(l_linenumber - 1 AS BIGINT)", ()),
    "category": ("p_type", ("part",)),
    "age": ("p_size", ("part",)),
    "promo": ("p_type = 'PROMO'", ("part",)),
    "season": ("concat('Q', quarter(o_orderdate))", ("orders",)),
    "payment": ("o_orderpriority", ("orders",)),
    "member": ("o_orderstatus = 'F'", ("orders",)),
    "location": ("n_name", ("orders", "customer", "nation")),
}


def sales(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Retail transactions, one per order line; unmatched attributes are null."""
    needed = {t for c in columns for t in _SALES[c][1]}
    rows = table(spark, sf_dir, "lineitem")
    if "part" in needed:
        part = table(spark, sf_dir, "part")
        rows = rows.join(part, rows.l_partkey == part.p_partkey, "left")
    if "orders" in needed:
        orders = table(spark, sf_dir, "orders")
        if "customer" in needed:
            customer = table(spark, sf_dir, "customer")
            nation = table(spark, sf_dir, "nation")
            place = customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left")
            orders = orders.join(place, orders.o_custkey == place.c_custkey, "left")
        rows = rows.join(orders, rows.l_orderkey == orders.o_orderkey, "left")
    return rows.select(*[F.expr(_SALES[c][0]).alias(c) for c in columns])


SALES_SQL = (
    "sales AS (SELECT "
    + ", ".join(f"{e} AS {c}" for c, (e, _) in _SALES.items())
    + """ FROM lineitem
    LEFT JOIN part ON l_partkey = p_partkey
    LEFT JOIN orders ON l_orderkey = o_orderkey
    LEFT JOIN customer ON o_custkey = c_custkey
    LEFT JOIN nation ON c_nationkey = n_nationkey)"""
)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of order prices, one series per order priority."""
    orders = table(spark, sf_dir, "orders")
    return (
        orders.withColumn("date", F.to_date("o_orderdate"))
        .groupBy(F.col("o_orderpriority").alias("symbol"), "date")
        .agg(
            F.min_by("o_totalprice", "o_orderkey").alias("open"),
            F.max("o_totalprice").alias("high"),
            F.min("o_totalprice").alias("low"),
            F.max_by("o_totalprice", "o_orderkey").alias("close"),
            F.count(F.lit(1)).alias("volume"),
        )
    )


BARS_SQL = """bars AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date,
    min_by(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
    min(o_totalprice) AS low, max_by(o_totalprice, o_orderkey) AS close, count(*) AS volume
    FROM orders GROUP BY 1, 2)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score table: one score per event, the event type standing for the provider."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("provider"),
        F.col("value").alias("score"), "user_id", "ts",
    )


SCORES_SQL = (
    "scores AS (SELECT event_id AS id, event_type AS provider, value AS score, user_id, ts FROM events)"
)


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health-check rows; error texts cover every keyword family."""
    events = table(spark, sf_dir, "events")
    kind = F.get_json_object("props", "$.k").cast("int") % 5
    failed = F.col("event_type") == "error"
    message = (
        F.when(kind == 0, F.lit("HTTP 429: Too Many Requests"))
        .when(kind == 1, F.lit("Service Unavailable (503)"))
        .when(kind == 2, F.lit("Model decommissioned"))
        .when(kind == 3, F.lit("Usage limit exceeded"))
        .otherwise(F.lit("Connection reset"))
    )
    return events.select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("provider_"), F.col("user_id") % 4).alias("provider"),
        F.concat(F.lit("model_"), F.col("user_id") % 12).alias("model"),
        F.when(failed, "error").otherwise("ok").alias("status"),
        F.col("value").alias("latency"),
        F.when(~failed, F.get_json_object("props", "$.k").cast("long")).alias("tokens_used"),
        F.when(failed, message).alias("error"),
    )


HEALTH_SQL = """health AS (SELECT event_id AS id, ts,
    'provider_' || (user_id % 4) AS provider, 'model_' || (user_id % 12) AS model,
    CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, value AS latency,
    CASE WHEN event_type <> 'error' THEN CAST(props->>'k' AS BIGINT) END AS tokens_used,
    CASE WHEN event_type = 'error' THEN CASE CAST(props->>'k' AS INT) % 5
        WHEN 0 THEN 'HTTP 429: Too Many Requests' WHEN 1 THEN 'Service Unavailable (503)'
        WHEN 2 THEN 'Model decommissioned' WHEN 3 THEN 'Usage limit exceeded'
        ELSE 'Connection reset' END END AS error
    FROM events)"""


def eval_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as responses, the turn before as query, a benchmark item as truth.

    Turns are dense, so the turn before is an equi-join on (conv_id, turn) that spreads
    even one dominant conversation over all tasks; a window would not.
    """
    turns = table(spark, sf_dir, "conversations")
    asked = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("query"))
    truth = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("question_id"), F.col("text").alias("truth")
    )
    items = table(spark, sf_dir, "benchmark").agg(F.max("item_id") + 1)
    answered = (
        turns.where(F.col("role") == "assistant")
        .join(asked, ["conv_id", "turn"])
        .select(
            F.concat_ws("_", "conv_id", "turn").alias("id"),
            (F.col("conv_id") % items.scalar()).alias("question_id"),
            F.concat(F.lit("provider_"), F.col("conv_id") % 3).alias("provider"),
            F.concat(F.lit("model_"), F.col("conv_id") % 6).alias("model"),
            "query",
            F.col("text").alias("response"),
            (F.length("text") * 2.5 + F.col("turn") * 100 + 50).alias("response_time_ms"),
            F.ceil(F.length("text") / 4).alias("tokens_used"),
        )
    )
    return answered.join(truth, "question_id", "left")


EVAL_SQL = """eval_log AS (SELECT a.conv_id || '_' || a.turn AS id, a.conv_id % (SELECT max(item_id) + 1 FROM benchmark) AS question_id,
    'provider_' || (a.conv_id % 3) AS provider, 'model_' || (a.conv_id % 6) AS model,
    q.text AS query, a.text AS response,
    CAST(length(a.text) * 2.5 + a.turn * 100 + 50 AS DOUBLE) AS response_time_ms,
    CAST(ceil(length(a.text) / 4) AS BIGINT) AS tokens_used, b.text AS truth
    FROM conversations a JOIN conversations q ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
    LEFT JOIN benchmark b ON b.item_id = a.conv_id % (SELECT max(item_id) + 1 FROM benchmark)
    WHERE a.role = 'assistant')"""
