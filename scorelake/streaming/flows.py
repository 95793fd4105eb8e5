"""Windowed streaming flows over health, feedback and metric logs.

Every flow is a plain DataFrame function, so the same code runs on a table and on a
stream; ``watermark`` only matters for the latter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.operators.evallog import error_class
from scorelake.session import scratch_path


def late_by(df: DataFrame, ts: str, delay: str) -> DataFrame:
    return df.withWatermark(ts, delay) if df.isStreaming else df


def error_timeline(df: DataFrame, ts: str, provider: str, status: str, every: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Failed rows per tumbling bucket and provider."""
    failed = late_by(df, ts, delay).where(F.col(status) != "ok")
    counted = failed.groupBy(F.window(ts, every).alias("w"), provider).agg(F.count(F.lit(1)).alias("errors"))
    return counted.select(F.col("w.start").alias("bucket"), provider, "errors")


def sliding_requests(df: DataFrame, ts: str, key: str, length: str = "1 hour", step: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    counted = late_by(df, ts, delay).groupBy(F.window(ts, length, step).alias("w"), key).agg(
        F.count(F.lit(1)).alias("requests"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "requests")


def health_rounds(df: DataFrame, ts: str, error: str, every: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Rows of every error class and the ok and failed totals per check round."""
    classed = late_by(df, ts, delay).withColumn("_class", error_class(error))
    ok = F.col("_class") == "ok"
    counted = classed.groupBy(F.window(ts, every).alias("w")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("working"), F.count_if(~ok).alias("failed"),
        F.count_if(F.col("_class") == "rate_limited").alias("rate_limited"),
        F.count_if(F.col("_class") == "overloaded").alias("overloaded"),
        F.count_if(F.col("_class") == "deprecated").alias("deprecated"),
    )
    return counted.select(F.col("w.start").alias("round_start"), *[c for c in counted.columns if c != "w"])


def provider_metrics(df: DataFrame, ts: str, provider: str, latency: str, every: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Latency figures per provider and interval; appended interval by interval."""
    counted = late_by(df, ts, delay).groupBy(F.window(ts, every).alias("w"), provider).agg(
        F.count(F.lit(1)).alias("n"), F.avg(latency).alias("mean_latency"), F.min(latency).alias("min_latency"),
        F.max(latency).alias("max_latency"))
    return counted.select(F.col("w.start").alias("interval_start"), provider, "n", "mean_latency", "min_latency", "max_latency")


def session_flow(df: DataFrame, ts: str, key: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions closed by a pause, from start, feedback and completion events."""
    windowed = late_by(df, ts, delay).groupBy(key, F.session_window(ts, gap).alias("w")).agg(
        F.count(F.lit(1)).alias("events"))
    return windowed.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def latency_alerts(df: DataFrame, latency: str, threshold: float = 10.0) -> DataFrame:
    return df.where(F.col(latency) > threshold)


def usage_alerts(counted: DataFrame, used: str, limit: int, share: float = 0.9) -> DataFrame:
    return counted.where(F.col(used) >= share * limit).withColumn("usage", F.col(used) / limit)


def stream_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema or spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def drain(stream: DataFrame, label: str, mode: str = "append", write: Callable | None = None, base: str | None = None) -> DataFrame:
    """Runs the stream over everything available and returns what it wrote.

    Output, offsets and state live in the shared folder, so a query restarted with the same ``base`` resumes.
    """
    spark = stream.sparkSession
    base = base or scratch_path(spark, label)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    if write is None:
        started = writer.format("parquet").option("path", f"{base}/out").start()
    else:
        started = writer.foreachBatch(lambda df, epoch: write(df, epoch, f"{base}/out")).start()
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
