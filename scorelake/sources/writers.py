"""Append-only sinks, exports and reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scorelake.functions.text import strip
from scorelake.operators.blinding import chosen_item
from scorelake.operators.feedback import flatten_map, is_feedback
from scorelake.operators.privacy import strip_markup


def append_events(events: DataFrame, path: str, partitions: Sequence[str] = ("provider", "run_id")) -> None:
    """JSON lines, one object per event, stamped where the time is missing."""
    stamped = events.withColumn("timestamp", F.coalesce("timestamp", F.current_timestamp()))
    stamped.write.mode("append").partitionBy(*partitions).json(path)


def append_event_stream(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").start()
    )


def append_rows(rows: DataFrame, path: str, *partitions: str) -> None:
    """Feedback, session, health-check and intermediate rows: appended, never rewritten."""
    writer = rows.write.mode("append")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def export_feedback(log: DataFrame, path: str, ratings: Sequence[str]) -> str:
    """Feedback rows as CSV with one column per given rating; nothing is written without rows."""
    given = log.where(is_feedback())
    if given.isEmpty():
        return ""
    flat = flatten_map(given, "ratings", ratings)
    nested = [f.name for f in flat.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
    flat.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite").option("header", True).csv(path)
    return path


def save_evaluation(results: DataFrame, summary: DataFrame, tests: DataFrame, folder: str) -> None:
    """Results, provider summary and test results of one evaluation, by its id."""
    for name, frame in (("results", results), ("summary", summary), ("tests", tests)):
        frame.write.mode("append").partitionBy("evaluation_id").parquet(f"{folder}/{name}")


def export_json(rows: DataFrame, path: str, session_id: str, user: str) -> None:
    stamped = rows.withColumns({
        "export_timestamp": F.current_timestamp(), "export_session": F.lit(session_id), "export_user": F.lit(user)})
    stamped.write.mode("overwrite").json(path)


def snapshot(rows: DataFrame, folder: str, stamp: str) -> None:
    """Current copy plus a kept copy under its time stamp."""
    rows.write.mode("overwrite").parquet(f"{folder}/history/snapshot_ts={stamp}")
    rows.sparkSession.read.parquet(f"{folder}/history/snapshot_ts={stamp}").write.mode("overwrite").parquet(f"{folder}/current")


def save_vectors(chunks: DataFrame, settings: Mapping[str, str], folder: str) -> None:
    chunks.write.mode("append").parquet(f"{folder}/chunks")
    listed = [(k, str(v)) for k, v in settings.items()]
    chunks.sparkSession.createDataFrame(listed, "name string, value string").write.mode("overwrite").json(f"{folder}/settings")


def status_summary_csv(matrix: DataFrame, path: str) -> None:
    matrix.write.mode("overwrite").option("header", True).csv(path)


def register_people(rows: DataFrame, path: str) -> DataFrame:
    """Registrations with cleaned e-mail and signature; returns the audit rows."""
    clean = rows.withColumns({
        "email": strip_markup("email"), "signature": strip_markup("signature"), "timestamp": F.current_timestamp()})
    clean.write.mode("append").parquet(path)
    return clean.select(
        F.lit("user_registration").alias("event_type"), (F.length("email") > 0).alias("has_email"),
        (F.length(strip("signature")) > 0).alias("has_signature"))


def resolved_selections(rows: DataFrame) -> DataFrame:
    """Selections with the response behind the chosen label and the next step."""
    return rows.withColumns({
        "selected_response_id": chosen_item("selected_label", "blind_map"), "comment": F.coalesce("comment", F.lit("")),
        "step": F.col("step") + 1, "timestamp": F.current_timestamp()})


def truth_document(answers: DataFrame) -> DataFrame:
    """Answer rows (domain, question_id, answer, details) as one JSON text per question."""
    return answers.select("domain", "question_id", F.to_json(F.struct("answer", "details")).alias("document"))


def identified(df: DataFrame, order: str) -> DataFrame:
    """Session, evaluation and test identifiers made from time and row number."""
    return df.withColumns({
        "session_id": F.concat(F.lit("session_"), F.unix_seconds(F.current_timestamp()), F.lit("_"), F.substring(F.uuid(), 1, 8)),
        "evaluation_id": F.concat(F.lit("eval_"), F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")),
        "test_id": F.format_string("auto_test_%03d", F.col(order)),
    })


def report_lines(evaluation_id: str, ranked: DataFrame, anova: DataFrame, overall: DataFrame) -> DataFrame:
    """Text report of one evaluation as ordered lines.

    ``ranked`` has provider, rank, mean, std, ci_low, ci_high; ``anova`` description and
    effect_size; ``overall`` best, worst, evaluations, avg_overall, avg_time_ms.  One
    line group per provider comes in, so the ordered lines stay few.
    """
    rule = F.lit("-" * 20)
    head = overall.select(F.lit(0).alias("part"), F.lit(0).alias("place"), F.array(
        F.lit("EVALUATION SUMMARY REPORT"), F.lit("=" * 50), F.lit(""), F.lit(f"Evaluation ID: {evaluation_id}"),
        F.concat(F.lit("Total Evaluations: "), F.col("evaluations").cast("string")), F.lit(""),
        F.lit("PROVIDER RANKINGS"), rule).alias("lines"))
    body = ranked.select(F.lit(1).alias("part"), F.col("rank").cast("int").alias("place"), F.array(
        F.concat("provider", F.lit(":")), F.format_string("  Rank: %d", F.col("rank")),
        F.format_string("  Mean Score: %.4f", "mean"), F.format_string("  Std Dev: %.4f", F.coalesce("std", F.lit(0.0))),
        F.format_string("  Confidence Interval: (%.4f, %.4f)", "ci_low", "ci_high"), F.lit("")).alias("lines"))
    tests = anova.select(F.lit(2).alias("part"), F.lit(0).alias("place"), F.array(
        F.lit("STATISTICAL SIGNIFICANCE"), rule, F.concat(F.lit("ANOVA Result: "), "description"),
        F.coalesce(F.format_string("Effect Size: %.4f", "effect_size"), F.lit("Effect Size: N/A")), F.lit("")).alias("lines"))
    tail = overall.select(F.lit(3).alias("part"), F.lit(0).alias("place"), F.array(
        F.lit("OVERALL PERFORMANCE"), rule, F.concat(F.lit("Best Provider: "), "best"), F.concat(F.lit("Worst Provider: "), "worst"),
        F.format_string("Average Overall Score: %.4f", "avg_overall"),
        F.format_string("Average Response Time: %.2fms", "avg_time_ms")).alias("lines"))
    parts = head.unionByName(body).unionByName(tests).unionByName(tail)
    return parts.select("part", "place", F.posexplode("lines").alias("line", "text"))


def write_report(lines: DataFrame, path: str) -> None:
    lines.orderBy("part", "place", "line").select("text").coalesce(1).write.mode("overwrite").text(path)
