"""Readers: CSV, JSON documents, JSON lines, saved evaluations and vector stores."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake import schemas
from scorelake.session import kept, saved
from scorelake.sources.json_items import _file, read_json_items


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header.  Give the schema in production; inference costs a second pass."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(path if isinstance(path, str) else list(path))


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    text_dates = T.StructType([T.StructField("Date", T.StringType()), *schemas.BARS.fields[1:]])
    raw = read_csv(spark, path, text_dates)
    return raw.withColumn("Date", F.coalesce(F.try_to_timestamp("Date", F.lit("yyyy-MM-dd")), F.try_to_timestamp("Date")).cast("date"))


def read_many_csv(spark: SparkSession, paths: Sequence[str], schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Several files as one table with their origin (source_file, source_path), and a table of those left out:
    source_file, source_path, reason, n_rows, n_bad.

    A file is taken whole or not at all: it is left out if it is missing, if it cannot be read to its
    end, or if one of its rows does not fit the schema.  Rows are read once into the shared folder.
    """
    whole, reasons = _readable(spark, list(paths))
    bad = "_bad_record"
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad)
    kind = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    if not whole:
        text = F.lit(None).cast("string")
        return spark.createDataFrame([], kind).drop(bad).withColumns({"source_file": text, "source_path": text}), reasons
    origin = {"source_file": F.col("_metadata.file_name"), "source_path": F.col("_metadata.file_path")}
    rows = saved(reader.schema(kind).csv(whole).withColumns(origin), "csv-rows")
    counts = rows.groupBy("source_file", "source_path").agg(F.count(F.lit(1)).alias("n_rows"), F.count(bad).alias("n_bad"), F.min(bad).alias("_first"))
    damaged = kept(counts.where("n_bad > 0").select(
        "source_file", "source_path", F.concat(F.lit("rows that do not fit: "), F.substring("_first", 1, 80)).alias("reason"), "n_rows", "n_bad"))
    good = rows.drop(bad).join(damaged.select("source_path"), "source_path", "left_anti")
    return good.select(*schema.names, "source_file", "source_path"), damaged.unionByName(reasons)


def _readable(spark: SparkSession, paths: list[str]) -> tuple[list[str], DataFrame]:
    """The files that can be read to their end (a task reads each through, a block at a time), and the others with a reason."""
    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                reason = None
                try:
                    fs, name = _file(path)
                    with fs.open_input_stream(name, compression="detect") as stream:
                        while stream.read(1 << 20):
                            pass
                except FileNotFoundError:
                    reason = "missing"
                except (OSError, EOFError) as error:
                    reason = f"cannot be read to its end: {str(error)[:80]}"
                yield pa.RecordBatch.from_pylist([{"path": path, "reason": reason}], pa.schema([("path", pa.string()), ("reason", pa.string())]))

    asked = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)), "path")
    found = kept(asked.mapInArrow(probed, "path string, reason string"))
    failed = {r.path for r in found.where("reason IS NOT NULL").collect()}  # names that the caller gave
    reasons = found.where("reason IS NOT NULL").select(
        F.substring_index("path", "/", -1).alias("source_file"), F.col("path").alias("source_path"), "reason", F.lit(None).cast("bigint").alias("n_rows"), F.lit(None).cast("bigint").alias("n_bad"))
    return [p for p in paths if p not in failed], reasons


def discover_csv(spark: SparkSession, folder: str, more_than: int = 10) -> DataFrame:
    """CSV files of a folder with more than ``more_than`` rows."""
    lines = spark.read.option("pathGlobFilter", "*.csv").text(folder)
    counted = lines.where(F.length("value") > 0).groupBy(F.col("_metadata.file_name").alias("file_name")).agg(
        (F.count(F.lit(1)) - 1).alias("n_rows"))
    return counted.where(F.col("n_rows") > more_than)


def discover_json(spark: SparkSession, folder: str, more_than: int = 5) -> DataFrame:
    """JSON files holding a list of more than ``more_than`` items, feedback files apart."""
    found = read_json_items(spark, f"{folder.rstrip('/')}/*.json").where("key IS NULL AND error IS NULL")
    sized = found.groupBy(F.substring_index("path", "/", -1).alias("file_name")).agg(F.count(F.lit(1)).alias("n_rows"))
    named = ~F.lower("file_name").rlike("feedback|blind")
    return sized.where(named & (F.col("n_rows") > more_than))


def read_json(spark: SparkSession, path: str, schema: T.StructType, lines: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def explode_by_provider(documents: DataFrame) -> DataFrame:
    """{question: {provider: answer}} documents as one row per answer."""
    asked = documents.select(F.explode("responses").alias("question_id", "q"))
    return asked.select(
        "question_id", "q.question", "q.domain", "q.rag_context", F.explode("q.llm_responses").alias("provider", "a")
    ).select("question_id", "question", "domain", "rag_context", "provider", "a.response", "a.model_name", "a.metadata.*")


def explode_by_domain(documents: DataFrame) -> DataFrame:
    """{domain: [question: [answer]]} documents as one row per answer."""
    domains = documents.select(F.explode("responses_by_domain").alias("domain", "questions"))
    asked = domains.select("domain", F.posexplode("questions").alias("q_idx", "q"))
    return asked.select("domain", "q_idx", "q.question", F.explode("q.responses").alias("a")).select(
        "domain", "q_idx", "question", "a.model", "a.provider", "a.response", "a.metadata.*")


def read_question_pool(spark: SparkSession, path: str) -> DataFrame:
    """Question pool with the index of each question inside its domain and the domain context."""
    found = read_json_items(spark, path).where("error IS NULL")
    domains = found.select(F.col("key").alias("domain"), F.from_json("value", schemas.QUESTION_POOL.valueType).alias("d"))
    return domains.select(
        "domain", "d.context", "d.evaluation_criteria", F.posexplode("d.questions").alias("question_idx", "q")
    ).select("domain", "question_idx", "q.id", "q.question", "context", "evaluation_criteria")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.EVENT).json(path)


def stream_events(spark: SparkSession, path: str, schema: T.StructType = schemas.EVENT) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def load_evaluation(spark: SparkSession, folder: str, evaluation_id: str) -> DataFrame | None:
    """Rows of one saved evaluation, from its partition only; None when there are none."""
    rows = spark.read.parquet(f"{folder}/results").where(F.col("evaluation_id") == evaluation_id)
    return None if rows.isEmpty() else rows


def evaluation_history(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/results").select("evaluation_id").distinct().orderBy(F.desc("evaluation_id"))


def load_vectors(spark: SparkSession, folder: str) -> tuple[DataFrame, dict[str, str]]:
    settings = {r.name: r.value for r in spark.read.json(f"{folder}/settings").collect()}
    return spark.read.parquet(f"{folder}/chunks"), settings


def file_stats(spark: SparkSession, path: str) -> DataFrame:
    """Entries and size of a log, over its distinct files."""
    files = spark.read.text(path).groupBy("_metadata.file_path").agg(
        F.count(F.lit(1)).alias("n"), F.max("_metadata.file_size").alias("size"))
    return files.agg(
        F.sum("n").alias("total_entries"), F.count(F.lit(1)).alias("files"),
        (F.sum("size") / (1024 * 1024)).alias("size_mb"))
