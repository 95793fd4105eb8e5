"""Word-window chunks of documents and profiles of fixed-size row blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.functions.text import strip, words
from scorelake.operators.ordering import row_blocks
from scorelake.operators.series import trend_label


def chunk_text(
    df: DataFrame, text: str, source: str, size: int = 300, overlap: int = 50, *keep: str
) -> DataFrame:
    """Overlapping word windows; a short text stays one chunk in its original form.

    The last window is the first one that reaches the end of the text.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    step = size - overlap
    n = F.size("_words")
    count = F.greatest(F.lit(1), F.ceil((n - overlap) / step)).cast("int")
    starts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: i * step)
    split = (
        df.where(F.length(strip(text)) > 0)
        .withColumn("_words", words(text))
        .withColumn("_n", n)
        .select(*keep, source, text, "_words", "_n", F.posexplode(starts).alias("chunk_index", "start_index"))
    )
    end = F.least(F.col("start_index") + size, F.col("_n"))
    body = F.when(F.col("_n") <= size, F.col(text)).otherwise(
        F.array_join(F.slice("_words", F.col("start_index") + 1, F.lit(size)), " ")
    )
    return split.select(
        *keep, source, F.concat(F.col(source).cast("string"), F.lit("_chunk_"), "chunk_index").alias("chunk_id"),
        "chunk_index", "start_index", end.alias("end_index"), body.alias("chunk_text"),
    )


def blocked(df: DataFrame, order: str, size: int, source: str) -> DataFrame:
    """Rows with their block of ``size`` rows in input order and the block's id."""
    total = df.agg(F.count(F.lit(1))).scalar()
    placed = row_blocks(df, order, size).withColumn("source_file", F.lit(source))
    # only the last block is short, so its size follows from the table's
    sized = placed.withColumn("block_rows", F.least(F.lit(size), total - F.col("start_row")))
    last = F.col("start_row") + F.col("block_rows") - 1
    return sized.withColumn("end_row", last).withColumn(
        "chunk_id", F.concat_ws("_", F.lit(source), "start_row", "end_row")
    )


def long_numbers(blocks: DataFrame, columns: Sequence[str], *keep: str) -> DataFrame:
    chosen = blocks.select("chunk_id", "block", *keep, *[F.col(c).cast("double").alias(c) for c in columns])
    return chosen.unpivot(["chunk_id", "block", *keep], list(columns), "column", "value")


def block_statistics(blocks: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Seven figures per block and column.  A block has a fixed number of rows, so the
    built-in exact percentile works on bounded groups here."""
    marks = F.percentile("value", F.array(F.lit(.25), F.lit(.5), F.lit(.75)))
    found = long_numbers(blocks, columns).groupBy("chunk_id", "block", "column").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("value").isNull()).alias("nulls"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"), marks.alias("_m"),
    )
    return found.select(
        "chunk_id", "block", "column", "n_rows", "nulls", "mean", F.col("_m")[1].alias("median"), "std", "min", "max",
        F.col("_m")[0].alias("q25"), F.col("_m")[2].alias("q75"),
    )


def block_outliers(blocks: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values outside 1.5 interquartile ranges, for block columns that have any.

    The quartiles come from a window over the block's own rows, and the final grouping
    has the same keys, so the values move once.
    """
    keys = ["chunk_id", "column"]
    marks = F.percentile("value", F.array(F.lit(.25), F.lit(.75))).over(Window.partitionBy(*keys))
    marked = long_numbers(blocks, columns).withColumn("_m", marks)
    q25, q75 = F.col("_m")[0], F.col("_m")[1]
    bounded = marked.withColumn("lower", q25 - 1.5 * (q75 - q25)).withColumn("upper", q75 + 1.5 * (q75 - q25))
    outside = (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))
    found = bounded.groupBy(*keys).agg(
        F.count_if(outside).alias("outliers"), (F.count_if(outside) / F.count(F.lit(1)) * 100).alias("outlier_pct"),
        F.max("lower").alias("lower"), F.max("upper").alias("upper"),
        F.sort_array(F.collect_list(F.when(outside, F.col("value")))).alias("outlier_values"),
    )
    return found.where("outliers > 0")


def block_trends(blocks: DataFrame, ts: str, columns: Sequence[str]) -> DataFrame:
    """Correlation of time with each column and its direction."""
    long = long_numbers(blocks.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp"))), columns, "_t")
    r = long.groupBy("chunk_id", "column").agg(F.corr(F.col("_t").cast("double"), "value").alias("correlation"))
    return r.withColumn("direction", trend_label(F.col("correlation")))


def block_lines(blocks: DataFrame, numbers: Sequence[str], ts: str) -> DataFrame:
    """Per block the lines that a prompt shows beside its text: stat_lines, trend_lines, outlier_lines, in the order of ``numbers``.

    Figures are rounded to nine digits first: what computing leaves in the last ones must not decide a half.
    """
    order = F.element_at(F.create_map(*[x for i, c in enumerate(numbers) for x in (F.lit(c), F.lit(i))]), F.col("column"))
    zero = F.lit(0.0)

    def gathered(df: DataFrame, line: Column, name: str) -> DataFrame:
        listed = F.sort_array(F.collect_list(F.struct(order.alias("o"), line.alias("l"))))  # a line per column
        return df.groupBy("chunk_id").agg(F.transform(listed, lambda s: s["l"]).alias(name))

    def near(column: str) -> Column:
        return F.round(F.coalesce(column, zero), 9)

    stats = block_statistics(blocks, numbers).where("n_rows > nulls")
    spread = F.format_string("  %s: μ=%.2f, σ=%.2f, range=[%.2f-%.2f]", "column", near("mean"), near("std"), near("min"), near("max"))
    trends = block_trends(blocks, ts, numbers).where(F.col("correlation").isNotNull())
    trend = F.format_string("  %s: %s (r=%.3f)", "column", "direction", near("correlation"))
    outside = F.format_string("  %s: %d outliers (%.1f%%)", "column", "outliers", near("outlier_pct"))
    out = gathered(stats, spread, "stat_lines")
    for df, line, name in ((trends, trend, "trend_lines"), (block_outliers(blocks, numbers), outside, "outlier_lines")):
        out = out.join(gathered(df, line, name), "chunk_id", "left")
    empty = F.array().cast("array<string>")
    return out.select("chunk_id", "stat_lines", *[F.coalesce(n, empty).alias(n) for n in ("trend_lines", "outlier_lines")])


def _lines(parts: Column) -> Column:
    return F.concat_ws("\n", parts)


def _top_values(blocks: DataFrame, column: str, top: int) -> DataFrame:
    counts = blocks.where(F.col(column).isNotNull()).groupBy("chunk_id", column).agg(
        F.count(F.lit(1)).alias("n"), F.max("block_rows").alias("rows"))
    order = Window.partitionBy("chunk_id").orderBy(F.desc("n"), column)
    leading = counts.withColumn("_p", F.row_number().over(order)).where(F.col("_p") <= top)
    line = F.format_string("  %s: %d (%.1f%%)", F.col(column).cast("string"), F.col("n"), F.col("n") / F.col("rows") * 100)
    return leading.groupBy("chunk_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_p", line.alias("l")))), lambda s: s["l"]).alias(f"_top_{column}"))


def block_summaries(
    blocks: DataFrame, numbers: Sequence[str], categories: Sequence[str], ts: str | None, shown: Sequence[str],
) -> DataFrame:
    """Readable summary of every block: figures, top values, trend and sample records.

    All parts are bounded by the block size, so gathering them per block is safe.
    """
    head = blocks.groupBy("chunk_id").agg(
        F.min("start_row").alias("start_row"), F.max("end_row").alias("end_row"),
        F.max("block_rows").alias("n"), F.max("source_file").alias("source_file"),
        *([F.min(ts).alias("_t0"), F.max(ts).alias("_t1")] if ts else []),
    )
    place = {c: i for i, c in enumerate(numbers)}
    order = F.element_at(F.create_map(*[x for c, i in place.items() for x in (F.lit(c), F.lit(i))]), F.col("column"))
    figure = F.format_string(
        "%s:\n  Mean: %.2f, Median: %.2f\n  Std: %.2f, Range: %.2f-%.2f",
        # what computing leaves in the last digits must not decide a half
        "column", *[F.round(c, 9) for c in ("mean", "median", F.coalesce("std", F.lit(0.0)), "min", "max")],
    )
    figures = block_statistics(blocks, numbers).groupBy("chunk_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), figure.alias("l")))), lambda s: s["l"]).alias("_figures"))
    named = F.concat_ws(", ", *[
        F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in shown[:5]
    ])
    record = F.concat(F.lit("Record "), F.col("row_in_block") + 1, F.lit(": "), named)
    samples = blocks.where(F.col("row_in_block") < 3).groupBy("chunk_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("row_in_block", record.alias("l")))), lambda s: s["l"]).alias("_records"))
    out = head.join(figures, "chunk_id", "left").join(samples, "chunk_id", "left")
    span = F.concat(F.lit("Rows "), "start_row", F.lit("-"), "end_row", F.lit(" ("), "n", F.lit(" records)"))
    parts = [
        F.array(F.lit("=== CHUNK SUMMARY ==="), span, F.concat(F.lit("Source: "), "source_file"), F.lit("")),
        F.array(F.lit("=== NUMERIC STATISTICS ===")), F.col("_figures"), F.array(F.lit("")),
    ]
    for c in categories:
        out = out.join(_top_values(blocks, c, 5), "chunk_id", "left")
        parts += [F.array(F.lit(f"=== {c.upper()} DISTRIBUTION ===")), F.col(f"_top_{c}"), F.array(F.lit(""))]
    if ts:
        r = F.col("correlation")
        line = F.format_string("%s trend: %s (r=%.3f)", F.col("column"), F.initcap("direction"), r)
        trends = block_trends(blocks, ts, numbers[:3]).where(r.isNotNull()).groupBy("chunk_id").agg(
            F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), line.alias("l")))), lambda s: s["l"]).alias("_trends"))
        out = out.join(trends, "chunk_id", "left")
        dates = F.concat(F.lit("Date range: "), F.col("_t0").cast("string"), F.lit(" to "), F.col("_t1").cast("string"))
        parts += [F.array(F.lit("=== TREND ANALYSIS ==="), dates), F.col("_trends"), F.array(F.lit(""))]
    parts += [F.array(F.lit("=== SAMPLE RECORDS ===")), F.col("_records")]
    empty = F.array().cast("array<string>")
    body = F.flatten(F.array(*[F.coalesce(p, empty) for p in parts]))
    return out.select("chunk_id", "start_row", "end_row", _lines(body).alias("content"))
