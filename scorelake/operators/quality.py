"""Profiling, de-duplication and record validation."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.functions.text import strip
from scorelake.operators.ordering import exact_quantiles
from scorelake.operators.privacy import strip_markup


def tidy_name(name: str) -> str:
    return re.sub(r"[()]", "", name.strip().lower().replace(" ", "_"))


def tidy_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[tidy_name(c) for c in df.columns])


def whole_row(df: DataFrame, *columns: str) -> Column:
    """A digest that is equal for equal rows only, so that long texts are no shuffle keys."""
    return F.sha2(F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "false"}), 256)


def drop_duplicate_rows(df: DataFrame, *columns: str) -> DataFrame:
    """One row of each set of rows that are equal in the given columns, or in all."""
    return df.withColumn("_row", whole_row(df, *columns)).dropDuplicates(["_row"]).drop("_row")


def duplicate_report(df: DataFrame, *columns: str) -> DataFrame:
    """Rows, distinct rows and removed rows over whole rows or the given columns."""
    groups = df.groupBy(whole_row(df, *columns).alias("_row")).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("kept"),
        (F.sum("_n") - F.count(F.lit(1))).alias("removed"),
    )


def table_profile(df: DataFrame) -> DataFrame:
    """Type and null count of every column and the row count, in one pass."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    )
    types = F.create_map(*[x for c, t in df.dtypes for x in (F.lit(c), F.lit(t))])
    long = counts.unpivot("_rows", df.columns, "column", "nulls")
    return long.select("column", types[F.col("column")].alias("type"), F.col("_rows").alias("n_rows"), "nulls")


def unpivoted(df: DataFrame, columns: Sequence[str], dtype: str, *keep: str) -> DataFrame:
    casted = df.select(*keep, *[F.col(c).cast(dtype).alias(c) for c in columns])
    return casted.unpivot(list(keep), list(columns), "column", "value")


def numeric_profile(df: DataFrame, columns: Sequence[str], *by: str) -> DataFrame:
    """Count, mean, deviation, range and quartiles of each column, per group if given."""
    long = unpivoted(df, columns, "double", *by).where(F.col("value").isNotNull())
    keys = [*by, "column"]
    basic = long.groupBy(*keys).agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    return basic.join(exact_quantiles(long, "value", {"q25": .25, "q50": .5, "q75": .75}, keys), keys)


def categorical_profile(df: DataFrame, columns: Sequence[str], *by: str, top: int = 5) -> DataFrame:
    """Distinct count and the most frequent values of each column, per group if given."""
    long = unpivoted(df, columns, "string", *by).where(F.col("value").isNotNull())
    keys = [*by, "column"]
    counts = long.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "value")
    leading = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    distinct = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_distinct"))
    return leading.join(distinct, keys)


def range_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    long = unpivoted(df, columns, "double")
    return long.groupBy("column").agg(F.min("value").alias("low"), F.max("value").alias("high"))


def table_checksum(df: DataFrame) -> DataFrame:
    """Row count and the sum of 60-bit row hashes, which no order of rows changes.

    Every value is hashed by itself, a missing one as such, so values cannot move between columns.
    """
    values = [F.coalesce(F.md5(F.col(c).cast("string")), F.lit("missing")) for c in df.columns]
    row = F.conv(F.substring(F.md5(F.concat_ws("|", *values)), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(row).cast("string").alias("checksum"))


def issues(rules: Mapping[str, Column]) -> Column:
    """Messages of all rules whose condition holds, in rule order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(m)) for m, c in rules.items()]))


def answer_rules() -> dict[str, Column]:
    def blank(c):
        return F.coalesce(F.length(strip(c)) == 0, F.lit(True))

    return {
        "Question ID is required": blank("question_id"),
        "Question is required": blank("question"),
        "Answer is required": blank("answer"),
        "Difficulty must be easy, medium, or hard": ~F.coalesce("difficulty", F.lit("")).isin("easy", "medium", "hard"),
        "Expected length must be short, medium, or long":
            ~F.coalesce("expected_length", F.lit("")).isin("short", "medium", "long"),
        "At least one key point is required": F.coalesce(F.size("key_points"), F.lit(0)) < 1,
    }


def comment_rules(comment: str, low: int = 10, high: int = 1000) -> dict[str, Column]:
    text = strip(F.coalesce(comment, F.lit("")))
    return {
        "Comment too short": (F.length(text) > 0) & (F.length(text) < low),
        "Comment too long": F.length(F.coalesce(comment, F.lit(""))) > high,
    }


def _verdict(error: Column) -> Column:
    return F.struct(error.isNull().alias("is_valid"), F.coalesce(error, F.lit("")).alias("error"))


def check_query(query: str, limit: int = 5000) -> Column:
    text = F.coalesce(query, F.lit(""))
    return _verdict(
        F.when(text == "", "Query cannot be empty")
        .when(F.length(text) > limit, f"Query too long (max {limit} characters)")
        .when(strip_markup(text) != text, "Query contains potentially dangerous content")
    )


def check_comment(comment: str, limit: int = 1000) -> Column:
    text = F.coalesce(comment, F.lit(""))
    return _verdict(
        F.when(F.length(text) > limit, f"Comment too long (max {limit} characters)")
        .when((text != "") & (strip_markup(text) != text), "Comment contains potentially dangerous content")
    )


def is_industry(c: str, allowed: Sequence[str] = ("retail", "finance", "healthcare")) -> Column:
    return F.coalesce(F.lower(c).isin(*allowed), F.lit(False))


def is_selection(c: str) -> Column:
    return F.coalesce(F.col(c).isin(*"ABCDEF"), F.lit(False))


def check_session(session: str, step: str, *required: str) -> Column:
    missing = F.lit(False)
    for c in (session, step, *required):
        missing = missing | F.col(c).isNull()
    return _verdict(
        F.when(missing, "Missing required field")
        .when(~F.col(session).rlike(r"^session_\d+$"), "Invalid session ID format")
        .when((F.col(step) < 0) | (F.col(step) > 3), "Invalid step value")
    )


def response_rules(response: str, ms: str, tokens: str) -> dict[str, Column]:
    return {
        "Response too short": F.length(response) < 10,
        "Invalid response time": (F.col(ms) < 0) | (F.col(ms) > 60000),
        "Negative token count": F.col(tokens) < 0,
    }


def repeated_share(sentences: Column) -> Column:
    """Share of sentences that repeat an earlier one."""
    n = F.size(sentences)
    return F.when(n > 0, 1 - F.size(F.array_distinct(sentences)) / n).otherwise(0.0)


