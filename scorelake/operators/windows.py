"""Window operators whose windows stay small: budgets, trailing counts, gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.operators.merging import in_order, together
from scorelake.operators.ordering import row_positions
from scorelake.session import kept


def within_budget(df: DataFrame, by: Sequence[str], rank: str, length: Column, budget: int) -> DataFrame:
    """Leading rows whose running length stays within the budget; stops at the first overflow."""
    running = F.sum(length).over(
        Window.partitionBy(*by).orderBy(rank).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return df.withColumn("_used", running).where(F.col("_used") <= budget).drop("_used")


def leading_within(
    df: DataFrame, by: str, order: str, ties: Sequence[str], length: str, budget: int, name: str = "rank"
) -> DataFrame:
    """Rows of each group in the given order as long as their running length stays within the budget.

    ``order`` never falls with the length, so rows of length 0 come first and all stay; their
    places come from bucketed ordering.  Of the others no more than ``budget`` can fit, so the rank
    limit in front of the shuffle loses none and a busy group sends that many rows per task at most.
    """
    nothing = row_positions(df.where(F.coalesce(F.col(length), F.lit(0)) <= 0), order, [by], name, ties).withColumn(name, F.col(name) + 1)
    before = nothing.groupBy(F.col(by).alias("_by")).agg(F.count(F.lit(1)).alias("_before"))
    some = df.where(F.col(length) > 0).withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(order, *ties)))
    fitting = within_budget(some.where(F.col(name) <= budget), [by], name, F.col(length), budget)
    placed = fitting.join(before, fitting[by].eqNullSafe(before["_by"]), "left")
    shifted = placed.withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_by", "_before")
    return nothing.select(shifted.columns).unionByName(shifted)


def trailing_count(
    df: DataFrame, keys: Sequence[str], ts: str, seconds: int, name: str = "in_window", oldest: str | None = None
) -> DataFrame:
    """Events of the key in the last ``seconds`` up to and including each event, and
    optionally the time of the oldest of them.

    Equal times of a key are counted together first.  Newest first, each (key, time) and the question
    how many lie at or after (key, time - seconds) are sorted as one; the answer is the difference of
    two running counts, and the last event before the question is the oldest.  No window of a key or an
    hour is ever formed, so a busy hour spreads over all ranges.  Events without a time are in no
    window; events without a key share one.
    """
    keys = list(keys)
    here = df.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    times = kept(here.where(F.col("_us").isNotNull()).groupBy(*keys, "_us").agg(F.count(F.lit(1)).alias("weight")))
    events = times.select(
        *keys, "_us", F.col("_us").alias("_of"), "weight", F.lit(True).alias("marked"), F.col("_us").alias("carry"), F.col("weight").alias("_own"))
    asked = times.select(*keys, (F.col("_us") - seconds * 1_000_000).alias("_us"), F.col("_us").alias("_of"), F.lit(0).alias("weight"))
    newest_first = [*[F.col(k).desc() for k in keys], F.col("_us").desc(), F.col("_own").desc_nulls_last()]
    placed = in_order(together(events, asked), newest_first, "trailing")
    answers = kept(placed.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys], "_of").agg(
        (F.max(F.when(F.col("_own").isNull(), F.col("upto"))) - F.max(F.col("upto") - F.col("_own"))).alias("_n"),
        F.max(F.when(F.col("_own").isNull(), F.col("last"))).alias("_oldest")))
    met = F.col("_us") == F.col("_of")
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    added = {name: F.coalesce("_n", F.lit(0)), **({oldest: F.timestamp_micros("_oldest")} if oldest else {})}
    return here.join(answers, met, "left").withColumns(added).drop("_us", "_of", "_n", "_oldest", *[f"_k_{k}" for k in keys])


def activity_islands(
    df: DataFrame, keys: Sequence[str], ts: str, gap_seconds: int, name: str = "island"
) -> DataFrame:
    """Numbers the stretches of a key that are separated by more than ``gap_seconds``.

    A gap longer than a time cell always crosses a cell border, so first and last times
    per (key, cell) are enough to find it; the window runs over cells, not rows.
    """
    keys = list(keys)
    span = gap_seconds * 1_000_000
    placed = df.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn(
        "_cell", F.floor(F.col("_us") / span)
    )
    cells = placed.groupBy(*keys, "_cell").agg(F.min("_us").alias("_first"), F.max("_us").alias("_last"))
    order = Window.partitionBy(*keys).orderBy("_cell")
    starts = F.when(F.col("_first") - F.lag("_last").over(order) > span, 1).otherwise(0)
    numbered = cells.withColumn("_new", starts).select(
        *keys, "_cell", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(name)
    )
    met = F.lit(True)
    for k in [*keys, "_cell"]:  # rows without a key or a time keep their place: such a time is a cell of its own
        numbered = numbered.withColumnRenamed(k, f"_n_{k}")
        met = met & placed[k].eqNullSafe(numbered[f"_n_{k}"])
    return placed.join(numbered, met).drop("_us", "_cell", *[f"_n_{k}" for k in [*keys, "_cell"]])


def consecutive_runs(
    df: DataFrame, keys: Sequence[str], order: str, flag: Column, ties: Sequence[str] = (), least: int = 1
) -> DataFrame:
    """Runs of neighbouring rows where the flag holds: first and last order value, length.

    A row's position among all rows of its key minus its position among the flagged rows
    is constant within a run; both positions come from bucketed ordering, so one busy
    key does not end up in one task.
    """
    keys = list(keys)
    marked = df.select(*keys, order, *ties, F.coalesce(flag, F.lit(False)).alias("_flag"))
    placed = row_positions(marked, order, keys, "_all", ties)
    placed = row_positions(placed.where("_flag"), order, keys, "_own", ties)
    runs = placed.groupBy(*keys, (F.col("_all") - F.col("_own")).alias("_run")).agg(
        F.min(order).alias("run_start"), F.max(order).alias("run_end"), F.count(F.lit(1)).alias("run_length")
    )
    return runs.where(F.col("run_length") >= least).drop("_run")


def sessions(df: DataFrame, keys: Sequence[str], ts: str, gap_seconds: int, *extra: Column) -> DataFrame:
    """Activity sessions of each key: start, end, events."""
    numbered = activity_islands(df, keys, ts, gap_seconds, "session_number")
    return numbered.groupBy(*keys, "session_number").agg(
        F.min(ts).alias("session_start"), F.max(ts).alias("session_end"), F.count(F.lit(1)).alias("events"), *extra
    )
