"""Order statistics that never put a whole group into one task.

A window over a group sorts that group in a single task, and the built-in exact
``percentile`` keeps every distinct value of a group in one map.  Both fail when one
key owns a third of the rows.  Everything here cuts the value range into buckets that
hold about the same number of rows (boundaries from a bounded sketch of the rows), orders each
(group, bucket) cell on its own and shifts it by the sizes of the cells before it.
The sketch only decides where the cuts fall; the results are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.operators.merging import in_order, together
from scorelake.session import kept, shuffle_width


def _sortable(df: DataFrame, value: str) -> Column:
    """A number with the order of the value."""
    kind = df.schema[value].dataType.typeName()
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(value).cast("timestamp"))
    return F.unix_date(value) if kind == "date" else F.col(value)


def cut_points(df: DataFrame, value: str, buckets: int | None = None) -> list:
    """At most ``buckets - 1`` boundaries of nearly equal row counts.

    Merging sketches is not deterministic, so the boundaries are fetched once and enter
    every later expression, and every retried task, as the same literals.
    """
    n = buckets or shuffle_width(df.sparkSession)
    steps = [i / n for i in range(1, n)]
    found = df.agg(F.percentile_approx(_sortable(df, value), steps, max(1000, 20 * n))).first()[0]
    return sorted(set(found or []))


def _with_bucket(df: DataFrame, value: str, cuts: list) -> DataFrame:
    if not cuts:
        return df.withColumn("_bucket", F.lit(0))
    key = _sortable(df, value)

    def within(low: int, high: int) -> Column:
        """Number of cuts below the value, of those between; halving keeps the comparisons per row few."""
        if low == high:
            return F.lit(low)
        half = (low + high) // 2
        return F.when(key <= F.lit(cuts[half]), within(low, half)).otherwise(within(half + 1, high))

    return df.withColumn("_bucket", F.when(key.isNull(), 0).otherwise(within(0, len(cuts))))


def _cell_offsets(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows before each cell and rows of the whole group; one row per cell comes in."""
    ordered = Window.partitionBy(*by).orderBy("_bucket")
    before = F.sum("_cell_rows").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("_cell_rows").over(Window.partitionBy(*by))
    return cells.select(
        *by, "_bucket",
        F.coalesce(before, F.lit(0)).alias("_offset"),
        total.alias("n_group"),
    )


def value_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per (group, value) with ``n_rows``; written once, so that cuts, moments and places share one read."""
    rows = df.select(*by, value)
    for c in (value, *by):
        rows = rows.where(F.col(c).isNotNull())
    return kept(rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n_rows")))


def value_positions(
    df: DataFrame, value: str, by: Sequence[str] = (), buckets: int | None = None, counted: DataFrame | None = None
) -> DataFrame:
    """One row per (group, value): ``n_rows`` with it, ``n_before`` smaller, ``n_group``.

    Rows without a value or a group are left out.  The table is read once, for the counts;
    ``counted`` passes counts that are there already.  Joining the offsets and the running sum hash
    on (group, bucket).
    """
    by = list(by)
    counted = value_counts(df, value, by) if counted is None else counted
    spread = _with_bucket(counted, value, cut_points(counted, value, buckets))
    cells = spread.groupBy(*by, "_bucket").agg(F.sum("n_rows").alias("_cell_rows"))
    placed = spread.join(_cell_offsets(cells, by), [*by, "_bucket"])
    running = (
        Window.partitionBy(*by, "_bucket")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return placed.select(
        *by, value, "n_rows",
        (F.col("_offset") + F.coalesce(F.sum("n_rows").over(running), F.lit(0))).alias("n_before"),
        "n_group",
    )


def row_positions(
    df: DataFrame, order: str, by: Sequence[str] = (), name: str = "position",
    ties: Sequence[str] = (),
) -> DataFrame:
    """Adds the 0-based position of every row inside its group, ordered by ``order``, then ``ties``.

    The rows are cut by range over group, order, ties and a hash of the row, so neither a busy group nor
    a value that half of the rows share fills one task; a border element in front of each group says
    where its count begins.  A missing group key is a group of its own, missing values come first.
    """
    by, names = list(by), df.columns
    rows = df.select(*names, F.lit(1).alias("_row"), F.xxhash64(*[c for c in names if _hashable(df, c)]).alias("_salt"), F.lit(1).alias("weight"))
    borders = df.select(*by).distinct().select(*by, F.lit(0).alias("_row"), F.lit(0).alias("weight"), F.lit(True).alias("marked"))
    placed = in_order(together(rows, borders) if by else rows, [*by, "_row", order, *ties, "_salt"], "positions")
    return placed.where("_row = 1").select(*names, (F.col("since") - 1).alias(name))


def _hashable(df: DataFrame, column: str) -> bool:
    return not any(t in df.schema[column].dataType.simpleString() for t in ("map<", "variant"))


def _brackets(rows: DataFrame, probs: dict[str, float], by: list[str], accuracy: int, also: Sequence[Column]) -> DataFrame:
    """Per group the row count and, per probability, a low and a high value with the place sought between them,
    as far as the sketch keeps its promise; further aggregates come from the same read."""
    margin = 1.5 / accuracy
    edges = [e for p in probs.values() for e in (max(0.0, p - margin), min(1.0, p + margin))]
    sketch = F.percentile_approx("_v", edges, accuracy).alias("_edges")
    return kept(rows.groupBy(*by).agg(F.count("_v").alias("n_group"), sketch, *also))


def _cells(rows: DataFrame, brackets: DataFrame, by: list[str], n: int) -> DataFrame:
    """Row counts per group in the order of the values: each value inside a bracket on its own, each stretch
    between brackets as one cell with its least and greatest value.  Only the former travel one by one."""
    edges = brackets.select(*[F.col(k).alias(f"_b_{k}") for k in by], F.col("_edges"))
    met = F.lit(True)
    for k in by:
        met = met & (F.col(k) == F.col(f"_b_{k}"))
    placed = rows.join(edges, met) if by else rows.withColumn("_edges", edges.scalar())
    low, high = ([F.col("_edges")[2 * j + side] for j in range(n)] for side in (0, 1))
    inside = F.lit(False)
    above = F.lit(0)
    for lo, hi in zip(low, high):
        inside = inside | ((F.col("_v") >= lo) & (F.col("_v") <= hi))
        above = above + F.when(F.col("_v") > hi, 1).otherwise(0)
    marked = placed.select(*by, "_v", F.when(inside, F.col("_v")).alias("_exact"), F.when(inside, -1).otherwise(above).alias("_stretch"))
    return kept(marked.groupBy(*by, "_stretch", "_exact").agg(
        F.count(F.lit(1)).alias("weight"), F.min("_v").alias("_least"), F.max("_v").alias("_most")))


def exact_quantiles(
    df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = (), also: Sequence[Column] = (), accuracy: int = 4000,
) -> DataFrame:
    """Linearly interpolated quantiles, one column per name in ``probs``; ``also``: further aggregates of the same rows.

    Selection in rounds: a sketch brackets each place sought, one aggregate counts the rows below and
    between the brackets and the values inside them, and only those values are put in order.  Where a
    place lies outside its bracket after all, the cell it lies in is the bracket of the next round, so
    results are exact whatever the sketch says.  Rows without a value count only in ``also``; groups
    without a key are left out, groups without a value have null quantiles.
    """
    by, names = list(by), list(probs)
    rows = df
    for k in by:
        rows = rows.where(F.col(k).isNotNull())
    rows = rows.withColumn("_v", _sortable(df, value))
    brackets = _brackets(rows, probs, by, accuracy, also)
    filled = rows.where(F.col("_v").isNotNull()).select(*by, "_v")
    found, open_ = [], brackets
    while True:
        picked = kept(_picked(_cells(filled, open_, by, len(names)), brackets, probs, by))
        missed = picked.where(F.exists("marks", lambda m: m.isNotNull() & m["value"].isNull()))
        if missed.isEmpty():
            found.append(picked)
            break
        found.append(picked.join(missed.select(*by), by, "left_anti") if by else picked.limit(0))
        edges = F.flatten(F.transform("marks", lambda m: F.array(m["least"], m["most"])))
        open_ = kept(missed.select(*by, _paired(edges, len(names)).alias("_edges")))
        filled = filled.join(open_.select(*by), by, "left_semi") if by else filled
    marks = found[0]
    for more in found[1:]:
        marks = marks.unionByName(more)
    spots = {}
    for j, (name, p) in enumerate(probs.items()):
        exact = F.lit(float(p)) * (F.col("n_group") - 1)
        lo, hi = (F.col("marks")[2 * j + side]["value"] for side in (0, 1))
        spots[name] = lo + (exact - F.floor(exact)) * (hi - lo)
    extra = [c for c in brackets.columns if c not in (*by, "n_group", "_edges")]
    held = brackets.select(*by, "n_group", *extra)
    joined = held.join(marks, by, "left") if by else held.withColumn("marks", marks.select("marks").scalar())
    return joined.select(*by, *extra, *[c.alias(n) for n, c in spots.items()])


def _paired(edges: Column, n: int) -> Column:
    """Of the low and high place of each probability, one bracket over both cells."""
    return F.array(*[x for j in range(n) for x in (edges[4 * j], edges[4 * j + 3])])


def _picked(cells: DataFrame, sizes: DataFrame, probs: dict[str, float], by: list[str]) -> DataFrame:
    """Per group an array ``marks`` with the value at the low and the high place of each probability, or null and the
    bounds of the cell that holds the place."""
    borders = cells.select(*by).distinct().select(*by, F.lit(0).alias("weight"), F.lit(True).alias("marked"))
    elements = together(cells.withColumn("_own", F.col("weight")), borders) if by else cells.withColumn("_own", F.col("weight"))
    placed = in_order(elements, [*by, F.col("_least").asc_nulls_first()], "cells").where("_own IS NOT NULL")
    first, last = F.col("since") - F.col("_own"), F.col("since") - 1
    joined = placed.join(sizes.select(*by, "n_group"), by) if by else placed.withColumn("n_group", sizes.select("n_group").scalar())
    picks = []
    for p in probs.values():
        exact = F.lit(float(p)) * (F.col("n_group") - 1)
        for place in (F.floor(exact), F.ceil(exact)):
            sure = F.when((place == first) | (F.col("_least") == F.col("_most")), F.col("_least")).when(place == last, F.col("_most"))
            cell = F.struct(sure.cast("double").alias("value"), F.col("_least").alias("least"), F.col("_most").alias("most"))
            picks.append(F.max(F.when((first <= place) & (place <= last), cell)))
    return joined.groupBy(*by).agg(F.array(*picks).alias("marks"))


def average_ranks(
    df: DataFrame, value: str, by: Sequence[str] = (), name: str = "rank", counted: DataFrame | None = None
) -> DataFrame:
    """Rank of each distinct value where tied rows share their mean rank."""
    return value_positions(df, value, by, counted=counted).select(
        *by, value, (F.col("n_before") + (F.col("n_rows") + 1) / 2).alias(name), "n_group"
    )


def row_blocks(df: DataFrame, order: str, size: int, ties: Sequence[str] = ()) -> DataFrame:
    """Fixed-size blocks of rows in ``order``: adds ``block``, ``start_row``, ``row_in_block``."""
    placed = row_positions(df, order, name="_position", ties=ties)
    block = F.floor(F.col("_position") / size)
    return (
        placed.withColumn("block", block)
        .withColumn("start_row", block * size)
        .withColumn("row_in_block", F.col("_position") - block * size)
        .drop("_position")
    )
