"""Counts and as-of lookups over one total order that is cut by range.

Elements of any kind (rows, questions asked between rows, borders) are sorted together.  Spark cuts
the order into ranges of equal size over all its columns, so one busy key, one busy hour or one
repeated value is cut like everything else.  Each range adds up on its own; what came before it is a
table with one row per range.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.session import saved, shuffle_width

ADDED = T.StructType([
    T.StructField("_part", T.IntegerType()), T.StructField("_at", T.LongType()), T.StructField("_found", T.BooleanType()),
    T.StructField("_mark", T.LongType()), T.StructField("upto", T.LongType()), T.StructField("last", T.LongType()),
])


def _added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running values of one range."""
    part, at, total, mark, last, found = TaskContext.get().partitionId(), 0, 0, 0, None, False
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        upto = total + np.cumsum(batch.column("weight").to_numpy(zero_copy_only=False), dtype=np.int64)
        marked = batch.column("marked").to_numpy(zero_copy_only=False).astype(bool)
        place = np.maximum.accumulate(np.where(marked, np.arange(n), -1))
        seen = place >= 0
        carried = pc.if_else(pa.array(seen), batch.column("carry").take(pa.array(np.maximum(place, 0))), pa.scalar(last, pa.int64()))
        marks = np.where(seen, upto[np.maximum(place, 0)], mark)
        added = [
            pa.array(np.full(n, part, np.int32)), pa.array(at + np.arange(n)), pa.array(seen | found), pa.array(marks), pa.array(upto), carried]
        names = [f for f in batch.schema.names if f not in ("weight", "marked", "carry")]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *added], [*names, *ADDED.names])
        at, total, mark, last, found = at + n, int(upto[-1]), int(marks[-1]), carried[-1].as_py(), bool(found or seen[-1])


def in_order(elements: DataFrame, order: Sequence[str | Column], label: str = "ordered") -> DataFrame:
    """Adds ``upto``, the weights of this and all earlier elements, and for the last marked element up to this one
    ``last``, its ``carry``, and ``since``, the weights after it.

    ``elements`` has ``weight`` (not negative) and, where wanted, ``marked`` and ``carry`` (bigint) beside any
    other columns, which stay.  Equal elements may come in any order.  The result is written to the shared folder once.
    """
    for column, kind in (("marked", "boolean"), ("carry", "bigint")):
        if column not in elements.columns:
            elements = elements.withColumn(column, F.lit(None).cast(kind))
    spark, rest = elements.sparkSession, [f for f in elements.schema if f.name not in ("weight", "marked", "carry")]
    names = [f.name for f in rest]
    shaped = elements.select(
        *names, F.col("weight").cast("bigint").alias("weight"), F.coalesce("marked", F.lit(False)).alias("marked"), F.col("carry").cast("bigint").alias("carry"))
    dealt = shaped.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    local = saved(dealt.mapInArrow(_added_up, T.StructType([*rest, *ADDED])), label)
    ends = local.groupBy("_part").agg(F.max(F.struct("_at", "upto", "_found", "_mark", "last")).alias("e"))
    # one row per range; both sides are that small
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("e.upto").over(earlier), F.lit(0))
    held = ends.select("_part", before.alias("_before"), "e").select(
        "_part", "_before", F.when(F.col("e._found"), F.struct((F.col("_before") + F.col("e._mark")).alias("mark"), F.col("e.last").alias("last"))).alias("own"))
    carried = held.select("_part", "_before", F.last("own", ignorenulls=True).over(earlier).alias("_held"))
    placed = local.join(F.broadcast(carried), "_part")
    mark = F.when(F.col("_found"), F.col("_before") + F.col("_mark")).otherwise(F.coalesce("_held.mark", F.lit(0)))
    upto = F.col("_before") + F.col("upto")
    return placed.select(
        *names, upto.alias("upto"), F.when(F.col("_found"), F.col("last")).otherwise(F.col("_held.last")).alias("last"), (upto - mark).alias("since"))


def together(*tables: DataFrame) -> DataFrame:
    """The union by name; a column that a table lacks is null there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
