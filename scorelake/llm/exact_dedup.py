"""Exact de-duplication that takes frequent texts out before the shuffle (DataFrame functions only).

A text is known by the SHA-256 of its normal form.  A frequent-items sketch (a Misra-Gries summary
with decrements by the median) names candidates; their true counts are then taken, and these at
most ``TOP`` verified digests travel to the tasks, where their rows are settled without a shuffle.
Only rows of rarer digests are shuffled, so no task gets a large group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelake.llm.common import keep_rows, saved, text_key, text_of

#: Frequent digests that are settled on the map side; this bounds what is broadcast to some 100 kB.
TOP = 1000
#: Counters of the sketch: a digest with over 1/4000 of the rows is always among its items.
COUNTERS = 16_384
#: Groups of tasks with a sketch each, so that no task merges the sketches of all.
LANES = 64

SPACES = r"[\x20\x09-\x0D]+"


def digests(docs: DataFrame) -> DataFrame:
    """One row per document: row (a number within this table), doc_id, text_key, text_sha256.

    Written to the shared folder: texts are read and hashed once, and row numbers stay.
    """
    normal = F.regexp_replace(text_of(), SPACES, " ")
    hashed = docs.select("doc_id", text_key().alias("text_key"), F.sha2(normal, 256).alias("text_sha256"))
    return saved(hashed.withColumn("row", F.monotonically_increasing_id()), "digests")


def frequent(base: DataFrame, top: int = TOP, counters: int = COUNTERS) -> DataFrame:
    """item (64 bits of a digest) of at most ``top`` candidates, by frequent-items sketches.

    Each lane is a share of the tasks with a sketch of its own, and what is frequent in all rows is
    as frequent in one lane at least.
    """
    lanes = base.groupBy((F.spark_partition_id() % LANES).alias("lane")).agg(
        F.expr(f"approx_top_k(xxhash64(text_sha256), {top}, {counters})").alias("found"))
    merged = lanes.select(F.explode("found").alias("found")).groupBy("found.item").agg(F.sum("found.count").alias("n"))
    return merged.orderBy(F.desc("n"), "item").limit(top).select("item")


def exact_groups(docs: DataFrame, top: int = TOP, counters: int = COUNTERS) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256, text_key.

    Texts are equal when they are identical after each run of ASCII white space became one space
    (nothing is trimmed); null counts as empty.  The row with the smallest doc_id stays; a null
    doc_id comes last, and of rows that repeat the smallest doc_id one stays.  An empty table
    gives no rows.  Columns other than doc_id and text are not read.
    """
    base = digests(docs)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    found = F.broadcast(frequent(base, top, counters))
    winners = (
        base.join(found, F.xxhash64("text_sha256") == F.col("item"), "left_semi")
        .groupBy("text_sha256").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
    )
    told = base.join(F.broadcast(winners), "text_sha256", "left")
    same = Window.partitionBy("text_sha256")
    rest = told.where("first IS NULL").drop("first", "group_size").select(
        "*", F.min(order).over(same).alias("first"), F.count(F.lit(1)).over(same).alias("group_size"))
    return told.where("first IS NOT NULL").select(rest.columns).unionByName(rest).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256", "text_key")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return keep_rows(docs, exact_groups(docs).where("kept"), one_of_each=True)
