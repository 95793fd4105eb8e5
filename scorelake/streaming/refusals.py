"""Rate limits of a whole log as joins: refusals are linked and followed by pointer doubling.

Every request between the end of a block and the next refusal is admitted, so a limiter's history is
a stretch of neighbouring requests, and a refusal decides the next one: the block ends with the first
request that comes late enough, and the next refusal is the first request after it that has as many
requests inside the window before it as the limit allows.  All these links come from as-of lookups in
one order (``operators.merging``), whatever the size of an identifier.  Which requests are refused is
then the set reached from each identifier's first link, found in as many rounds of joins as the
logarithm of the longest chain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.operators.merging import in_order, together
from scorelake.session import saved

MICROS = 1_000_000
#: Requests without a time count as made at one moment before all others.
NEVER = -(2**61)


def _numbered(requests: DataFrame) -> DataFrame:
    """who, us, request, ts and ``g``, the place in the order of (who, us, request)."""
    placed = in_order(requests.withColumn("weight", F.lit(1)), ["who", "us", "request"], "requests")
    return saved(placed.select("who", "us", "request", "ts", (F.col("upto") - 1).alias("g")), "requests")


def _first_at(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """Adds ``first`` to each question (who, us, g, ...): the place of the first request of ``who`` at or after ``us``; if there is
    none, the place after its last request."""
    elements = together(rows.select("who", "us", "g", F.lit(True).alias("_row"), F.lit(1).alias("weight")), questions.withColumn("weight", F.lit(0)))
    placed = in_order(elements, ["who", "us", F.col("_row").asc_nulls_first(), "g"], "first")
    return placed.where("_row IS NULL").drop("_row", "last", "since").withColumnRenamed("upto", "first")


def _crossings(rows: DataFrame, checks: Sequence) -> DataFrame:
    """(who, us, g, i): requests with at least as many requests inside window i before them as limit i allows."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c.limit).cast("bigint").alias("allowed"), F.lit(c.window).alias("window")) for i, c in enumerate(checks)]))
    asked = rows.select("who", "us", "g", each.alias("c")).select("who", (F.col("us") - F.col("c.window")).alias("us"), F.col("us").alias("own"), "g", "c.i", "c.allowed")
    found = _first_at(rows, asked)
    return saved(found.where(F.col("g") - F.col("first") >= F.col("allowed")).select("who", F.col("own").alias("us"), "g", "i"), "crossings")


def _ends(rows: DataFrame, crossings: DataFrame, block: int) -> DataFrame:
    """(who, g, own, free, later): own place of the first request at the same time, first one after the block, first one later than that."""
    asked = crossings.select("who", "us", "g").distinct().select("who", "g", F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), (F.col("us") + d).alias("us")) for k, d in enumerate((0, block, block + 1))])).alias("q")).select("who", "g", "q.k", "q.us")
    found = _first_at(rows, asked)
    pick = [F.max(F.when(F.col("k") == k, F.col("first"))).alias(name) for k, name in enumerate(("own", "free", "later"))]
    return saved(found.groupBy("who", "g").agg(*pick), "ends")


def _links(rows: DataFrame, crossings: DataFrame, ends: DataFrame, checks: Sequence, block: int) -> DataFrame:
    """(node, next): a node is a refusal (place and check) or, below zero, an identifier's start."""
    n = len(checks)
    whole = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c.limit).cast("bigint").alias("allowed"), F.lit(c.window).alias("window")) for i, c in enumerate(checks)]))
    starts = rows.groupBy("who").agg(F.min("g").alias("free")).select("who", (-F.col("free") - 1).alias("node"), "free", F.lit(0).alias("over"), F.lit(0).alias("equal"), F.lit(n).alias("f"))
    met = ends.select(F.col("who").alias("_w"), F.col("g").alias("_g"), "own", "free", "later")
    refusals = crossings.join(met, crossings["g"] == met["_g"]).select(
        "who", (F.col("g") * n + F.col("i")).alias("node"), "free", (F.col("later") - F.col("free")).alias("over"), (F.col("g") - F.col("own")).alias("equal"), F.col("i").alias("f"))
    nodes = saved(starts.unionByName(refusals), "nodes").select("*", whole.alias("c")).select("who", "node", "free", "over", "equal", "f", "c.i", "c.allowed", "c.window")
    # requests at the very end of the window still count when the block ends: those admitted at the refusal's own time,
    # the refused one among them if an earlier check had let it pass
    still = F.least("allowed", F.col("equal") + F.when(F.col("i") < F.col("f"), 1).otherwise(0))
    at_once = (F.col("window") == block) & (F.col("f") < n) & (still > 0) & (F.col("over") > F.col("allowed") - still)
    sooner = nodes.where(at_once).select("node", F.struct((F.col("free") + F.col("allowed") - still).alias("g"), "i").alias("next"))
    # the first crossing of each check that has the whole limit behind it since the block's end
    asked = nodes.select("who", "i", (F.col("free") + F.col("allowed")).alias("g"), "node", F.lit(0).alias("weight"))
    borders = rows.select("who").distinct().select("who", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), F.lit(True).alias("marked"), F.lit(0).alias("weight"))
    marks = crossings.select("who", "i", "g", F.col("g").alias("carry"), F.lit(True).alias("marked"), F.lit(0).alias("weight"))
    # downwards, so that the last mark seen is the next crossing; a border without a place comes first
    placed = in_order(together(asked, borders, marks), ["who", "i", F.col("g").desc_nulls_first(), F.col("node").asc_nulls_first()], "next")
    found = placed.where("node IS NOT NULL AND last IS NOT NULL").select("node", F.struct(F.col("last").alias("g"), "i").alias("next"))
    first = found.unionByName(sooner).groupBy("node").agg(F.min("next").alias("next"))
    return saved(first.select("node", (F.col("next.g") * n + F.col("next.i")).alias("next")), "links")


def reached(links: DataFrame, starts: DataFrame) -> DataFrame:
    """Nodes that the chains of ``links`` (node, next) from ``starts`` (node) visit, the starts included.

    Each round doubles the stride; then the strides, longest first, double the set of visited nodes.
    """
    strides = [links.select("node", "next")]
    while True:
        now = strides[-1]
        twice = saved(now.join(now.select(F.col("node").alias("next"), F.col("next").alias("_far")), "next").select("node", F.col("_far").alias("next")), "strides")
        if twice.isEmpty():
            break
        strides.append(twice)
    visited = starts.select("node")
    for stride in reversed(strides):
        visited = saved(visited.unionByName(visited.join(stride, "node").select(F.col("next").alias("node"))), "visited")
    return visited


def refusals(requests: DataFrame, checks: Sequence, block: int) -> tuple[DataFrame, DataFrame]:
    """The numbered requests, and (g, free) of those refused by a limit: up to the place ``free`` all are blocked.

    ``requests``: who, us, request, ts.  The block (microseconds) is no shorter than any window.
    """
    rows = _numbered(requests)
    crossings = _crossings(rows, checks)
    ends = _ends(rows, crossings, block)
    links = _links(rows, crossings, ends, checks, block)
    visited = reached(links, links.where("node < 0"))
    refused = visited.where("node >= 0").select(F.expr(f"node DIV {len(checks)}").alias("g"))
    return rows, refused.join(ends.select("g", "free"), "g")


def decided(requests: DataFrame, checks: Sequence, block_seconds: int) -> DataFrame:
    """who, request, ts, reason for every request."""
    rows, refused = refusals(requests, checks, block_seconds * MICROS)
    marks = refused.select("g", F.col("free").alias("carry"), F.lit(True).alias("marked"), F.lit(0).alias("weight"))
    placed = in_order(together(rows.withColumn("weight", F.lit(1)), marks), ["g", "weight"], "verdicts")
    refused_here = F.col("last").isNotNull() & (F.col("since") == 1)
    reason = F.when(refused_here, "limit").when(F.col("g") < F.col("last"), "blocked").otherwise("admitted")
    return placed.where("us IS NOT NULL").select("who", "request", "ts", reason.alias("reason"))
