"""The trie of all conversations' turns, and subtree totals by parallel tree contraction.

1. Turns become digests, and Spark sorts them by range, so that a very long conversation is cut over
   many tasks.  A turn's key is the exclusive or of the hashes of all turns up to it, each hashed with
   its depth: running values inside a task, shifted by the values of the tasks before.
2. Turns with equal keys are one node; its parent's key is its own without its last turn.
3. Rounds of joins contract the tree.  Rake: leaves are added to their parents and leave.  Compress:
   of the chains of nodes with one remaining child, an independent set is spliced out, odd depths
   first, so that a chain halves each round.  Backwards, each spliced node's total is what it held plus
   its child's total.  Rounds grow with the logarithm of the tree's size, whatever its shape.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.llm.common import saved, shuffle_width

#: Conversations whose id agrees but for the rest modulo this share the first turns of the one with rest 0.
FAMILY = 20
#: Fewer than this many first turns are shared.
SHARED = 4
#: Ids joined into one string before a node's digest is taken.
IDS = 4096
NO_IDS = hashlib.sha256(b"").hexdigest()
_ROOT = 0


def _turns(conversations: DataFrame) -> DataFrame:
    """One small row per turn: digest of role and text, number of words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return saved(conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words")), "turns")


def _sorted(turns: DataFrame) -> DataFrame:
    """The turns in order: ``part`` is the range, ``at`` grows by one inside it.

    Ranges are cut over all columns and the row's place in its file, so neither one conversation nor
    repeats of one turn can fill a range.
    """
    order = ["conv_id", F.col("turn").asc_nulls_first(), "digest", "salt"]
    salted = turns.withColumn("salt", F.xxhash64("_metadata.file_name", "_metadata.row_index"))
    dealt = salted.repartitionByRange(shuffle_width(turns.sparkSession), *order).sortWithinPartitions(*order)
    placed = dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33))
    return saved(placed.select("part", "at", "conv_id", "digest", "words"), "ordered")


def _shared_turns(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % SHARED


def _key(number: int) -> Column:
    """Hash of a turn at its depth; two of them tell sequences apart."""
    return F.xxhash64(F.lit(number), F.col("depth"), F.col("digest"))


def _paths(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, one, two, up_one, up_two, words, ends) of all turns of the rebuilt conversations, and
    (conv_id, length) of all conversations; one and two are the key up to the turn, up_* the key before it."""
    ordered = _sorted(_turns(conversations))
    spans = ordered.groupBy("part", "conv_id").agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("conv_id")
    before = F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    spans = saved(spans.select("*", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(own).alias("turns")), "spans")

    bases = spans.where(f"conv_id % {FAMILY} = 0")
    near = ordered.where(f"conv_id % {FAMILY} = 0").join(bases.where(F.col("before") < SHARED - 1).select("part", "conv_id", "low", "before"), ["part", "conv_id"])
    depth = (F.col("at") - F.col("low") + F.col("before") + 1).alias("depth")
    near = near.select(F.col("conv_id").alias("base"), depth, "digest", "words").where(F.col("depth") < SHARED)
    near = near.select("base", "depth", "words", _key(1).alias("last_one"), _key(2).alias("last_two"))
    upto = Window.partitionBy("base").orderBy("depth")  # at most three rows each
    heads = saved(near.select("*", *[F.bit_xor(f"last_{k}").over(upto).alias(k) for k in ("one", "two")]), "heads")

    convs = spans.where("before = 0").select(
        "conv_id", "turns", _shared_turns(F.col("conv_id")).alias("shared"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    base_turns = bases.where("before = 0").select(F.col("conv_id").alias("base"), F.col("turns").alias("base_turns"))
    taken = F.least("shared", F.coalesce("base_turns", F.lit(0)))
    convs = convs.join(base_turns, "base", "left").withColumn("taken", taken)
    convs = saved(convs.join(heads.select("base", F.col("depth").alias("taken"), "one", "two"), ["base", "taken"], "left").select(
        "conv_id", "base", "shared", "taken", (F.col("taken") + F.greatest(F.col("turns") - F.col("shared"), F.lit(0))).alias("length"),
        *[F.coalesce(k, F.lit(0)).alias(k) for k in ("one", "two")]), "rebuilt")

    first = convs.select("conv_id", "base", "taken", "length").where("taken > 0").join(heads, "base").where("depth <= taken")
    first = first.select("conv_id", "depth", "one", "two", "last_one", "last_two", "words", (F.col("depth") == F.col("length")).alias("ends"))

    where = spans.select("part", "conv_id", "low", "before", "n").join(convs, "conv_id")
    rest = ordered.join(where, ["part", "conv_id"]).withColumn("place", F.col("at") - F.col("low") + F.col("before")).where("place >= shared")
    rest = rest.withColumn("depth", F.col("place") - F.col("shared") + F.col("taken") + 1)
    rest = rest.select("*", _key(1).alias("last_one"), _key(2).alias("last_two"))
    running = Window.partitionBy("part", "conv_id").orderBy("at")
    rest = saved(rest.select(
        "part", "conv_id", "depth", "words", "last_one", "last_two", (F.col("depth") == F.col("length")).alias("ends"),
        (F.col("at") == F.col("low") + F.col("n") - 1).alias("final"),
        *[F.bit_xor(f"last_{k}").over(running).alias(f"run_{k}") for k in ("one", "two")]), "running")
    # a conversation that crosses ranges goes on with the value of the ranges before; at most two per range do
    across = spans.groupBy("conv_id").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1").select("conv_id")
    ends = rest.where("final").join(across, "conv_id", "left_semi")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("part", "conv_id", *[F.bit_xor(f"run_{k}").over(earlier).alias(f"from_{k}") for k in ("one", "two")])
    rest = rest.join(ends, ["part", "conv_id"], "left").join(convs.select("conv_id", "one", "two"), "conv_id")
    whole = [F.expr(f"run_{k} ^ coalesce(from_{k}, 0L) ^ {k}").alias(k) for k in ("one", "two")]
    rest = rest.select("conv_id", "depth", *whole, "last_one", "last_two", "words", "ends")
    paths = first.unionByName(rest).select(
        "conv_id", "depth", "one", "two", F.expr("one ^ last_one").alias("up_one"), F.expr("two ^ last_two").alias("up_two"), "words", "ends")
    return saved(paths, "paths"), convs.select("conv_id", "length")


def _end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the sorted ids of each key (depth, one, two).

    Ids meet as strings of up to ``IDS`` of them, and a task streams through the strings of a key: the
    digest of one list cannot be taken in parts, but nothing is held.
    """
    keys = ["depth", "one", "two"]
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    strings = ends.groupBy(*keys, F.floor(F.col("conv_id") / IDS).alias("stretch")).agg(ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            out = []
            for *here, ids in zip(*(batch.column(c).to_pylist() for c in (*keys, "ids"))):
                if here == key:
                    digest.update(b"," + ids.encode())
                    continue
                if key:
                    out.append((*key, digest.hexdigest()))
                key, digest = here, hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip([*keys, "ends_sha256"], x)) for x in out], schema)
        if key:
            yield pa.RecordBatch.from_pylist([dict(zip([*keys, "ends_sha256"], (*key, digest.hexdigest())))], schema)

    schema = pa.schema([*[(k, pa.int64()) for k in keys], ("ends_sha256", pa.string())])
    dealt = strings.repartition(shuffle_width(ends.sparkSession), *keys).sortWithinPartitions(*keys, "stretch")
    return dealt.mapInArrow(run, "depth bigint, one bigint, two bigint, ends_sha256 string")


def subtree_totals(nodes: DataFrame, values: list[str]) -> DataFrame:
    """id and, for each of ``values``, its sum over the node's subtree, the node included.

    ``nodes``: id (unique), parent (null at roots), depth (any number that grows downwards) and the
    values; any forest, in any shape.  Empty tables give no rows.
    """
    live, raked, spliced = nodes.select("id", "parent", "depth", *values), [], []
    while True:
        kids = live.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("kids"))
        here = saved(live.join(kids, "id", "left").withColumn("kids", F.coalesce("kids", F.lit(0))), "live")
        raked.append(here.where("kids = 0").select("id", *values))
        inner = here.where("kids > 0").drop("kids")
        if inner.isEmpty():
            break
        # rake: what the leaves hold goes to their parents
        up = here.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(
            *[F.sum(F.when(F.col("kids") == 0, F.col(v)).otherwise(0)).alias(f"more_{v}") for v in values],
            F.count_if(F.col("kids") > 0).alias("rest"), F.min(F.when(F.col("kids") > 0, F.struct("id"))).getField("id").alias("only"))
        left = saved(inner.join(up, "id").select("id", "parent", "depth", *[(F.col(v) + F.col(f"more_{v}")).alias(v) for v in values], "rest", "only"), "raked")
        # compress: a chain node goes if it comes before its neighbours in the chain; odd depths first, then odd halves, ...
        turn = F.expr("depth & -depth").alias("ruler")
        order = F.struct(turn, F.xxhash64("id", F.lit(len(spliced))).alias("dice"), "id")
        chain = left.where("rest = 1 AND parent IS NOT NULL").withColumn("order", order)
        asked = chain.select(F.col("parent").alias("id"), "order").unionByName(chain.select(F.col("only").alias("id"), "order"))
        best = asked.groupBy("id").agg(F.min("order").alias("best"))
        out = saved(chain.join(best, "id", "left").where("best IS NULL OR order < best").select("id", "parent", "only", *values), "spliced")
        spliced.append(out)
        # its child hangs on its parent, and its parent takes what it held
        down = out.select(F.col("only").alias("id"), F.col("parent").alias("new_parent"), *[F.lit(0).cast("bigint").alias(f"more_{v}") for v in values])
        upward = out.select(F.col("parent").alias("id"), F.lit(None).cast("bigint").alias("new_parent"), *[F.col(v).alias(f"more_{v}") for v in values])
        moves = down.unionByName(upward).groupBy("id").agg(F.max("new_parent").alias("new_parent"), *[F.sum(f"more_{v}").alias(f"more_{v}") for v in values])
        live = left.join(out.select("id"), "id", "left_anti").join(moves, "id", "left").select(
            "id", F.coalesce("new_parent", "parent").alias("parent"), "depth",
            *[(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values])
        # written as ``here`` of the next round, and as ``kids`` reads it twice, in the shared folder before that
        live = saved(live, "spliced_out")

    known = [raked.pop()]
    while spliced:
        total = reduce(DataFrame.unionByName, known).select(F.col("id").alias("only"), *[F.col(v).alias(f"more_{v}") for v in values])
        found = spliced.pop().join(total, "only").select("id", *[(F.col(v) + F.col(f"more_{v}")).alias(v) for v in values])
        known += [saved(found, "expanded"), raked.pop()]
    return reduce(DataFrame.unionByName, known)


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by ``turn``, missing ones first, ties by the digest of role and text.  A missing
    role or text is empty; rows without conv_id belong to no conversation; rows that repeat a turn are
    turns of their own.  Other columns are not read.  An empty table has no nodes, not even a root.
    """
    paths, convs = _paths(conversations)
    total = convs.agg(F.min("conv_id"), F.count(F.lit(1))).first()
    keys = ["depth", "one", "two"]
    named = saved(paths.groupBy(*keys).agg(
        F.min("conv_id").alias("conv_id"), F.min("up_one").alias("up_one"), F.min("up_two").alias("up_two"),
        F.min("words").alias("words"), F.count(F.lit(1)).alias("n_convs")), "named").withColumn("id", F.monotonically_increasing_id() + 1)
    named = saved(named, "nodes")
    low = named.where("depth = 1").select("*", F.lit(_ROOT).cast("bigint").alias("parent"), F.lit(total[0]).cast("bigint").alias("parent_conv_id"))
    up = named.select((F.col("depth") + 1).alias("depth"), F.col("one").alias("up_one"), F.col("two").alias("up_two"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    deep = named.where("depth > 1").join(up, ["depth", "up_one", "up_two"])
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        F.lit(_ROOT).cast("bigint").alias("id"), F.lit(None).cast("bigint").alias("parent"), F.lit(None).cast("bigint").alias("parent_conv_id"),
        F.lit(0).cast("bigint").alias("depth"), *[F.lit(0).cast("bigint").alias(k) for k in ("one", "two", "words")], "conv_id", "n_convs")
    nodes = low.unionByName(deep).drop("up_one", "up_two").unionByName(root)
    nodes = saved(nodes.withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("words")), "linked")
    kids = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = saved(nodes.join(kids, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumn("n_leaves", (F.col("n_children") == 0).cast("bigint")), "tree")
    sums = subtree_totals(nodes, ["n_leaves", "saved_tokens"])
    ended = paths.where("ends").select(*keys, "conv_id").unionByName(
        convs.where("length = 0").select(*[F.lit(0).cast("bigint").alias(k) for k in keys], "conv_id"))
    digests = saved(_end_digests(ended), "digests")
    return nodes.drop("n_leaves", "saved_tokens").join(sums, "id").join(digests, keys, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256"))
