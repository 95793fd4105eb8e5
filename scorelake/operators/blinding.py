"""Seeded sampling, blind labels and un-blinding.

Random order is the order of ``md5(id, seed)``: the same on every run and every retry.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.operators.ordering import row_positions


def hash_key(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", *parts))


def hash_number(*parts: Column | str) -> Column:
    """The first 32 bits of the hash as a non-negative long."""
    return F.conv(F.substring(hash_key(*parts), 1, 8), 16, 10).cast("long")


def hash_long(*parts: Column | str) -> Column:
    """The first 60 bits of the hash as a non-negative long."""
    return F.conv(F.substring(hash_key(*parts), 1, 15), 16, 10).cast("long")


def shuffled(items: Column, key: Column | str, salt: str = "") -> Column:
    """The array's items in hash order for this row."""
    tagged = F.transform(
        items, lambda x: F.struct(hash_key(key if isinstance(key, Column) else F.col(key), F.lit(salt), x).alias("h"), x.alias("x"))
    )
    return F.transform(F.array_sort(tagged), lambda s: s["x"])


def letters(n: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.char(F.lit(65) + i))


def blind_map(items: Column, key: Column | str, salt: str = "") -> Column:
    """Random bijection from letters A, B, ... to the items."""
    return F.map_from_arrays(letters(F.size(items)), shuffled(items, key, salt))


def sample_per_stratum(
    df: DataFrame, stratum: str, key: str, n: int, seed: str = "0", strict: bool = False
) -> DataFrame:
    """``n`` rows per stratum without replacement and their order in the session.

    The rank filter is applied before the shuffle too, so a hot stratum sends at most
    ``n`` rows per task.  With ``strict`` a stratum smaller than ``n`` is an error.
    """
    order = Window.partitionBy(stratum).orderBy(hash_key(F.col(key).cast("string"), F.lit(seed)), key)
    picked = df.withColumn("sample_order", F.row_number().over(order)).where(F.col("sample_order") <= n)
    if not strict:
        return picked
    sizes = picked.groupBy(stratum).agg(F.count(F.lit(1)).alias("_got"))
    checked = picked.join(sizes, stratum)
    enough = F.when(F.col("_got") >= n, F.col("sample_order")).otherwise(
        F.raise_error(F.concat(F.lit("not enough rows in "), F.col(stratum).cast("string")))
    )
    return checked.withColumn("sample_order", enough).drop("_got")


def sample_for_sessions(
    sessions: DataFrame, pool: DataFrame, session: str, stratum: str, key: str, n: int, seed: str = "0"
) -> DataFrame:
    """An own sample of ``n`` pool rows per stratum for every session.

    The pool is put in hash order once; a session then draws ``n`` distinct positions, every set
    of them being equally likely (each draw from one position more, a repeat becoming the new one),
    and takes them in a random order.  Rows are found by an equi-join on their position, so
    sessions and pool are never multiplied.
    """
    ordered = row_positions(
        pool.withColumn("_h", hash_number(F.col(key).cast("string"), F.lit(seed))), "_h", [stratum],
        "_pos", ties=[key],
    )
    sizes = pool.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    listed = sizes.agg(F.collect_list(F.struct(F.col(stratum), F.col("n"))))
    slots = sessions.withColumn("_s", F.explode(listed.scalar())).select(
        session, F.col(f"_s.{stratum}").alias(stratum), F.col("_s.n").alias("_n"), F.least(F.lit(n), F.col("_s.n")).alias("_take"))
    names = [F.col(session).cast("string"), F.col(stratum).cast("string")]

    def drawn(taken: Column, i: Column) -> Column:
        last = F.col("_n") - F.col("_take") + i
        at = hash_long(*names, i.cast("string"), F.lit(seed)) % (last + 1)
        return F.concat(taken, F.array(F.when(F.array_contains(taken, at), last).otherwise(at)))

    positions = F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.col("_take") - 1), F.array().cast("array<bigint>"), drawn)
    tagged = F.transform(positions, lambda p: F.struct(hash_long(*names, p.cast("string"), F.lit(seed), F.lit("order")).alias("h"), p.alias("p")))
    wanted = slots.select(session, stratum, F.posexplode(F.array_sort(tagged)).alias("_i", "_x")).select(
        session, stratum, (F.col("_i") + 1).alias("sample_order"), F.col("_x.p").alias("_pos"))
    return wanted.join(ordered.drop("_h"), [stratum, "_pos"]).drop("_pos")


def valid_ranking(ranks: str) -> Column:
    """Ranks are exactly 1..n, each once."""
    values = F.map_values(ranks)
    return (F.size(values) > 0) & (
        F.array_sort(values) == F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)))
    )


def label_of_rank(ranks: str, rank: int = 1) -> Column:
    first = F.map_keys(F.map_filter(ranks, lambda _, r: r == rank))
    return F.get(first, F.lit(0))


def item_of_label(label: Column, order: str) -> Column:
    return F.get(F.col(order), F.ascii(label) - 65)


def unblind(df: DataFrame, ranks: str, order: str, *keep: str) -> DataFrame:
    """One row per (submission, label): the item behind the label and its rank."""
    long = df.select(*keep, order, F.explode(ranks).alias("label", "rank"))
    return long.select(*keep, "label", item_of_label(F.col("label"), order).alias("provider"), "rank")


def chosen_item(label: str, mapping: str) -> Column:
    return F.try_element_at(F.col(mapping), F.col(label))
