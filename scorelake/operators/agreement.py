"""Agreement between raters, human against automatic scores, reference overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions.text import let, words
from scorelake.operators.blinding import hash_key
from scorelake.session import kept


def agreement(ratings: DataFrame, unit: str, category: str) -> DataFrame:
    """Fleiss kappa and Krippendorff alpha (nominal) from counts per unit and category.

    Units may have different numbers of ratings; units with a single one carry no pair.
    """
    cells = kept(ratings.where(F.col(unit).isNotNull() & F.col(category).isNotNull()).groupBy(
        F.col(unit).alias("_unit"), F.col(category).alias("_category")).agg(F.count(F.lit(1)).alias("_cell")))
    units = cells.groupBy("_unit").agg(F.sum("_cell").alias("_n"), F.sum(F.col("_cell") * F.col("_cell")).alias("_squares"))
    paired = units.where(F.col("_n") > 1)
    n, squares = F.col("_n"), F.col("_squares")
    observed = paired.agg(
        F.avg((squares - n) / (n * (n - 1))).alias("mean_agreement"), F.sum(n).alias("total"),
        (F.sum((n * n - squares) / (n - 1)) / F.sum(n)).alias("observed_gap"), F.count(F.lit(1)).alias("units"))
    totals = cells.join(paired.select("_unit"), "_unit", "left_semi").groupBy("_category").agg(F.sum("_cell").alias("_k"))
    k = F.col("_k")
    expected = totals.agg(
        (F.sum(k * k) / (F.sum(k) * F.sum(k))).alias("chance"),
        ((F.sum(k) * F.sum(k) - F.sum(k * k)) / (F.sum(k) * (F.sum(k) - 1))).alias("expected_gap"))
    chance, gap = expected.select("chance").scalar(), expected.select("expected_gap").scalar()
    return observed.select(
        "units", F.col("total").alias("ratings"),
        ((F.col("mean_agreement") - chance) / (1 - chance)).alias("fleiss_kappa"),
        (1 - F.col("observed_gap") / gap).alias("krippendorff_alpha"))


def discrepancies(
    human: DataFrame, automatic: DataFrame, key: str, human_score: str, automatic_score: str,
    sample: int = 50, above: float = 0.2, seed: str = "0",
) -> DataFrame:
    """Of a seeded sample of human scores, those far from the automatic score."""
    drawn = human.orderBy(hash_key(F.col(key).cast("string"), F.lit(seed)), key).limit(sample)
    gap = F.abs(F.col(human_score) - F.col(automatic_score))
    return drawn.join(automatic, key).withColumn("discrepancy", gap).where(F.col("discrepancy") > above)


def _tagged(tokens: Column, longest: int, said: int) -> Column:
    """All n-grams up to ``longest`` words with their size and side."""

    def grams(t: Column, n: int) -> Column:
        last = F.size(t) - n
        starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(
            F.array().cast("array<int>")
        )
        # single places are read in constant time, a slice inside a lambda is not
        return F.transform(starts, lambda i: F.struct(
            F.lit(n).alias("n"), F.concat_ws(" ", *[F.get(t, i + j) for j in range(n)]).alias("g"), F.lit(said).alias("said")))

    return let(tokens, lambda t: F.concat(*[grams(t, n) for n in range(1, longest + 1)]))


def reference_overlap(df: DataFrame, key: str, response: str, truth: str, longest: int = 4) -> DataFrame:
    """BLEU with clipped n-gram counts and ROUGE-1/2 of each response against its truth."""
    said, true = words(F.lower(response)), words(F.lower(truth))
    tagged = [_tagged(side, longest, s) for s, side in ((1, said), (0, true))]
    # the lengths are fixed before the explode, or they would be recomputed for every n-gram
    sized = df.select(
        key, F.size(said).alias("said_words"), F.size(true).alias("true_words"), F.concat(*tagged).alias("_grams")
    ).select(key, "said_words", "true_words", F.explode_outer("_grams").alias("x"))
    counted = sized.groupBy(key, "said_words", "true_words", F.col("x.n").alias("n"), F.col("x.g").alias("g")).agg(
        F.coalesce(F.sum("x.said"), F.lit(0)).alias("s"), F.coalesce(F.sum(1 - F.col("x.said")), F.lit(0)).alias("t"))

    def of(n: int, c: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("n") == n, c)), F.lit(0))

    match = F.least("s", "t")
    sums = counted.groupBy(key, "said_words", "true_words").agg(
        *[of(n, match).alias(f"m{n}") for n in range(1, longest + 1)],
        *[of(n, F.col("s")).alias(f"s{n}") for n in range(1, longest + 1)],
        *[of(n, F.col("t")).alias(f"t{n}") for n in (1, 2)])
    every = [F.col(f"m{n}") > 0 for n in range(1, longest + 1)]
    matched = every[0]
    for e in every[1:]:
        matched = matched & e
    logs = [F.log(F.col(f"m{n}") / F.col(f"s{n}")) for n in range(1, longest + 1)]
    short = F.least(F.lit(0.0), 1 - F.col("true_words") / F.col("said_words"))
    bleu = F.when(matched, F.exp(short + sum(logs[1:], logs[0]) / longest)).otherwise(0.0)

    def rouge(n: int) -> Column:
        both = F.col(f"s{n}") + F.col(f"t{n}")
        return F.when(both > 0, 2 * F.col(f"m{n}") / both).otherwise(0.0)

    return sums.select(key, bleu.alias("bleu"), rouge(1).alias("rouge_1"), rouge(2).alias("rouge_2"))
