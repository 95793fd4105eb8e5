"""Agreement, reference overlap, resampling and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.functions import text
from scorelake.operators import agreement as A
from scorelake.operators import quality as Q
from scorelake.operators import stats as S
from scorelake.operators.evallog import best_and_worst
from scorelake.plans import tails
from scorelake.plans.registry import query
from scorelake.plans.scoring import words_sql
from scorelake.plans.statistics import A_TEXT, ANOVA_P_SQL, MOMENTS_SQL, rounded, score_moments
from scorelake.plans.views import EVAL_SQL, SCORES_SQL, eval_log, scores, table
from scorelake.sources.writers import report_lines


@query("rater_agreement", """WITH c AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY 1, 2),
    u AS (SELECT user_id, sum(c) AS n, sum(c * c) AS sq FROM c GROUP BY 1 HAVING sum(c) > 1),
    o AS (SELECT count(*) AS units, sum(n) AS ratings, avg((sq - n) / (n * (n - 1))) AS p, sum((n * n - sq) / (n - 1)) / sum(n) AS gap FROM u),
    k AS (SELECT event_type, sum(c) AS k FROM c JOIN u USING (user_id) GROUP BY 1),
    e AS (SELECT sum(k * k) / pow(sum(k), 2) AS chance, (pow(sum(k), 2) - sum(k * k)) / (sum(k) * (sum(k) - 1)) AS gap FROM k)
    SELECT units, CAST(ratings AS BIGINT) AS ratings, round((p - chance) / (1 - chance), 8) AS fleiss_kappa,
    round(1 - o.gap / e.gap, 8) AS krippendorff_alpha FROM o, e""")
def rater_agreement(spark, d):
    return rounded(A.agreement(table(spark, d, "events"), "user_id", "event_type"), 8, "fleiss_kappa", "krippendorff_alpha")


QUALITY_SQL = f"""w AS (SELECT doc_id, length(text) AS n, {words_sql('text')} AS w FROM documents),
    auto AS (SELECT doc_id, (least(n / 1000, 1.0) + CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w) ELSE 0.0 END) / 2 AS score FROM w),
    drawn AS (SELECT doc_id, quality FROM labels ORDER BY md5(doc_id || '|0'), doc_id LIMIT 50)"""


@query("discrepancies", f"""WITH {QUALITY_SQL} SELECT doc_id, round(abs(quality - score), 8) AS discrepancy
    FROM drawn JOIN auto USING (doc_id) WHERE abs(quality - score) > 0.2""")
def discrepancies(spark, d):
    auto = table(spark, d, "documents").select("doc_id", text.context_quality("text").alias("score"))
    out = A.discrepancies(table(spark, d, "labels"), auto, "doc_id", "quality", "score")
    return out.select("doc_id", F.round("discrepancy", 8).alias("discrepancy"))


def gram_sql(n: int) -> str:
    return (f"SELECT id, {n} AS n, unnest(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i : i + {n - 1}], ' '))) AS g, said "
            f"FROM tok WHERE len(w) >= {n}")


OVERLAP_SQL = f"""{EVAL_SQL}, tok AS (SELECT id, {words_sql('lower(response)')} AS w, 1 AS said FROM eval_log
    UNION ALL SELECT id, {words_sql('lower(truth)')}, 0 FROM eval_log),
    size AS (SELECT id, sum(len(w)) FILTER (said = 1) AS ns, sum(len(w)) FILTER (said = 0) AS nt FROM tok GROUP BY 1),
    gram AS ({" UNION ALL ".join(gram_sql(n) for n in range(1, 5))}),
    cnt AS (SELECT id, n, g, sum(said) AS s, sum(1 - said) AS t FROM gram GROUP BY 1, 2, 3),
    sums AS (SELECT id, n, sum(least(s, t)) AS m, sum(s) AS s, sum(t) AS t FROM cnt GROUP BY 1, 2),
    f AS (SELECT z.id, ns, nt, {", ".join(f"coalesce(max({c}) FILTER (n = {n}), 0) AS {c}{n}" for n in range(1, 5) for c in "mst")}
        FROM size z LEFT JOIN sums USING (id) GROUP BY 1, 2, 3)"""


@query("reference_overlap", f"""WITH {OVERLAP_SQL} SELECT id, round(CASE WHEN m1 > 0 AND m2 > 0 AND m3 > 0 AND m4 > 0
    THEN exp(least(0.0, 1 - nt / ns) + (ln(m1 / s1) + ln(m2 / s2) + ln(m3 / s3) + ln(m4 / s4)) / 4) ELSE 0.0 END, 8) AS bleu,
    round(CASE WHEN s1 + t1 > 0 THEN 2 * m1 / (s1 + t1) ELSE 0.0 END, 8) AS rouge_1,
    round(CASE WHEN s2 + t2 > 0 THEN 2 * m2 / (s2 + t2) ELSE 0.0 END, 8) AS rouge_2 FROM f""")
def reference_overlap(spark, d):
    out = A.reference_overlap(eval_log(spark, d), "id", "response", "truth")
    return rounded(out, 8, "bleu", "rouge_1", "rouge_2")


REPLICATES = 400


@query("bootstrap_intervals", f"""WITH {SCORES_SQL}, b AS (SELECT provider, score, unnest(range({REPLICATES // S.DRAWS})) AS block, id FROM scores WHERE score IS NOT NULL AND provider IS NOT NULL),
    h AS (SELECT provider, score, block, md5(id || '-' || block) AS digest, unnest(range({S.DRAWS})) AS j FROM b),
    u AS (SELECT provider, score, block * {S.DRAWS} + j AS replicate, CAST('0x' || substr(digest, (1 + {S.DIGITS} * j)::INT, {S.DIGITS}) AS INT) AS u FROM h),
    w AS (SELECT provider, score, replicate, {' + '.join(f'CAST(u >= {x} AS INT)' for x in S.poisson_steps())} AS w FROM u),
    m AS (SELECT provider, replicate, sum(w * score) / nullif(sum(w), 0) AS m FROM w GROUP BY 1, 2)
    SELECT provider, round(avg(m), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high FROM m GROUP BY 1""")
def bootstrap_intervals(spark, d):
    out = S.bootstrap_intervals(scores(spark, d), "provider", "score", "id", REPLICATES)
    return rounded(out, 6, "mean", "ci_low", "ci_high")


@query("tukey_pairs", f"""WITH {MOMENTS_SQL}, w AS (SELECT count(*) AS k, sum(n) - count(*) AS df, sum((n - 1) * var) / (sum(n) - count(*)) AS v FROM m),
    x AS (SELECT a.grp AS a_grp, b.grp AS b_grp, a.mean - b.mean AS gap, abs(a.mean - b.mean) / sqrt(v / 2 * (1 / a.n + 1 / b.n)) AS q, k, df
        FROM m a JOIN m b ON a.grp < b.grp, w)
    SELECT a_grp, b_grp, round(gap, 6) AS difference, round(q, 6) AS q, CAST(k AS DOUBLE) AS k, CAST(df AS DOUBLE) AS df,
    round({tails.p_studentized_range("q", "k", "df")}, 6) AS p_value FROM x""")
def tukey_pairs(spark, d):
    return rounded(S.tukey_pairs(score_moments(spark, d)), 6, "difference", "q", "p_value")


REPORT_SQL = f"""{MOMENTS_SQL}, {ANOVA_P_SQL}, q AS (SELECT *, {tails.t_quantile(0.975, "(n - 1)")} * sqrt(var / n) AS h FROM m),
    r AS (SELECT *, row_number() OVER (ORDER BY mean DESC, grp) AS rank FROM q),
    o AS (SELECT (SELECT count(*) FROM scores) AS n, (SELECT avg(score) FROM scores) AS mean, (SELECT avg(response_time_ms) FROM eval_log) AS ms,
        (SELECT grp FROM m ORDER BY mean DESC, grp LIMIT 1) AS best, (SELECT grp FROM m ORDER BY mean, grp LIMIT 1) AS worst),
    parts AS (SELECT 0 AS part, 0 AS place, ['EVALUATION SUMMARY REPORT', repeat('=', 50), '', 'Evaluation ID: scores', 'Total Evaluations: ' || n, '',
        'PROVIDER RANKINGS', repeat('-', 20)] AS lines FROM o
    UNION ALL SELECT 1, rank, [grp || ':', '  Rank: ' || rank, format('  Mean Score: {{:.4f}}', mean), format('  Std Dev: {{:.4f}}', sqrt(var)),
        format('  Confidence Interval: ({{:.4f}}, {{:.4f}})', mean - h, mean + h), ''] FROM r
    UNION ALL SELECT 2, 0, ['STATISTICAL SIGNIFICANCE', repeat('-', 20), 'ANOVA Result: ' || {A_TEXT}, format('Effect Size: {{:.4f}}', ssb / (ssb + ssw)), ''] FROM ap
    UNION ALL SELECT 3, 0, ['OVERALL PERFORMANCE', repeat('-', 20), 'Best Provider: ' || best, 'Worst Provider: ' || worst,
        format('Average Overall Score: {{:.4f}}', mean), format('Average Response Time: {{:.2f}}ms', ms)] FROM o)"""


@query("evaluation_report", f"""WITH {EVAL_SQL}, {REPORT_SQL} SELECT part, place, generate_subscripts(lines, 1) - 1 AS line, unnest(lines) AS text FROM parts""",
       part="INTEGER", place="INTEGER", line="INTEGER")
def evaluation_report(spark, d):
    """The text report of one evaluation over the score table, as ordered lines."""
    rows = scores(spark, d)
    m = S.moments(rows, "provider", "score")
    ranked = S.rank_groups(S.with_interval(m)).withColumn("std", F.sqrt("var")).withColumnRenamed("grp", "provider")
    ends = best_and_worst(m, "grp", "mean")
    time = eval_log(spark, d).agg(F.avg("response_time_ms"))
    totals = rows.agg(F.count(F.lit(1)).alias("evaluations"), F.avg("score").alias("avg_overall")).withColumn("avg_time_ms", time.scalar())
    overall = totals.withColumn("best", ends.select("best").scalar()).withColumn("worst", ends.select("worst").scalar())
    return report_lines("scores", ranked, S.anova_p(S.anova(m)), overall)


@query("profile_by_source", """SELECT source, 'n_chars' AS "column", count(*) AS count, round(avg(n_chars), 6) AS mean,
    round(stddev_samp(n_chars), 6) AS std, CAST(min(n_chars) AS DOUBLE) AS min, CAST(max(n_chars) AS DOUBLE) AS max,
    quantile_cont(n_chars, 0.25) AS q25, quantile_cont(n_chars, 0.5) AS q50, quantile_cont(n_chars, 0.75) AS q75 FROM documents GROUP BY 1""")
def profile_by_source(spark, d):
    out = Q.numeric_profile(table(spark, d, "documents"), ["n_chars"], "source")
    return rounded(out, 6, "mean", "std")


@query("categories_by_source", """SELECT source, 'lang' AS "column", lang AS value, count(*) AS n,
    row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS place,
    count(*) OVER (PARTITION BY source) AS n_distinct FROM documents GROUP BY source, lang QUALIFY place <= 5""", place="INTEGER")
def categories_by_source(spark, d):
    return Q.categorical_profile(table(spark, d, "documents"), ["lang"], "source")


@query("distinct_domains", "SELECT DISTINCT source AS domain, upper(source) AS shown FROM documents")
def distinct_domains(spark, d):
    sources = table(spark, d, "documents").select(F.col("source").alias("domain")).distinct()
    return sources.withColumn("shown", F.upper("domain"))


@query("domain_documents", """SELECT lang, count(*) AS n, count(*) FILTER (contains(lower(text), 'the')) AS with_word FROM documents GROUP BY 1""")
def domain_documents(spark, d):
    found = F.contains(F.lower("text"), F.lit("the"))
    return table(spark, d, "documents").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(found).alias("with_word"))
