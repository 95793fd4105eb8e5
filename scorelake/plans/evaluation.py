"""Evaluation-log queries: provider roll-ups, comparisons, work plans, joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.functions import text
from scorelake.operators import evallog as E
from scorelake.operators import joins as J
from scorelake.plans.registry import query
from scorelake.plans.scoring import EFFICIENCY_SQL, FACT_SQL, sql_list, words_sql
from scorelake.plans.statistics import rounded
from scorelake.plans.views import EVAL_SQL, HEALTH_SQL, eval_log, health, table


def efficient_log(spark, d):
    return eval_log(spark, d).withColumns({
        "token_efficiency": text.token_efficiency("response", "tokens_used", "query"),
        "time_efficiency": text.time_efficiency("response_time_ms", F.length("response")),
    })


@query("provider_summary", f"""WITH {EVAL_SQL}, {EFFICIENCY_SQL}, j AS (SELECT * FROM eval_log JOIN eff USING (id))
    SELECT coalesce(provider, '(overall)') AS provider, count(*) AS total_evaluations,
    round(avg(time_efficiency), 6) AS avg_overall, round(stddev_pop(time_efficiency), 6) AS std_overall,
    round(min(time_efficiency), 6) AS min_overall, round(max(time_efficiency), 6) AS max_overall,
    round(avg(token_efficiency), 6) AS avg_token_efficiency, round(avg(response_time_ms), 4) AS avg_time_ms
    FROM j GROUP BY ROLLUP (provider)""")
def provider_summary(spark, d):
    out = E.provider_summary(efficient_log(spark, d), "provider", "time_efficiency",
                             {"avg_token_efficiency": "token_efficiency", "avg_time_ms": "response_time_ms"})
    out = rounded(out, 6, "avg_overall", "std_overall", "min_overall", "max_overall", "avg_token_efficiency")
    return out.withColumn("avg_time_ms", F.round("avg_time_ms", 4))


@query("best_and_worst", f"""WITH {EVAL_SQL}, {EFFICIENCY_SQL}, m AS (SELECT provider, avg(token_efficiency) AS v
    FROM eval_log JOIN eff USING (id) GROUP BY 1)
    SELECT max_by(provider, v) AS best, min_by(provider, v) AS worst FROM m""")
def best_and_worst(spark, d):
    means = efficient_log(spark, d).groupBy("provider").agg(F.avg("token_efficiency").alias("v"))
    return E.best_and_worst(means, "provider", "v")


@query("compare_by_question", f"""WITH {EVAL_SQL}, {FACT_SQL}, s AS (SELECT e.question_id, e.model,
    CASE WHEN n_shared > 0 THEN 2 * n_shared / (n_said + n_known) ELSE 0.0 END AS v
    FROM eval_log e JOIN f1 ON e.id = f1.id WHERE truth IS NOT NULL)
    SELECT question_id, count(*) AS n_responses, round(avg(v), 8) AS avg_accuracy, round(min(v), 8) AS min_accuracy,
    round(max(v), 8) AS max_accuracy, arg_min(model, (-v, model)) AS best_provider,
    arg_min(model, (v, model)) AS worst_provider, 1.0::DOUBLE AS truth_coverage, 0.4::DOUBLE AS response_coverage,
    0.6::DOUBLE AS coverage_gap FROM s GROUP BY 1""")
def compare_by_question(spark, d):
    rows = eval_log(spark, d).where(F.col("truth").isNotNull())
    out = E.compare_by_question(rows.withColumn("v", text.fact_f1("response", "truth")), "question_id", "model", "v")
    return rounded(out, 8, "avg_accuracy", "min_accuracy", "max_accuracy")


@query("grouping_sets_counts", """SELECT CASE WHEN grouping(source) = 0 THEN 'source' WHEN grouping(lang) = 0 THEN 'lang'
    ELSE 'total' END AS dimension, coalesce(source, lang) AS value, count(*) AS n,
    round(avg(length(text)), 4) AS avg_length FROM documents GROUP BY GROUPING SETS ((source), (lang), ())""")
def grouping_sets_counts(spark, d):
    out = E.counts_by_each(table(spark, d, "documents"), "source", "lang", length="text")
    return out.withColumn("avg_length", F.round("avg_length", 4))


@query("response_metrics", f"""WITH {EVAL_SQL}, w AS (SELECT provider, response_time_ms AS ms,
    len({words_sql('response')}) AS n FROM eval_log)
    SELECT coalesce(provider, '(overall)') AS provider, count(*) AS responses, round(avg(ms), 4) AS mean_latency,
    min(ms) AS min_latency, max(ms) AS max_latency, round(avg(n), 6) AS mean_words, min(n) AS min_words,
    max(n) AS max_words FROM w GROUP BY ROLLUP (provider)""", min_words="INTEGER", max_words="INTEGER")
def response_metrics(spark, d):
    rows = eval_log(spark, d).withColumn("n", text.word_count("response"))
    return E.per_group_and_overall(rows, "provider", [
        F.count(F.lit(1)).alias("responses"), F.round(F.avg("response_time_ms"), 4).alias("mean_latency"),
        F.min("response_time_ms").alias("min_latency"), F.max("response_time_ms").alias("max_latency"),
        F.round(F.avg("n"), 6).alias("mean_words"), F.min("n").alias("min_words"), F.max("n").alias("max_words"),
    ])


@query("corpus_totals", f"""WITH {EVAL_SQL} SELECT count(*) AS responses, count(DISTINCT question_id) AS questions,
    count(DISTINCT provider) AS providers, count(DISTINCT model) AS models FROM eval_log""")
def corpus_totals(spark, d):
    rows = eval_log(spark, d)
    return rows.agg(
        F.count(F.lit(1)).alias("responses"), F.countDistinct("question_id").alias("questions"),
        F.countDistinct("provider").alias("providers"), F.countDistinct("model").alias("models"),
    )


@query("performance_trend", f"""WITH {HEALTH_SQL} SELECT provider, CAST(ts AS DATE)::VARCHAR AS day, count(*) AS n,
    round(avg(latency), 6) AS mean_latency FROM health WHERE status = 'ok' GROUP BY 1, 2""")
def performance_trend(spark, d):
    rows = health(spark, d).where(F.col("status") == "ok")
    return rows.groupBy("provider", F.to_date("ts").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("latency"), 6).alias("mean_latency"))


@query("run_rollup", f"""WITH {HEALTH_SQL} SELECT provider, count(*) AS runs, count(*) FILTER (status = 'ok') AS ok_runs,
    count(*) FILTER (status <> 'ok') AS failed_runs, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_run,
    strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_run, round(avg(coalesce(tokens_used, 0)), 6) AS avg_remaining
    FROM health GROUP BY 1""")
def run_rollup(spark, d):
    ok, stamp = F.col("status") == "ok", "yyyy-MM-dd HH:mm:ss"
    return health(spark, d).groupBy("provider").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(ok).alias("ok_runs"), F.count_if(~ok).alias("failed_runs"),
        F.date_format(F.min("ts"), stamp).alias("first_run"), F.date_format(F.max("ts"), stamp).alias("last_run"),
        F.round(F.avg(F.coalesce("tokens_used", F.lit(0))), 6).alias("avg_remaining"),
    )


@query("work_plan", """WITH m AS (SELECT n_nationkey AS model, n_regionkey AS provider FROM nation
        WHERE n_nationkey IN (SELECT s_nationkey FROM supplier))
    SELECT item_id AS question_id, provider, model FROM benchmark, m""")
def work_plan(spark, d):
    questions = table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"))
    models = table(spark, d, "nation").select(
        F.col("n_nationkey").alias("model"), F.col("n_regionkey").alias("provider"))
    listed = table(spark, d, "supplier").select(F.col("s_nationkey").alias("model"))
    return J.work_plan(questions, models, only_models=listed).select("question_id", "provider", "model")


META_SQL = """meta AS (SELECT 'provider_' || (s_suppkey % 4) AS provider, 'model_' || (s_suppkey % 5) AS model,
    min(s_name) AS family, count(*) * 1024 AS token_limit,
    CASE WHEN min(s_suppkey) % 2 = 0 THEN ['fastest', 'most concise'] ELSE ['most accurate'] END AS tags
    FROM supplier GROUP BY 1, 2)"""


def model_metadata(spark, d):
    even = F.min("s_suppkey") % 2 == 0
    return table(spark, d, "supplier").groupBy(
        F.concat(F.lit("provider_"), F.col("s_suppkey") % 4).alias("provider"),
        F.concat(F.lit("model_"), F.col("s_suppkey") % 5).alias("model"),
    ).agg(
        F.min("s_name").alias("family"), (F.count(F.lit(1)) * 1024).alias("token_limit"),
        F.when(even, F.array(F.lit("fastest"), F.lit("most concise"))).otherwise(F.array(F.lit("most accurate"))).alias("tags"),
    )


@query("enrich_metadata", f"""WITH {HEALTH_SQL}, {META_SQL} SELECT id, provider, model, family, token_limit,
    array_to_string(coalesce(tags, []), '|') AS tags FROM health LEFT JOIN meta USING (provider, model)""")
def enrich_metadata(spark, d):
    log = health(spark, d).select("id", "provider", "model")
    out = J.enrich(log, model_metadata(spark, d), ["provider", "model"])
    return out.withColumn("tags", F.concat_ws("|", "tags"))


@query("models_with_tag", f"""WITH {META_SQL} SELECT provider, model, family FROM meta
    WHERE list_contains(tags, 'fastest')""")
def models_with_tag(spark, d):
    return J.with_tag(model_metadata(spark, d), "fastest").select("provider", "model", "family")


@query("truth_attach", f"""WITH {EVAL_SQL}, t AS (SELECT doc_id AS question_id, quality FROM labels)
    SELECT id, e.question_id, t.question_id IS NOT NULL AS has_truth,
    CASE WHEN t.question_id IS NOT NULL THEN response_time_ms ELSE 0.0 END AS score
    FROM eval_log e LEFT JOIN t ON e.question_id = t.question_id""", score="DOUBLE")
def truth_attach(spark, d):
    truth = table(spark, d, "labels").select(F.col("doc_id").alias("question_id"), "quality")
    rows = eval_log(spark, d).select("id", "question_id", F.col("response_time_ms").alias("score"))
    return J.attach_truth(rows, truth, "question_id", ["score"]).select("id", "question_id", "has_truth", "score")


@query("remaining_work", """SELECT c_custkey AS user_id, c_mktsegment AS domain FROM customer
    WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def remaining_work(spark, d):
    assigned = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("domain"))
    done = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("user_id"))
    return J.remaining_work(assigned, done, ["user_id"])


EMAIL_SQL = """reg AS (SELECT c_custkey, upper(replace(c_name, ' ', '.')) || '@EXAMPLE.ORG' AS email FROM customer),
    sub AS (SELECT DISTINCT lower(replace(c_name, ' ', '.')) || '@example.org' AS email FROM customer
        JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 300000)"""


def registrations(spark, d):
    customer, orders = table(spark, d, "customer"), table(spark, d, "orders")
    name = F.replace("c_name", F.lit(" "), F.lit("."))
    registered = customer.select("c_custkey", F.concat(F.upper(name), F.lit("@EXAMPLE.ORG")).alias("email"))
    big = orders.where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    submitted = customer.join(big, "c_custkey", "left_semi").select(
        F.concat(F.lower(name), F.lit("@example.org")).alias("email"))
    return registered, submitted


@query("eligible_users", f"""WITH {EMAIL_SQL} SELECT c_custkey, email, FALSE AS submitted FROM reg
    WHERE lower(email) NOT IN (SELECT email FROM sub)
    UNION ALL SELECT c_custkey, email, TRUE FROM reg WHERE lower(email) IN (SELECT email FROM sub)""")
def eligible_users(spark, d):
    registered, submitted = registrations(spark, d)
    open_users = J.can_continue(registered, submitted).withColumn("submitted", F.lit(False))
    done = J.already_submitted(registered, submitted).withColumn("submitted", F.lit(True))
    return open_users.unionByName(done)


GENERATION_SQL = """gen AS (SELECT doc_id, doc_id // 6 AS q_idx, CASE (doc_id // 6) % 3 WHEN 0 THEN 'retail' WHEN 1 THEN 'finance'
    ELSE 'healthcare' END AS domain, 'model_' || (doc_id % 6) AS model, n_chars < 400 AS has_error,
    1 + n_chars % 3 AS attempts, n_chars / 1000 AS latency, text AS response FROM documents)"""
EXPECTED_MODELS = 6


def generation(spark, d):
    """Responses of six models to each question; short ones count as failed."""
    q = F.floor(F.col("doc_id") / 6)
    domain = F.when(q % 3 == 0, "retail").when(q % 3 == 1, "finance").otherwise("healthcare")
    return table(spark, d, "documents").select(
        "doc_id", q.alias("q_idx"), domain.alias("domain"),
        F.concat(F.lit("model_"), F.col("doc_id") % 6).alias("model"),
        (F.col("n_chars") < 400).alias("has_error"), (1 + F.col("n_chars") % 3).alias("attempts"),
        (F.col("n_chars") / 1000).alias("latency"), F.col("text").alias("response"),
    )


QUESTION = ["domain", "q_idx"]
STATUS_SQL = f"""{GENERATION_SQL}, st AS (SELECT domain, q_idx, count(*) FILTER (NOT has_error) AS successful,
    count(*) AS total, count(*) FILTER (NOT has_error) = 6 AS fully_answered,
    count(*) FILTER (NOT has_error) < 6 AS needs_retry FROM gen GROUP BY 1, 2)"""


@query("question_completion", f"WITH {STATUS_SQL} SELECT * FROM st")
def question_completion(spark, d):
    return E.question_completion(generation(spark, d), QUESTION, F.col("has_error"), EXPECTED_MODELS)


@query("retry_plan", f"""WITH {STATUS_SQL} SELECT doc_id, g.domain, g.q_idx, model FROM gen g JOIN st USING (domain, q_idx)
    WHERE has_error AND needs_retry""")
def retry_plan(spark, d):
    rows = generation(spark, d)
    status = E.question_completion(rows, QUESTION, F.col("has_error"), EXPECTED_MODELS)
    failed = rows.where("has_error").select("doc_id", *QUESTION, "model")
    return J.retry_plan(failed, status, QUESTION).select("doc_id", "domain", "q_idx", "model")


@query("patch_recovered", f"""WITH {GENERATION_SQL}, rec AS (SELECT g.domain, g.q_idx, g.model, upper(response) AS response, FALSE AS has_error
    FROM gen g JOIN labels l ON g.doc_id = l.doc_id WHERE g.has_error AND l.quality = 1)
    SELECT g.doc_id, coalesce(r.response, g.response) AS response, coalesce(r.has_error, g.has_error) AS has_error
    FROM gen g LEFT JOIN rec r USING (domain, q_idx, model)""")
def patch_recovered(spark, d):
    rows = generation(spark, d)
    good = table(spark, d, "labels").where("quality = 1").select("doc_id")
    recovered = rows.where("has_error").join(good, "doc_id", "left_semi").select(
        *QUESTION, "model", F.upper("response").alias("response"), F.lit(False).alias("has_error"))
    out = J.patch(rows, recovered, [*QUESTION, "model"], ["response", "has_error"])
    return out.select("doc_id", "response", "has_error")


@query("failure_counts", f"""WITH {GENERATION_SQL} SELECT CASE WHEN grouping(model) = 0 THEN 'model' ELSE 'question' END AS kind,
    coalesce(model, domain || '_Q' || (q_idx + 1)) AS subject, count(*) AS failures FROM gen WHERE has_error
    GROUP BY GROUPING SETS ((model), (domain, q_idx))""")
def failure_counts(spark, d):
    failed = generation(spark, d).where("has_error")
    out = failed.groupingSets([["model"], QUESTION], "model", *QUESTION).agg(
        F.grouping("model").alias("_g"), F.count(F.lit(1)).alias("failures"))
    label = F.concat("domain", F.lit("_Q"), (F.col("q_idx") + 1).cast("string"))
    return out.select(
        F.when(F.col("_g") == 0, "model").otherwise("question").alias("kind"),
        F.coalesce("model", label).alias("subject"), "failures",
    )


@query("generation_summary", f"""WITH {GENERATION_SQL} SELECT count(*) AS total, count(*) FILTER (NOT has_error) AS successful,
    round(count(*) FILTER (NOT has_error) / count(*) * 100, 4) AS success_pct,
    count(*) FILTER (attempts > 1) AS initial_failures, count(*) FILTER (attempts > 1 AND NOT has_error) AS recovered,
    round(count(*) FILTER (attempts > 1 AND NOT has_error) / count(*) FILTER (attempts > 1) * 100, 4) AS recovery_pct FROM gen""")
def generation_summary(spark, d):
    ok, late = ~F.col("has_error"), F.col("attempts") > 1
    n = F.count(F.lit(1))
    return generation(spark, d).agg(
        n.alias("total"), F.count_if(ok).alias("successful"), F.round(F.count_if(ok) / n * 100, 4).alias("success_pct"),
        F.count_if(late).alias("initial_failures"), F.count_if(late & ok).alias("recovered"),
        F.round(F.count_if(late & ok) / F.count_if(late) * 100, 4).alias("recovery_pct"),
    )


@query("domain_breakdown", f"""WITH {GENERATION_SQL} SELECT domain, count(*) FILTER (NOT has_error AND attempts = 1) AS first_try,
    count(*) FILTER (NOT has_error AND attempts > 1) AS with_retry, count(*) FILTER (has_error) AS failed FROM gen GROUP BY 1""")
def domain_breakdown(spark, d):
    ok = ~F.col("has_error")
    return generation(spark, d).groupBy("domain").agg(
        F.count_if(ok & (F.col("attempts") == 1)).alias("first_try"),
        F.count_if(ok & (F.col("attempts") > 1)).alias("with_retry"), F.count_if(~ok).alias("failed"))


@query("partial_questions", f"""WITH {STATUS_SQL} SELECT domain, 'Q' || (q_idx + 1) || ': ' || successful || '/' || total AS label
    FROM st WHERE successful < total""")
def partial_questions(spark, d):
    st = E.question_completion(generation(spark, d), QUESTION, F.col("has_error"), EXPECTED_MODELS)
    label = F.concat(F.lit("Q"), F.col("q_idx") + 1, F.lit(": "), "successful", F.lit("/"), "total")
    return st.where("successful < total").select("domain", label.alias("label"))


@query("missing_models", f"""WITH {GENERATION_SQL} SELECT domain, q_idx, string_agg(DISTINCT model, ', ' ORDER BY model) AS missing
    FROM gen WHERE has_error GROUP BY 1, 2""")
def missing_models(spark, d):
    failed = generation(spark, d).where("has_error")
    return failed.groupBy(*QUESTION).agg(F.concat_ws(", ", F.sort_array(F.collect_set("model"))).alias("missing"))


@query("remove_models", f"""WITH {GENERATION_SQL} SELECT domain, count(*) AS total, count(*) FILTER (NOT has_error) AS successful,
    round(count(*) FILTER (NOT has_error) / count(*) * 100, 4) AS success_rate FROM gen
    WHERE model NOT IN (SELECT 'model_' || r_regionkey FROM region WHERE r_name LIKE 'A%') GROUP BY 1""")
def remove_models(spark, d):
    removed = table(spark, d, "region").where("r_name LIKE 'A%'").select(
        F.concat(F.lit("model_"), "r_regionkey").alias("model"))
    kept = J.remove_models(generation(spark, d), removed)
    ok = ~F.col("has_error")
    return kept.groupBy("domain").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("successful"),
        F.round(F.count_if(ok) / F.count(F.lit(1)) * 100, 4).alias("success_rate"))


@query("upsert_records", """WITH delta AS (SELECT s_suppkey * 37 AS p_partkey, s_name AS p_name,
        CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END AS p_retailprice FROM supplier)
    SELECT coalesce(p.p_partkey, x.p_partkey) AS p_partkey, coalesce(x.p_name, p.p_name) AS p_name,
    coalesce(x.p_retailprice, p.p_retailprice) AS p_retailprice FROM part p FULL JOIN delta x ON p.p_partkey = x.p_partkey
    WHERE coalesce(p.p_partkey, x.p_partkey) NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)""")
def upsert_records(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice")
    delta = table(spark, d, "supplier").select(
        (F.col("s_suppkey") * 37).alias("p_partkey"), F.col("s_name").alias("p_name"),
        F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal")).alias("p_retailprice"))
    dropped = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return J.delete(J.upsert(part, delta, "p_partkey"), dropped, "p_partkey")


@query("filter_questions", """SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'fr')
    AND source IN (SELECT source FROM documents GROUP BY 1 HAVING count(*) >= 50)
    AND (contains(lower(source), 'src1') OR contains(lower(lang), 'en'))""")
def filter_questions(spark, d):
    docs = table(spark, d, "documents")
    busy = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).where("n >= 50").select("source")
    found = F.contains(F.lower("source"), F.lit("src1")) | F.contains(F.lower("lang"), F.lit("en"))
    return docs.where(F.col("lang").isin("en", "fr") & found).join(busy, "source", "left_semi").select(
        "doc_id", "lang", "source")
