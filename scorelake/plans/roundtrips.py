"""Sources and sinks as queries: what is written to the shared folder is read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake import schemas
from scorelake.functions import text
from scorelake.operators import feedback as P
from scorelake.operators import joins as J
from scorelake.operators import quality as Q
from scorelake.operators import stats as S
from scorelake.plans.people import FB_SQL, RATINGS, feedback
from scorelake.plans.registry import query
from scorelake.plans.scoring import SPACES_SQL, keyword_case_sql, words_sql
from scorelake.plans.views import BARS_SQL, EVAL_SQL, bars, eval_log, table
from scorelake.session import scratch_path
from scorelake.sources import readers as R
from scorelake.sources import writers as W


@query("event_log_round_trip", f"""WITH {EVAL_SQL} SELECT query AS prompt, provider, model, response, response_time_ms AS latency,
    tokens_used AS tokens, CAST(question_id AS DOUBLE) AS score, 'run' || question_id % 2 AS run_id FROM eval_log""")
def event_log_round_trip(spark, d):
    """Events appended in two runs as JSON lines."""
    events = eval_log(spark, d).select(
        F.col("query").alias("prompt"), "provider", "model", "response", F.col("response_time_ms").alias("latency"),
        F.col("tokens_used").alias("tokens"), F.col("question_id").cast("double").alias("score"), F.lit(None).cast("timestamp").alias("timestamp"),
        F.concat(F.lit("run"), F.col("question_id") % 2).alias("run_id"))
    path = scratch_path(spark, "events")
    for run in ("run0", "run1"):
        W.append_events(events.where(F.col("run_id") == run), path)
    return R.read_events(spark, path).where("timestamp IS NOT NULL").drop("timestamp")


@query("log_file_stats", "SELECT count(*) AS total_entries, true AS has_size FROM events")
def log_file_stats(spark, d):
    path = scratch_path(spark, "log")
    table(spark, d, "events").select("event_id", "event_type").write.json(path)
    return R.file_stats(spark, path).select("total_entries", (F.col("size_mb") > 0).alias("has_size"))


@query("feedback_export_round_trip", f"""WITH {FB_SQL} SELECT event_id, session_id, industry, clarity, quality FROM fb WHERE record_type = 'industry_feedback'""")
def feedback_export_round_trip(spark, d):
    path = scratch_path(spark, "feedback")
    log = feedback(spark, d).select("event_id", "session_id", "record_type", "industry", "ratings")
    W.export_feedback(log, path, RATINGS)
    kinds = schemas.struct(event_id=schemas.L, session_id=schemas.L, record_type=schemas.S, industry=schemas.S, clarity=schemas.I, quality=schemas.I)
    return R.read_csv(spark, path, kinds).drop("record_type")


def saved_evaluations(spark, d):
    folder = scratch_path(spark, "evaluations")
    rows = eval_log(spark, d).select("id", "provider", F.col("tokens_used").cast("double").alias("overall_score"))
    for k in (1, 2):
        own = rows.withColumn("evaluation_id", F.lit(f"eval_{k}")).where(F.col("overall_score") % 2 == k - 1)
        summary = own.groupBy("evaluation_id", "provider").agg(F.avg("overall_score").alias("mean"))
        W.save_evaluation(own, summary, summary.select("evaluation_id", F.lit("anova").alias("test")), folder)
    return folder


@query("evaluation_round_trip", f"""WITH {EVAL_SQL} SELECT id, provider, CAST(tokens_used AS DOUBLE) AS overall_score, 'eval_2' AS evaluation_id
    FROM eval_log WHERE tokens_used % 2 = 1""")
def evaluation_round_trip(spark, d):
    """One of two saved evaluations, loaded by its id."""
    return R.load_evaluation(spark, saved_evaluations(spark, d), "eval_2")


@query("evaluation_history", f"""WITH {EVAL_SQL} SELECT DISTINCT 'eval_' || (tokens_used % 2 + 1) AS evaluation_id FROM eval_log""")
def evaluation_history(spark, d):
    return R.evaluation_history(spark, saved_evaluations(spark, d))


@query("vector_store_round_trip", "SELECT vec_id, label, embedding, '64' AS dimension FROM embeddings")
def vector_store_round_trip(spark, d):
    folder = scratch_path(spark, "store")
    W.save_vectors(table(spark, d, "embeddings"), {"dimension": "64"}, folder)
    chunks, settings = R.load_vectors(spark, folder)
    return chunks.withColumn("dimension", F.lit(settings["dimension"]))


@query("snapshot_round_trip", "SELECT c_custkey, c_name, 'current' AS version FROM customer UNION ALL SELECT c_custkey, c_name, 'first' FROM customer WHERE c_custkey % 2 = 0")
def snapshot_round_trip(spark, d):
    """A first and a second snapshot: the first is kept under its stamp, the second is current."""
    folder = scratch_path(spark, "snapshots")
    rows = table(spark, d, "customer").select("c_custkey", "c_name")
    W.snapshot(rows.where("c_custkey % 2 = 0"), folder, "2024-01-01")
    W.snapshot(rows, folder, "2024-01-02")
    current = spark.read.parquet(f"{folder}/current").withColumn("version", F.lit("current"))
    return current.unionByName(spark.read.parquet(f"{folder}/history/snapshot_ts=2024-01-01").withColumn("version", F.lit("first")))


@query("json_export_round_trip", f"""WITH {EVAL_SQL} SELECT id, provider, response, 's1' AS export_session, 'u1' AS export_user FROM eval_log""")
def json_export_round_trip(spark, d):
    path = scratch_path(spark, "export")
    W.export_json(eval_log(spark, d).select("id", "provider", "response"), path, "s1", "u1")
    names = ("id", "provider", "response", "export_session", "export_user")
    return R.read_json(spark, path, schemas.struct(**{n: schemas.S for n in names}), lines=True)


@query("bars_round_trip", f"WITH {BARS_SQL} SELECT date AS \"Date\", open AS \"Open\", high AS \"High\", low AS \"Low\", close AS \"Close\", volume AS \"Volume\" FROM bars")
def bars_round_trip(spark, d):
    """Price bars through CSV, dates parsed on load."""
    path = scratch_path(spark, "bars")
    bars(spark, d).select(
        F.col("date").cast("string").alias("Date"), F.col("open").alias("Open"), F.col("high").alias("High"), F.col("low").alias("Low"),
        F.col("close").alias("Close"), F.col("volume").alias("Volume")).write.option("header", True).csv(path)
    return R.read_bars(spark, path)


@query("rows_append_round_trip", "SELECT event_id, event_type FROM events UNION ALL SELECT event_id, event_type FROM events")
def rows_append_round_trip(spark, d):
    path = scratch_path(spark, "rows")
    rows = table(spark, d, "events").select("event_id", "event_type")
    for _ in range(2):
        W.append_rows(rows, path, "event_type")
    return spark.read.parquet(path).select("event_id", "event_type")


@query("heuristic_row", f"""WITH {EVAL_SQL}, p AS (SELECT *, response AS text, CASE question_id % 4 WHEN 0 THEN 'retail' WHEN 1 THEN 'finance'
    WHEN 2 THEN 'healthcare' ELSE 'other' END AS domain, len({words_sql('response')}) AS n, trim(response, {SPACES_SQL}) = trim(truth, {SPACES_SQL}) AS same,
    list_distinct({words_sql('lower(truth)')}) AS wanted, {words_sql('lower(response)')} AS said FROM eval_log),
    m AS (SELECT *, len(list_intersect(wanted, said)) / greatest(len(wanted), 1) AS m FROM p)
    SELECT id, round({keyword_case_sql()}, 8) AS relevance, CASE WHEN n < 10 OR n > 200 THEN 0.5 ELSE 1.0 END AS length_coherence,
    round(CASE WHEN truth IS NULL THEN NULL WHEN m >= 0.7 THEN 1.0 ELSE m END, 8) AS factual_accuracy, model, provider, tokens_used AS tokens FROM m""", length_coherence="DOUBLE")
def heuristic_row(spark, d):
    """All heuristic scores of a response beside its model."""
    k = F.col("question_id") % 4
    domain = F.when(k == 0, "retail").when(k == 1, "finance").when(k == 2, "healthcare").otherwise("other")
    rows = eval_log(spark, d).withColumn("domain", domain)
    return rows.select(
        "id", F.round(text.keyword_relevance("response", "domain"), 8).alias("relevance"), text.length_coherence("response").alias("length_coherence"),
        F.when(F.col("truth").isNotNull(), F.round(text.token_overlap("response", "truth"), 8)).alias("factual_accuracy"),
        "model", "provider", F.col("tokens_used").alias("tokens"))


@query("point_lookup", """SELECT e.event_id, c.c_name, 'one' AS kind FROM events e JOIN customer c ON c.c_custkey = e.user_id WHERE e.user_id = 7
    UNION ALL SELECT e.event_id, c.c_name, 'many' FROM events e LEFT JOIN customer c ON c.c_custkey = e.event_id""")
def point_lookup(spark, d):
    """One record by its key, and a record per asked key, nulls where there is none."""
    events, people = table(spark, d, "events"), table(spark, d, "customer").select("c_custkey", "c_name")
    asked = events.select("event_id", F.col("user_id").alias("c_custkey"))
    one = J.lookup(people, "c_custkey", 7).join(asked, "c_custkey").select("event_id", "c_name", F.lit("one").alias("kind"))
    many = J.lookup_many(events.select("event_id", F.col("event_id").alias("c_custkey")), people, "c_custkey")
    return one.unionByName(many.select("event_id", "c_name", F.lit("many").alias("kind")))


@query("membership_checks", f"""WITH {FB_SQL} SELECT event_id, coalesce(upper(industry) IN ('RETAIL', 'FINANCE', 'HEALTHCARE'), false) AS known_industry,
    chr(65 + k % 8) IN ('A', 'B', 'C', 'D', 'E', 'F') AS known_selection FROM fb""")
def membership_checks(spark, d):
    rows = feedback(spark, d).withColumn("industry", F.upper("industry")).withColumn("picked", F.char(65 + F.col("k") % 8))
    return rows.select("event_id", Q.is_industry("industry").alias("known_industry"), Q.is_selection("picked").alias("known_selection"))


@query("session_check", f"""WITH {FB_SQL}, s AS (SELECT event_id, CASE WHEN k % 7 = 0 THEN NULL WHEN k % 5 = 0 THEN 'x' || session_id ELSE 'session_' || session_id END AS sid,
    k % 6 - 1 AS step, industry FROM fb) SELECT event_id, CASE WHEN sid IS NULL OR step IS NULL OR industry IS NULL THEN 'Missing required field'
    WHEN NOT regexp_full_match(sid, 'session_[0-9]+') THEN 'Invalid session ID format' WHEN step < 0 OR step > 3 THEN 'Invalid step value' ELSE '' END AS error FROM s""")
def session_check(spark, d):
    k = F.col("k")
    sid = F.when(k % 7 == 0, None).when(k % 5 == 0, F.concat(F.lit("x"), "session_id")).otherwise(F.concat(F.lit("session_"), "session_id"))
    rows = feedback(spark, d).select("event_id", "industry", sid.alias("sid"), (k % 6 - 1).alias("step"))
    return rows.select("event_id", Q.check_session("sid", "step", "industry")["error"].alias("error"))


@query("attach_context", """WITH c AS (SELECT lang AS domain, count(*) || ' documents' AS context, 'longest ' || max(n_chars) AS evaluation_criteria FROM documents GROUP BY 1)
    SELECT doc_id, lang AS domain, context, evaluation_criteria FROM documents LEFT JOIN c ON c.domain = lang""")
def attach_context(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("domain"), "n_chars")
    contexts = docs.groupBy("domain").agg(
        F.concat(F.count(F.lit(1)), F.lit(" documents")).alias("context"), F.concat(F.lit("longest "), F.max("n_chars")).alias("evaluation_criteria"))
    return J.attach_context(docs.drop("n_chars"), contexts)


@query("session_slice", f"""WITH {FB_SQL} SELECT event_id, 'session' AS part FROM fb WHERE session_id = 7
    UNION ALL SELECT event_id, 'industry' FROM fb WHERE record_type = 'industry_feedback' AND industry = 'retail'""")
def session_slice(spark, d):
    """The records of one session and the feedback of one industry."""
    log = feedback(spark, d)
    own = P.session_feedback(log, 7).select("event_id", F.lit("session").alias("part"))
    return own.unionByName(P.industry_feedback(log, "retail").select("event_id", F.lit("industry").alias("part")))


BATCH_SQL = f"""{EVAL_SQL}, w AS (SELECT id, provider, response_time_ms, list_distinct({words_sql('lower(truth)')}) AS wanted,
    {words_sql('lower(response)')} AS said FROM eval_log WHERE truth IS NOT NULL AND tokens_used > 20),
    sc AS (SELECT provider, response_time_ms, len(list_intersect(wanted, said)) / greatest(len(wanted), 1) AS o FROM w),
    scored AS (SELECT provider, response_time_ms, CASE WHEN o >= 0.7 THEN 1.0 ELSE o END AS score FROM sc),
    m AS (SELECT provider AS grp, count(*) AS n, avg(score) AS mean, var_samp(score) AS var, avg(response_time_ms) AS ms FROM scored GROUP BY 1),
    g AS (SELECT count(*) AS k, sum(n) AS total, sum(n * mean) / sum(n) AS gm, sum((n - 1) * var) AS ssw FROM m),
    a AS (SELECT any_value(k) AS k, (sum(n * pow(mean - gm, 2)) / (any_value(k) - 1)) / (any_value(ssw) / (any_value(total) - any_value(k))) AS f FROM m, g)"""


@query("batch_evaluation", f"""WITH {BATCH_SQL} SELECT 'batch_1' AS evaluation_id, grp AS provider, n, round(mean, 8) AS mean, round(ms, 6) AS avg_time_ms,
    row_number() OVER (ORDER BY mean DESC, grp) AS rank, round(f, 6) AS anova_f FROM m, a""")
def batch_evaluation(spark, d):
    """One evaluation as a job: filter, score, summarise, test, save, load by its id, rank."""
    asked = eval_log(spark, d).where("truth IS NOT NULL AND tokens_used > 20")
    scored = asked.select("id", "provider", "response_time_ms", text.token_overlap("response", "truth").alias("overall_score")).withColumn(
        "evaluation_id", F.lit("batch_1"))
    folder = scratch_path(spark, "batch")
    summary = scored.groupBy("evaluation_id", "provider").agg(F.avg("overall_score").alias("mean"))
    tested = S.anova_p(S.anova(S.moments(scored, "provider", "overall_score"))).withColumn("evaluation_id", F.lit("batch_1"))
    W.save_evaluation(scored, summary, tested, folder)
    rows = R.load_evaluation(spark, folder, "batch_1")
    test = spark.read.parquet(f"{folder}/tests").where("evaluation_id = 'batch_1'")
    times = rows.groupBy(F.col("provider").alias("grp")).agg(F.avg("response_time_ms").alias("ms"))
    ranked = S.rank_groups(S.moments(rows, "provider", "overall_score")).join(times, "grp")
    return ranked.select(
        F.lit("batch_1").alias("evaluation_id"), F.col("grp").alias("provider"), "n", F.round("mean", 8).alias("mean"), F.round("ms", 6).alias("avg_time_ms"),
        "rank", F.round(test.select("statistic").scalar(), 6).alias("anova_f"))
