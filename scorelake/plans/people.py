"""Feedback, ranking, blinding and sampling queries over the event table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scorelake.operators import blinding as B
from scorelake.operators import feedback as P
from scorelake.operators.grouped import share_of_total
from scorelake.plans.registry import query
from scorelake.plans.views import table
from scorelake.session import kept

INDUSTRIES = ("retail", "finance", "healthcare")
PROVIDERS = ("alpha", "beta", "delta", "gamma")


def feedback(spark, d):
    """Events as feedback records, session starts and session completions."""
    events = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    return events.select(
        "event_id", F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), k.alias("k"),
        F.when(kind.isin("signup", "error"), "session_event").otherwise("industry_feedback").alias("record_type"),
        F.when(kind == "signup", "session_start").when(kind == "error", "session_completion").alias("event_name"),
        F.when(kind == "click", "retail").when(kind == "view", "finance").when(kind == "purchase", "healthcare").alias("industry"),
        F.char(65 + k % 4).alias("selected"),
        F.when(k % 5 == 0, F.lit(" ")).otherwise(F.concat(F.lit("comment "), k)).alias("comment"),
        (k % 5 + 1).alias("confidence"),
        F.create_map(F.lit("quality"), k % 5 + 1, F.lit("clarity"), k % 3 + 1).alias("ratings"),
    )


FB_SQL = """fb0 AS (SELECT *, CAST(props->>'k' AS INT) AS k FROM events),
    fb AS (SELECT event_id, user_id AS session_id, ts, k,
    CASE WHEN event_type IN ('signup', 'error') THEN 'session_event' ELSE 'industry_feedback' END AS record_type,
    CASE event_type WHEN 'signup' THEN 'session_start' WHEN 'error' THEN 'session_completion' END AS event_name,
    CASE event_type WHEN 'click' THEN 'retail' WHEN 'view' THEN 'finance' WHEN 'purchase' THEN 'healthcare' END AS industry,
    chr(65 + k % 4) AS selected, CASE WHEN k % 5 = 0 THEN ' ' ELSE 'comment ' || k END AS comment,
    k % 5 + 1 AS confidence, k % 5 + 1 AS quality, k % 3 + 1 AS clarity FROM fb0)"""


def rankings(spark, d):
    """Each feedback event ranks four blinded providers; every tenth has a repeated rank."""
    fb = feedback(spark, d).where(P.is_feedback())
    key = F.col("event_id").cast("string")
    names = F.array(*[F.lit(p) for p in PROVIDERS])
    labels = F.array(*[F.lit(x) for x in "ABCD"])
    good, bad = F.array(*[F.lit(i) for i in (1, 2, 3, 4)]), F.array(*[F.lit(i) for i in (1, 1, 3, 4)])
    ranks = F.when(F.col("k") % 10 == 0, bad).otherwise(good)
    return fb.select(
        "event_id", "session_id", "ts", "industry", "selected",
        B.shuffled(names, key, "order").alias("response_order"),
        F.map_from_arrays(B.shuffled(labels, key, "rank"), ranks).alias("ranks"),
        B.blind_map(names, key, "blind").alias("blind_map"),
    )


def order_sql(items, salt: str) -> str:
    listed = "[" + ", ".join(f"'{x}'" for x in items) + "]"
    return (f"list_transform(list_sort(list_transform({listed}, lambda x: {{'h': md5(event_id || '|{salt}|' || x), 'x': x}})),"
            " lambda s: s.x)")


RANK_SQL = f"""{FB_SQL}, rk AS (SELECT *, {order_sql(PROVIDERS, 'order')} AS response_order,
    {order_sql('ABCD', 'rank')} AS label_order, {order_sql(PROVIDERS, 'blind')} AS blind_order,
    CASE WHEN k % 10 = 0 THEN [1, 1, 3, 4] ELSE [1, 2, 3, 4] END AS rank_list FROM fb WHERE record_type = 'industry_feedback')"""


@query("feedback_summary", f"""WITH {FB_SQL} SELECT count(*) FILTER (record_type = 'industry_feedback') AS feedback_records,
    count(DISTINCT session_id) AS sessions, count(*) FILTER (event_name = 'session_completion') AS completed_sessions FROM fb""")
def feedback_summary(spark, d):
    return P.feedback_summary(feedback(spark, d))


@query("industry_counts", f"""WITH {FB_SQL} SELECT coalesce(industry, 'unknown') AS industry, count(*) AS n FROM fb
    WHERE record_type = 'industry_feedback' GROUP BY 1""")
def industry_counts(spark, d):
    return P.industry_counts(feedback(spark, d))


@query("session_stats", f"""WITH {FB_SQL} SELECT session_id, count(*) FILTER (record_type = 'industry_feedback') AS responses,
    count(DISTINCT industry) FILTER (record_type = 'industry_feedback') AS industries,
    coalesce(bool_or(event_name = 'session_start'), FALSE) AS started,
    coalesce(bool_or(event_name = 'session_completion'), FALSE) AS completed,
    round(coalesce(sum(quality + clarity) FILTER (record_type = 'industry_feedback')
        / (2 * count(*) FILTER (record_type = 'industry_feedback')), 0), 8) AS mean_rating,
    epoch_us(max(ts)) - epoch_us(min(ts)) AS duration_us FROM fb GROUP BY 1""")
def session_stats(spark, d):
    return P.session_stats(feedback(spark, d)).withColumn("mean_rating", F.round("mean_rating", 8))


@query("completion_grid", f"""WITH {FB_SQL}, i AS (SELECT unnest(['retail', 'finance', 'healthcare']) AS industry)
    SELECT s.session_id, i.industry, EXISTS (SELECT 1 FROM fb f WHERE f.session_id = s.session_id
    AND f.industry = i.industry) AS completed FROM (SELECT DISTINCT session_id FROM fb) s, i""")
def completion_grid(spark, d):
    return P.completion_grid(feedback(spark, d), INDUSTRIES)


@query("final_stats", f"""WITH {FB_SQL} SELECT session_id, count(*) AS evaluations, count(DISTINCT industry) AS domains,
    round(avg(confidence), 8) AS mean_confidence, count(*) FILTER (trim(comment) <> '') AS comments
    FROM fb WHERE record_type = 'industry_feedback' GROUP BY 1""")
def final_stats(spark, d):
    out = P.final_stats(feedback(spark, d), "session_id")
    return out.withColumn("mean_confidence", F.round("mean_confidence", 8))


@query("progress", f"""WITH {FB_SQL} SELECT session_id, industry, count(*) AS done, least(count(*) / 5 * 100, 100.0) AS percent
    FROM fb WHERE record_type = 'industry_feedback' GROUP BY 1, 2""")
def progress(spark, d):
    return P.progress(feedback(spark, d), "session_id")


RATINGS = ("clarity", "quality")


@query("rating_entries", f"""WITH {FB_SQL} SELECT event_id, 'clarity' AS key, clarity AS value FROM fb WHERE record_type = 'industry_feedback'
    UNION ALL SELECT event_id, 'quality', quality FROM fb WHERE record_type = 'industry_feedback'""")
def rating_entries(spark, d):
    given = feedback(spark, d).where(P.is_feedback()).select("event_id", "ratings")
    return P.map_entries(given, "ratings")


@query("flatten_ratings", f"""WITH {FB_SQL} SELECT event_id, session_id, clarity, quality FROM fb
    WHERE record_type = 'industry_feedback'""")
def flatten_ratings(spark, d):
    given = feedback(spark, d).where(P.is_feedback()).select("event_id", "session_id", "ratings")
    return P.flatten_map(given, "ratings", RATINGS)


@query("last_n", f"""WITH {FB_SQL} SELECT session_id, event_id, row_number() OVER
    (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) AS place FROM fb WHERE record_type = 'industry_feedback'
    QUALIFY place <= 5""", place="INTEGER")
def last_n(spark, d):
    order = Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("event_id"))
    given = feedback(spark, d).where(P.is_feedback())
    return given.withColumn("place", F.row_number().over(order)).where("place <= 5").select("session_id", "event_id", "place")


@query("ranking_valid", f"""WITH {RANK_SQL} SELECT event_id, list_sort(rank_list) = [1, 2, 3, 4] AS valid,
    label_order[1] AS best_label, response_order[ascii(label_order[1]) - 64] AS best_provider FROM rk""")
def ranking_valid(spark, d):
    rows = rankings(spark, d)
    # a repeated rank 1 keeps the label listed first
    best = B.label_of_rank("ranks")
    return rows.select("event_id", B.valid_ranking("ranks").alias("valid"), best.alias("best_label"),
                       B.item_of_label(best, "response_order").alias("best_provider"))


@query("mean_rank", f"""WITH {RANK_SQL}, u AS (SELECT unnest(label_order) AS label, unnest(rank_list) AS rank, response_order FROM rk)
    SELECT response_order[ascii(label) - 64] AS provider, count(*) AS n, round(avg(rank), 8) AS mean_rank,
    round(4 - avg(rank), 8) AS performance FROM u GROUP BY 1""")
def mean_rank(spark, d):
    long = B.unblind(rankings(spark, d), "ranks", "response_order", "event_id")
    return long.groupBy("provider").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("rank"), 8).alias("mean_rank"),
        F.round(4 - F.avg("rank"), 8).alias("performance"))


@query("unblinded_rows", f"""WITH {RANK_SQL}, u AS (SELECT event_id, unnest(label_order) AS label, unnest(rank_list) AS rank, response_order FROM rk)
    SELECT event_id, label, response_order[ascii(label) - 64] AS provider, rank FROM u""")
def unblinded_rows(spark, d):
    return B.unblind(rankings(spark, d), "ranks", "response_order", "event_id")


@query("preference_share", f"""WITH {RANK_SQL}, c AS (SELECT blind_order[ascii(selected) - 64] AS provider, count(*) AS n FROM rk GROUP BY 1)
    SELECT provider, n, round(n / (SELECT sum(n) FROM c) * 100, 6) AS pct,
    provider = (SELECT provider FROM c ORDER BY n DESC, provider LIMIT 1) AS most_selected FROM c""")
def preference_share(spark, d):
    chosen = rankings(spark, d).select(B.chosen_item("selected", "blind_map").alias("provider"))
    counts = kept(chosen.groupBy("provider").agg(F.count(F.lit(1)).alias("n")))
    top = counts.agg(F.min(F.struct(-F.col("n"), F.col("provider"))).provider)
    shared = share_of_total(counts, "n", "pct", 6)
    return shared.withColumn("most_selected", F.col("provider") == top.scalar())


@query("blind_map", f"""WITH {RANK_SQL} SELECT event_id, blind_order[1] AS A, blind_order[2] AS B, blind_order[3] AS C,
    blind_order[4] AS D, blind_order[ascii(selected) - 64] AS selected_item FROM rk""")
def blind_map(spark, d):
    rows = rankings(spark, d)
    return rows.select("event_id", *[F.col("blind_map")[x].alias(x) for x in "ABCD"],
                       B.chosen_item("selected", "blind_map").alias("selected_item"))


@query("stratified_sample", """SELECT doc_id, source, row_number() OVER (PARTITION BY source
    ORDER BY md5(doc_id || '|7'), doc_id) AS sample_order FROM documents QUALIFY sample_order <= 5""", sample_order="INTEGER")
def stratified_sample(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return B.sample_per_stratum(docs, "source", "doc_id", 5, "7")


@query("session_sample", """WITH h AS (SELECT doc_id, lang, ('0x' || substr(md5(doc_id || '|7'), 1, 8))::BIGINT AS h FROM documents),
    o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) - 1 AS pos FROM h),
    z AS (SELECT lang, count(*) AS n, least(count(*), 5) AS take FROM documents GROUP BY 1),
    s AS (SELECT DISTINCT user_id AS session_id FROM events),
    w AS (SELECT session_id, lang, list_reduce(range(take), lambda a, i: list_append(a, CASE WHEN list_contains(a,
        ('0x' || substr(md5(session_id || '|' || lang || '|' || i || '|7'), 1, 15))::BIGINT % (n - take + i + 1)) THEN n - take + i ELSE
        ('0x' || substr(md5(session_id || '|' || lang || '|' || i || '|7'), 1, 15))::BIGINT % (n - take + i + 1) END), []::BIGINT[]) AS ps FROM s, z),
    u AS (SELECT session_id, lang, unnest(ps) AS pos FROM w),
    r AS (SELECT *, row_number() OVER (PARTITION BY session_id, lang
        ORDER BY ('0x' || substr(md5(session_id || '|' || lang || '|' || pos || '|7|order'), 1, 15))::BIGINT, pos) AS sample_order FROM u)
    SELECT session_id, r.lang, sample_order, doc_id FROM r JOIN o ON o.lang = r.lang AND o.pos = r.pos""", sample_order="INTEGER")
def session_sample(spark, d):
    pool = table(spark, d, "documents").select("doc_id", "lang")
    sessions = table(spark, d, "events").select(F.col("user_id").alias("session_id")).distinct()
    return B.sample_for_sessions(sessions, pool, "session_id", "lang", "doc_id", 5, "7")
