"""Quality, validation and privacy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.functions import text
from scorelake.operators import privacy as Y
from scorelake.operators import quality as Q
from scorelake.plans.registry import query
from scorelake.plans.scoring import SPACES_SQL, quoted, sentences_sql
from scorelake.plans.statistics import rounded
from scorelake.plans.views import EVAL_SQL, eval_log, table


@query("dedup_documents", """SELECT count(*) AS rows, count(DISTINCT (text, lang)) AS kept,
    count(*) - count(DISTINCT (text, lang)) AS removed FROM documents""")
def dedup_documents(spark, d):
    return Q.duplicate_report(table(spark, d, "documents"), "text", "lang")


@query("distinct_documents", "SELECT DISTINCT text, lang FROM documents")
def distinct_documents(spark, d):
    return Q.drop_duplicate_rows(Q.tidy_names(table(spark, d, "documents").select("text", "lang")))


NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("profile_numeric", " UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean,
    round(stddev_samp({c}), 6) AS std, min({c}) AS min, max({c}) AS max, round(quantile_cont({c}, 0.25), 6) AS q25,
    round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75 FROM lineitem""" for c in NUMERIC))
def profile_numeric(spark, d):
    out = Q.numeric_profile(table(spark, d, "lineitem"), NUMERIC)
    return rounded(out, 6, "mean", "std", "q25", "q50", "q75")


CATEGORIES = ["o_orderstatus", "o_orderpriority", "o_custkey"]


@query("profile_categorical", " UNION ALL ".join(f"""(SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS n,
    row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS place,
    (SELECT count(DISTINCT {c}) FROM orders) AS n_distinct FROM orders GROUP BY 2 QUALIFY place <= 5)""" for c in CATEGORIES), place="INTEGER")
def profile_categorical(spark, d):
    return Q.categorical_profile(table(spark, d, "orders"), CATEGORIES)


@query("profile_nulls", " UNION ALL ".join(f"""SELECT '{c}' AS "column", '{t}' AS type, count(*) AS n_rows,
    count(*) - count({c}) AS nulls FROM documents LEFT JOIN labels USING (doc_id)"""
    for c, t in (("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("quality", "int"), ("toxic", "int"))))
def profile_nulls(spark, d):
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return Q.table_profile(joined.select("doc_id", "text", "lang", "quality", "toxic"))


@query("range_report", " UNION ALL ".join(f"""SELECT '{c}' AS "column", CAST(min({c}) AS DOUBLE) AS low,
    CAST(max({c}) AS DOUBLE) AS high FROM orders""" for c in ("o_orderkey", "o_custkey", "o_totalprice")))
def range_report(spark, d):
    return Q.range_report(table(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"])


ANSWERS_SQL = """ans AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 'q' || doc_id END AS question_id,
    text AS question, CASE WHEN n_chars < 200 THEN '' ELSE text END AS answer,
    CASE doc_id % 4 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' WHEN 2 THEN 'hard' ELSE 'extreme' END AS difficulty,
    CASE doc_id % 3 WHEN 0 THEN 'short' WHEN 1 THEN 'long' END AS expected_length, n_chars % 3 AS points FROM documents)"""


@query("issues", f"""WITH {ANSWERS_SQL} SELECT doc_id, concat_ws('; ',
    CASE WHEN question_id IS NULL THEN 'Question ID is required' END,
    CASE WHEN trim(question, {SPACES_SQL}) = '' THEN 'Question is required' END,
    CASE WHEN trim(answer, {SPACES_SQL}) = '' THEN 'Answer is required' END,
    CASE WHEN difficulty NOT IN ('easy', 'medium', 'hard') THEN 'Difficulty must be easy, medium, or hard' END,
    CASE WHEN coalesce(expected_length, '') NOT IN ('short', 'medium', 'long') THEN 'Expected length must be short, medium, or long' END,
    CASE WHEN points < 1 THEN 'At least one key point is required' END) AS issues FROM ans""")
def issues(spark, d):
    k4, k3 = F.col("doc_id") % 4, F.col("doc_id") % 3
    rows = table(spark, d, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 11 != 0, F.concat(F.lit("q"), "doc_id")).alias("question_id"),
        F.col("text").alias("question"), F.when(F.col("n_chars") < 200, "").otherwise(F.col("text")).alias("answer"),
        F.when(k4 == 0, "easy").when(k4 == 1, "medium").when(k4 == 2, "hard").otherwise("extreme").alias("difficulty"),
        F.when(k3 == 0, "short").when(k3 == 1, "long").alias("expected_length"),
        F.array_repeat(F.lit("point"), (F.col("n_chars") % 3).cast("int")).alias("key_points"),
    )
    return rows.select("doc_id", F.concat_ws("; ", Q.issues(Q.answer_rules())).alias("issues"))


@query("response_issues", f"""WITH {EVAL_SQL} SELECT id, concat_ws('; ', CASE WHEN length(response) < 10 THEN 'Response too short' END,
    CASE WHEN response_time_ms < 0 OR response_time_ms > 60000 THEN 'Invalid response time' END,
    CASE WHEN tokens_used < 0 THEN 'Negative token count' END) AS issues FROM eval_log""")
def response_issues(spark, d):
    rules = Q.response_rules("response", "response_time_ms", "tokens_used")
    return eval_log(spark, d).select("id", F.concat_ws("; ", Q.issues(rules)).alias("issues"))


@query("quality_flags", f"""WITH s AS (SELECT doc_id, n_chars, {sentences_sql('text')} AS s FROM documents)
    SELECT doc_id, n_chars < 50 AS is_short, round(CASE WHEN len(s) > 0 THEN 1 - len(list_distinct(s)) / len(s) ELSE 0.0 END, 8)
    AS repeated_share FROM s""")
def quality_flags(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", (F.col("n_chars") < 50).alias("is_short"),
        F.round(Q.repeated_share(text.sentences("text")), 8).alias("repeated_share"))


@query("comment_check", f"""WITH c AS (SELECT conv_id, turn, text, trim(text, {SPACES_SQL}) AS t FROM conversations)
    SELECT conv_id, turn, concat_ws('; ', CASE WHEN length(t) > 0 AND length(t) < 10 THEN 'Comment too short' END,
    CASE WHEN length(text) > 1000 THEN 'Comment too long' END) AS issues FROM c""")
def comment_check(spark, d):
    return table(spark, d, "conversations").select(
        "conv_id", "turn", F.concat_ws("; ", Q.issues(Q.comment_rules("text"))).alias("issues"))


def markup_sql(t: str) -> str:
    # on\w+ with Unicode word characters; RE2 writes the options after the pattern
    steps = (("(?is)<script.*?>.*?</script>", "g"), ("(?i)javascript:", "g"), ("(?i)data:", "g"), ("(?i)vbscript:", "g"),
             (r"(?i)on[\p{L}\p{N}_]+[\t\n\x0B\f\r ]*=", "g"), ("(?is)<style.*?>.*?</style>", "g"), ("<[^>]*>", "g"))
    for pattern, flags in steps:
        t = f"regexp_replace({t}, {quoted(pattern)}, '', '{flags}')"
    return f"trim({t}, {SPACES_SQL})"


@query("html_strip", f"SELECT page_id, {markup_sql('html')} AS text FROM pages")
def html_strip(spark, d):
    return table(spark, d, "pages").select("page_id", Y.strip_markup("html").alias("text"))


@query("query_check", f"""WITH q AS (SELECT conv_id, turn, text, {markup_sql('text')} AS clean FROM conversations)
    SELECT conv_id, turn, CASE WHEN text = '' THEN 'Query cannot be empty'
    WHEN length(text) > 5000 THEN 'Query too long (max 5000 characters)'
    WHEN clean <> text THEN 'Query contains potentially dangerous content' ELSE '' END AS error FROM q""")
def query_check(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", Q.check_query("text")["error"].alias("error"))


def plain_sql(t: str) -> str:
    return rf"regexp_replace({t}, '[^\x00-\x7F]', '_', 'g')"


@query("pii_scan", f"""SELECT source, kind, CAST(sum(n) AS BIGINT) AS n FROM ({" UNION ALL ".join(
    f"SELECT source, '{k}' AS kind, len(regexp_extract_all({plain_sql('text')}, {quoted('(?i)' + p)})) AS n FROM documents"
    for k, p in Y.PII_PATTERNS.items())}) GROUP BY 1, 2""")
def pii_scan(spark, d):
    counts = Y.pii_counts("text")
    wide = table(spark, d, "documents").groupBy("source").agg(*[F.sum(c).alias(n) for n, c in counts.items()])
    return wide.unpivot("source", list(counts), "kind", "n")


def redact_sql(t: str) -> str:
    for pattern in Y.PII_PATTERNS.values():
        t = f"regexp_replace({t}, {quoted('(?i)' + pattern)}, '{Y.REDACTED}', 'g')"
    return t


@query("pii_redact", f"SELECT doc_id, {redact_sql('text')} AS text FROM documents")
def pii_redact(spark, d):
    return table(spark, d, "documents").select("doc_id", Y.redact("text").alias("text"))


@query("pseudonymise", "SELECT c_custkey, substr(sha256(c_name), 1, 16) AS pseudonym FROM customer")
def pseudonymise(spark, d):
    return table(spark, d, "customer").select("c_custkey", Y.pseudonym("c_name").alias("pseudonym"))


@query("mask_fields", f"""SELECT doc_id, '{Y.REDACTED}' AS user_name, {redact_sql('text')} AS note_text,
    source AS note_source, '{Y.REDACTED}' AS note_email FROM documents""")
def mask_fields(spark, d):
    nested = table(spark, d, "documents").select(
        "doc_id", F.col("source").alias("user_name"),
        F.struct("text", "source", F.col("lang").alias("email")).alias("note"))
    masked = Y.mask_fields(nested)
    return masked.select("doc_id", "user_name", F.col("note.text").alias("note_text"),
                         F.col("note.source").alias("note_source"), F.col("note.email").alias("note_email"))


@query("audit_events", """SELECT 'research_' || event_type AS event_type, substr(sha256(CAST(user_id AS VARCHAR)), 1, 16) AS participant_hash,
    CASE WHEN event_type = 'error' THEN 'WARNING' ELSE 'INFO' END AS level, CAST(ts AS VARCHAR) AS at, '{"value":' || event_id || '}' AS details FROM events""")
def audit_events(spark, d):
    events = table(spark, d, "events").select(
        "event_type", "user_id", "ts", F.col("event_id").alias("value"),
        F.when(F.col("event_type") == "error", "HIGH").otherwise("LOW").alias("severity"))
    out = Y.audit_rows(events, "research", "event_type", "user_id", "severity", "ts")
    return out.withColumn("at", F.col("timestamp").cast("string")).drop("timestamp")


@query("archive_checksum", "SELECT count(*) AS rows, CAST(sum(CAST(('0x' || substr(md5(concat_ws('|', " + ", ".join(
    f"coalesce(md5(CAST({c} AS VARCHAR)), 'missing')" for c in ("doc_id", "text", "lang", "source", "n_chars"))
    + ")), 1, 15)) AS BIGINT)::HUGEINT) AS VARCHAR) AS checksum FROM documents")
def archive_checksum(spark, d):
    """Order-insensitive checksum of a whole table."""
    return Q.table_checksum(table(spark, d, "documents"))
