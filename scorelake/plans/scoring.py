"""Text-scoring queries over responses and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.functions import similarity, text
from scorelake.operators import scoring
from scorelake.plans.registry import query
from scorelake.plans.views import EVAL_SQL, eval_log, table


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


SPACES_SQL = "concat(" + ", ".join(f"chr({ord(c)})" for c in text.SPACES) + ")"


def words_sql(t: str) -> str:
    return f"list_filter(string_split_regex({t}, {quoted(text.SPACE_RUN)}), lambda w: w <> '')"


def sentences_sql(t: str) -> str:
    return f"list_filter(list_transform(string_split({t}, '.'), lambda s: trim(s, {SPACES_SQL})), lambda s: s <> '')"


def found_sql(t: str, phrases) -> str:
    return "(" + " + ".join(f"CAST(contains({t}, {quoted(p)}) AS INT)" for p in phrases) + ")"


def facts_sql(t: str) -> str:
    # every non-ASCII letter or digit acts as a word character that no pattern matches
    plain = rf"regexp_replace({t}, '[^\x00-\x7F]', '_', 'g')"
    parts = [f"regexp_extract_all({plain}, {quoted(p)})" for p in text.FACT_PATTERNS]
    stated = f"list_filter({sentences_sql(t)}, lambda s: regexp_matches(lower(s), '{'|'.join(text.FACT_VERBS)}'))"
    joined = stated
    for p in parts:
        joined = f"list_concat({joined}, {p})"
    return f"list_distinct({joined})"


def tokens_sql(t: str) -> str:
    return (f"list_filter(regexp_extract_all(lower({t}), {quoted(text.WORD_TOKEN)}), "
            f"lambda w: NOT list_contains({sql_list(text.RELEVANCE_STOP_WORDS)}, w))")


TFIDF_SQL = f"""tok AS (SELECT id, 1 AS q, 0 AS r, {tokens_sql('query')} AS t FROM eval_log
    UNION ALL SELECT id, 0, 1, {tokens_sql('response')} FROM eval_log),
    term AS (SELECT id, q, r, unnest(t) AS term FROM tok UNION ALL
        SELECT id, q, r, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM tok WHERE len(t) > 1),
    cnt AS (SELECT id, term, sum(q) AS q, sum(r) AS r FROM term GROUP BY 1, 2),
    kept AS (SELECT *, CASE WHEN q > 0 AND r > 0 THEN 1.0 ELSE {scoring.UNSHARED_IDF!r} END AS idf FROM cnt),
    sums AS (SELECT id, sum(q * r) AS dot, sum(pow(q * idf, 2)) AS qq, sum(pow(r * idf, 2)) AS rr FROM kept GROUP BY 1),
    rel AS (SELECT e.id, CASE WHEN qq > 0 AND rr > 0 THEN dot / sqrt(qq * rr) ELSE 0.0 END AS relevance
        FROM eval_log e LEFT JOIN sums s ON e.id = s.id)"""


@query("tfidf_relevance", f"WITH {EVAL_SQL}, {TFIDF_SQL} SELECT id, round(relevance, 8) AS relevance FROM rel")
def tfidf_relevance(spark, d):
    out = scoring.tfidf_relevance(eval_log(spark, d), "id", "query", "response")
    return out.withColumn("relevance", F.round("relevance", 8))


FACT_SQL = f"""fact AS (SELECT id, {facts_sql('response')} AS said, {facts_sql('truth')} AS known FROM eval_log),
    f1 AS (SELECT id, len(said) AS n_said, len(known) AS n_known, len(list_intersect(said, known)) AS n_shared FROM fact)"""


@query("fact_f1", f"""WITH {EVAL_SQL}, {FACT_SQL} SELECT id, n_said, n_known, n_shared,
    round(CASE WHEN n_shared > 0 THEN 2 * n_shared / (n_said + n_known) ELSE 0.0 END, 8) AS fact_f1 FROM f1""", n_said="INTEGER", n_known="INTEGER", n_shared="INTEGER")
def fact_f1(spark, d):
    said, known = text.facts("response"), text.facts("truth")
    return eval_log(spark, d).select(
        "id", F.size(said).alias("n_said"), F.size(known).alias("n_known"),
        F.size(F.array_intersect(said, known)).alias("n_shared"),
        F.round(text.fact_f1("response", "truth"), 8).alias("fact_f1"),
    )


@query("document_facts", f"SELECT doc_id, len({facts_sql('text')}) AS n_facts FROM documents", n_facts="INTEGER")
def document_facts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(text.facts("text")).alias("n_facts"))


ASKED = f"list_distinct(list_filter({words_sql('lower(query)')}, lambda w: NOT list_contains({sql_list(text.STOP_WORDS)}, w)))"
COMPLETE_SQL = f"""comp AS (SELECT id, {ASKED} AS asked, lower(response) AS low, len({words_sql('response')}) AS n FROM eval_log),
    compl AS (SELECT id, CASE WHEN len(asked) = 0 THEN 1.0 ELSE
    0.5 * len(list_filter(asked, lambda w: contains(low, w))) / len(asked) + 0.3 * least(n / 10, 1.0)
    + 0.2 * CASE WHEN {found_sql('low', text.CONCLUSIONS)} > 0 THEN 1.0 ELSE 0.5 END END AS completeness FROM comp)"""


@query("completeness", f"WITH {EVAL_SQL}, {COMPLETE_SQL} SELECT id, round(completeness, 8) AS completeness FROM compl")
def completeness(spark, d):
    return eval_log(spark, d).select(
        "id", F.round(text.completeness("response", "query"), 8).alias("completeness"))


EFFICIENCY_SQL = f"""eff AS (SELECT id, CASE WHEN tokens_used = 0 THEN 0.0 ELSE least(greatest(
    (len({words_sql('response')}) - len({words_sql('query')})) / tokens_used / 0.5, 0.0), 1.0) END AS token_efficiency,
    CASE WHEN response_time_ms > 0 AND length(response) > 0
    THEN least(length(response) * 1000 / response_time_ms / 1000, 1.0) ELSE 0.0 END AS time_efficiency FROM eval_log)"""


@query("efficiency", f"""WITH {EVAL_SQL}, {EFFICIENCY_SQL} SELECT id, round(token_efficiency, 8) AS token_efficiency,
    round(time_efficiency, 8) AS time_efficiency FROM eff""")
def efficiency(spark, d):
    return eval_log(spark, d).select(
        "id", F.round(text.token_efficiency("response", "tokens_used", "query"), 8).alias("token_efficiency"),
        F.round(text.time_efficiency("response_time_ms", F.length("response")), 8).alias("time_efficiency"),
    )


@query("coherence")
def coherence(spark, d):
    return eval_log(spark, d).select("id", F.round(scoring.coherence("response"), 8).alias("coherence"))


@query("overall_score")
def overall_score(spark, d):
    scored = scoring.score_responses(eval_log(spark, d))
    numbers = [*text.OVERALL_WEIGHTS, "overall_score", "ci_low", "ci_high"]
    return scored.select("id", "question_id", "provider", *[F.round(c, 8).alias(c) for c in numbers])


@query("fuzzy_accuracy")
def fuzzy_accuracy(spark, d):
    rows = eval_log(spark, d).where(F.col("truth").isNotNull())
    ratio = similarity.sequence_ratio("response", "truth")
    scored = rows.withColumn("ratio", ratio)
    return scored.select("id", F.round(F.when(F.col("ratio") >= 0.7, 1.0).otherwise(F.col("ratio")), 8).alias("score"))


def keyword_case_sql() -> str:
    # a non-ASCII letter counts as a word character on both sides
    plain = r"regexp_replace(text, '[^\x00-\x7F]', '_', 'g')"
    cases = []
    for name, listed in text.KEYWORDS.items():
        hits = " + ".join(rf"CAST(regexp_matches({plain}, '(?i)\b{w}\b') AS INT)" for w in listed)
        cases.append(f"WHEN domain = '{name}' THEN greatest(({hits}) / {len(listed)}, 0.2)")
    return "CASE " + " ".join(cases) + " ELSE 0.0 END"


@query("keyword_relevance", f"""WITH p AS (SELECT doc_id, text,
    CASE doc_id % 4 WHEN 0 THEN 'retail' WHEN 1 THEN 'finance' WHEN 2 THEN 'healthcare' ELSE 'other' END AS domain FROM documents)
    SELECT doc_id, domain, round({keyword_case_sql()}, 8) AS relevance FROM p""")
def keyword_relevance(spark, d):
    k = F.col("doc_id") % 4
    domain = F.when(k == 0, "retail").when(k == 1, "finance").when(k == 2, "healthcare").otherwise("other")
    docs = table(spark, d, "documents").withColumn("domain", domain)
    return docs.select("doc_id", "domain", F.round(text.keyword_relevance("text", "domain"), 8).alias("relevance"))


@query("token_overlap", f"""WITH {EVAL_SQL}, w AS (SELECT id, trim(response, {SPACES_SQL}) = trim(truth, {SPACES_SQL}) AS same,
    list_distinct({words_sql('lower(truth)')}) AS wanted, {words_sql('lower(response)')} AS said FROM eval_log WHERE truth IS NOT NULL),
    m AS (SELECT id, same, len(list_intersect(wanted, said)) / greatest(len(wanted), 1) AS m FROM w)
    SELECT id, round(CASE WHEN m >= 0.7 THEN 1.0 ELSE m END, 8) AS overlap, CASE WHEN same THEN 1.0 ELSE 0.0 END AS exact FROM m""", exact="DOUBLE")
def token_overlap(spark, d):
    return eval_log(spark, d).where(F.col("truth").isNotNull()).select(
        "id", F.round(text.token_overlap("response", "truth"), 8).alias("overlap"),
        text.exact_match("response", "truth").alias("exact"),
    )


@query("length_coherence", f"""WITH w AS (SELECT doc_id, len({words_sql('text')}) AS n FROM documents)
    SELECT doc_id, CASE WHEN n < 10 THEN 0.5 WHEN n > 200 THEN 0.5 ELSE 1.0 END AS score FROM w""", score="DOUBLE")
def length_coherence(spark, d):
    return table(spark, d, "documents").select("doc_id", text.length_coherence("text").alias("score"))


@query("shape_features", f"""WITH w AS (SELECT doc_id, len({words_sql('text')}) AS word_count,
    len({sentences_sql('text')}) AS sentence_count, length(text) AS character_count,
    contains(text, '```') AS has_code_blocks,
    regexp_matches(text, '(?m)^[\\t\\n\\x0B\\f\\r ]*(•|-|\\*|1\\.|2\\.)') AS has_bullet_points FROM documents)
    SELECT *, round(least(word_count / 100 * 0.5 + sentence_count / 10 * 0.3
    + CASE WHEN has_code_blocks THEN 0.2 ELSE 0.0 END, 1.0), 8) AS structure_score FROM w""", word_count="INTEGER", sentence_count="INTEGER", character_count="INTEGER")
def shape_features(spark, d):
    parts = text.shape("text")
    parts["structure_score"] = F.round(parts["structure_score"], 8)
    return table(spark, d, "documents").select("doc_id", *[c.alias(n) for n, c in parts.items()])


@query("context_quality", f"""WITH w AS (SELECT doc_id, length(text) AS n, {words_sql('text')} AS w FROM documents)
    SELECT doc_id, round(CASE WHEN n = 0 THEN 0.0 ELSE (least(n / 1000, 1.0) +
    CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w) ELSE 0.0 END) / 2 END, 8) AS quality FROM w""")
def context_quality(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(text.context_quality("text"), 8).alias("quality"))


@query("previews", """SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview,
    length(text) AS full_length FROM documents""", full_length="INTEGER")
def previews(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", text.preview("text", 200).alias("preview"), F.length("text").alias("full_length"))


def guidance_sql() -> str:
    return "CASE " + " ".join(
        f"WHEN {found_sql('low', keys)} > 0 THEN '{length}|{'; '.join(focus)}'" for keys, length, focus in text.GUIDANCE
    ) + " ELSE 'medium|' END"


@query("guidance", f"""WITH q AS (SELECT conv_id, turn, lower(text) AS low,
    CASE conv_id % 3 WHEN 0 THEN 'retail_01' WHEN 1 THEN 'finance_01' ELSE 'care_01' END AS question_id
    FROM conversations WHERE role = 'user'), g AS (SELECT *, {guidance_sql()} AS g FROM q)
    SELECT conv_id, turn, split_part(g, '|', 1) AS expected_length, split_part(g, '|', 2) AS focus,
    CASE WHEN starts_with(question_id, 'retail') THEN {quoted('; '.join(text.REQUIREMENTS['retail']))}
    WHEN starts_with(question_id, 'finance') THEN {quoted('; '.join(text.REQUIREMENTS['finance']))} ELSE '' END AS needs FROM g""")
def guidance(spark, d):
    k = F.col("conv_id") % 3
    asked = table(spark, d, "conversations").where(F.col("role") == "user").withColumn(
        "question_id", F.when(k == 0, "retail_01").when(k == 1, "finance_01").otherwise("care_01"))
    found = asked.withColumn("g", text.guidance("text"))
    return found.select(
        "conv_id", "turn", F.col("g.expected_length").alias("expected_length"),
        F.concat_ws("; ", "g.focus").alias("focus"),
        F.concat_ws("; ", text.requirements("question_id")).alias("needs"),
    )
