"""Files written, damaged and read back; registrations, selections, identifiers and names."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from scorelake import schemas
from scorelake.functions import text as X
from scorelake.plans.registry import query
from scorelake.plans.views import HEALTH_SQL, health, table
from scorelake.session import scratch_path
from scorelake.sources import json_items
from scorelake.sources import readers as R
from scorelake.sources import writers as W

ORDERS = schemas.struct(o_orderkey=schemas.L, o_totalprice=schemas.D)


@query("csv_quarantine", """SELECT p || '.csv' AS source_file, count(*) AS n_rows, count(*) FILTER (bad) AS n_bad, NOT bool_or(bad) AS taken,
    CASE WHEN NOT bool_or(bad) THEN round(sum(o_totalprice), 2) END AS total
    FROM (SELECT left(o_orderpriority, 1) AS p, o_totalprice, o_orderpriority LIKE '3%' AND o_orderkey % 100 = 0 AS bad FROM orders) GROUP BY p""")
def csv_quarantine(spark, d):
    """Orders as one file per priority; one file has prices that are none and is left out whole."""
    folder = scratch_path(spark, "csv")
    damaged = F.col("o_orderpriority").startswith("3") & (F.col("o_orderkey") % 100 == 0)
    orders = table(spark, d, "orders").select(
        F.substring("o_orderpriority", 1, 1).alias("file"), "o_orderkey", F.when(damaged, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice"))
    orders.repartition("file").write.partitionBy("file").option("header", True).csv(folder)
    files = [r.path for r in spark.read.format("binaryFile").load(f"{folder}/*/*.csv").select("path").collect()]
    rows, left_out = R.read_many_csv(spark, files, ORDERS)
    named = F.concat(F.regexp_extract("source_path", "file=([^/]*)/", 1), F.lit(".csv")).alias("source_file")
    taken = rows.groupBy(named).agg(
        F.count(F.lit(1)).alias("n_rows"), F.lit(0).cast("bigint").alias("n_bad"), F.lit(True).alias("taken"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return taken.unionByName(left_out.select(named, "n_rows", "n_bad", F.lit(False).alias("taken"), F.lit(None).cast("double").alias("total")))


@query("json_array_round_trip", "SELECT doc_id, lang, n_chars, sha256(coalesce(text, '')) AS digest FROM documents")
def json_array_round_trip(spark, d):
    """Documents as JSON arrays, one per file, read back item by item from byte ranges."""
    folder = scratch_path(spark, "arrays")
    lines = table(spark, d, "documents").select(F.to_json(F.struct("doc_id", "lang", "n_chars", "text")).alias("value"))

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = "["
        for batch in batches:
            if batch.num_rows:
                marks = pa.array([mark, *[","] * (batch.num_rows - 1)])
                yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(marks, batch.column("value"), "")], ["value"])
                mark = ","
        yield pa.RecordBatch.from_arrays([pa.array(["]" if mark == "," else "[]"])], ["value"])

    lines.mapInArrow(arrays, "value string").write.text(folder)
    rows = json_items.read_json_array(spark, f"{folder}/*.txt", "doc_id bigint, lang string, n_chars bigint, text string", size=1 << 18)
    return rows.where("error IS NULL").select("doc_id", "lang", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


@query("status_csv_round_trip", f"""WITH {HEALTH_SQL} SELECT provider, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'error') AS error FROM health GROUP BY 1""")
def status_csv_round_trip(spark, d):
    matrix = health(spark, d).groupBy("provider").agg(F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "error").alias("error"))
    path = scratch_path(spark, "status")
    W.status_summary_csv(matrix, path)
    return R.read_csv(spark, path, schemas.struct(provider=schemas.S, ok=schemas.L, error=schemas.L))


@query("truth_documents", "SELECT lang AS domain, doc_id AS question_id, sha256(coalesce(text, '')) AS answer_digest, n_chars AS length FROM documents")
def truth_documents(spark, d):
    """Answers as one JSON text per question, and what the texts hold."""
    answers = table(spark, d, "documents").select(
        F.col("lang").alias("domain"), F.col("doc_id").alias("question_id"), F.coalesce("text", F.lit("")).alias("answer"), F.struct(F.col("n_chars").alias("length")).alias("details"))
    held = F.from_json("document", "answer string, details struct<length: bigint>")
    return W.truth_document(answers).select("domain", "question_id", held.alias("h")).select(
        "domain", "question_id", F.sha2("h.answer", 256).alias("answer_digest"), F.col("h.details.length").alias("length"))


@query("registration_round_trip", """SELECT c_custkey, lower(replace(c_name, '#', '.')) || '@example.org' AS email,
    CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS signature FROM customer""")
def registration_round_trip(spark, d):
    """Registrations with markup in them, appended in two parts and read back clean."""
    people = table(spark, d, "customer").select(
        "c_custkey", F.concat(F.lit("<i>"), F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("</i>@example.org ")).alias("email"),
        F.when(F.col("c_custkey") % 3 == 0, " <br> ").otherwise(F.concat(F.lit(" <b>"), "c_name", F.lit("</b>"))).alias("signature"))
    path = scratch_path(spark, "people")
    for part in (0, 1):
        W.register_people(people.where(F.col("c_custkey") % 2 == part), path)
    return spark.read.parquet(path).where("timestamp IS NOT NULL").select("c_custkey", "email", "signature")


@query("registration_audit", """SELECT count(*) AS registered, count(*) AS with_email, count(*) FILTER (c_custkey % 3 <> 0) AS with_signature FROM customer""")
def registration_audit(spark, d):
    people = table(spark, d, "customer").select(F.lit("a@example.org").alias("email"), F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_name")).alias("signature"))
    audit = W.register_people(people, scratch_path(spark, "people"))
    return audit.agg(F.count(F.lit(1)).alias("registered"), F.count_if("has_email").alias("with_email"), F.count_if("has_signature").alias("with_signature"))


@query("selection_round_trip", """SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'r0' WHEN 1 THEN 'r1' WHEN 2 THEN 'r2' END AS selected_response_id,
    CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS comment, user_id % 4 + 1 AS step FROM events""")
def selection_round_trip(spark, d):
    """Chosen labels resolved by the blind map; the fourth label is in no map."""
    labels = F.create_map(*[x for i, label in enumerate("ABC") for x in (F.lit(label), F.lit(f"r{i}"))])
    place = F.col("user_id") % 4
    chosen = table(spark, d, "events").select(
        "event_id", F.element_at(F.array(*[F.lit(c) for c in "ABCD"]), (place + 1).cast("int")).alias("selected_label"), labels.alias("blind_map"),
        F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("comment"), place.alias("step"))
    path = scratch_path(spark, "selections")
    W.append_rows(W.resolved_selections(chosen).drop("blind_map"), path)
    return spark.read.parquet(path).select("event_id", "selected_response_id", "comment", "step")


@query("identifiers", """SELECT c_custkey, 'auto_test_' || lpad(c_custkey::VARCHAR, greatest(3, length(c_custkey::VARCHAR))::INT, '0') AS test_id,
    true AS session_shape, true AS evaluation_shape FROM customer""")
def identifiers(spark, d):
    """Identifiers made from time and row number; what depends on the clock is checked by its form."""
    made = W.identified(table(spark, d, "customer").select("c_custkey"), "c_custkey")
    return made.select(
        "c_custkey", "test_id", F.col("session_id").rlike("^session_[0-9]{9,}_[0-9a-f]{8}$").alias("session_shape"),
        F.col("evaluation_id").rlike("^eval_[0-9]{8}_[0-9]{6}$").alias("evaluation_shape"))


@query("display_names", """SELECT name, array_to_string(list_transform(string_split(replace(name, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS shown
    FROM (SELECT DISTINCT event_type || '_of_' || lower(o_orderstatus) AS name FROM events JOIN orders ON user_id = o_orderkey)""")
def display_names(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("user_id"), F.lower("o_orderstatus").alias("state"))
    names = table(spark, d, "events").join(orders, "user_id").select(F.concat_ws("_of_", "event_type", "state").alias("name")).distinct()
    return names.select("name", X.display_name("name").alias("shown"))
