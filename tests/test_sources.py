import gzip
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from scorelake import schemas
from scorelake.functions import text
from scorelake.operators import stats as S
from scorelake.operators.evallog import best_and_worst
from scorelake.sources import json_items
from scorelake.sources import readers as R
from scorelake.sources import writers as W


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Open,High,Low,Close,Volume\n2020-01-02,1,2,0.5,1.5,10\n2020-01-03,1,2,0.5,1.5,x\n")
    bars = R.read_bars(spark, str(tmp_path / "a.csv"))
    assert bars.dtypes[0] == ("Date", "date") and bars.count() == 2
    assert bars.orderBy("Date").first().Date.isoformat() == "2020-01-02"
    inferred = R.read_csv(spark, str(tmp_path / "a.csv"))
    assert dict(inferred.dtypes)["Open"] == "int"


def test_many_files_and_discovery(spark, tmp_path):
    (tmp_path / "long.csv").write_text("a,b\n" + "".join(f"{i},{i}\n" for i in range(11)))
    (tmp_path / "short.csv").write_text("a,b\n" + "".join(f"{i},{i}\n" for i in range(10)))
    (tmp_path / "list.json").write_text(json.dumps(list(range(6))))
    (tmp_path / "few.json").write_text(json.dumps([1, 2]))
    (tmp_path / "user_feedback.json").write_text(json.dumps(list(range(9))))
    (tmp_path / "map.json").write_text(json.dumps({"a": 1}))
    assert [tuple(r) for r in R.discover_csv(spark, str(tmp_path)).collect()] == [("long.csv", 11)]
    assert [tuple(r) for r in R.discover_json(spark, str(tmp_path)).collect()] == [("list.json", 6)]
    both, left_out = R.read_many_csv(spark, [str(tmp_path / "long.csv"), str(tmp_path / "short.csv")], schemas.struct(a=schemas.L, b=schemas.L))
    assert left_out.count() == 0 and {(r.source_file, r["count"]) for r in both.groupBy("source_file").count().collect()} == {("long.csv", 11), ("short.csv", 10)}


def test_nested_documents(spark, tmp_path):
    by_provider = {"responses": {"q1": {"question": "?", "domain": "retail", "rag_context": "c", "llm_responses": {
        "p": {"response": "a b", "model_name": "m", "provider": "p", "metadata": {"latency": 1.5, "token_count": 3}},
        "r": {"response": "c", "model_name": "n", "provider": "r", "metadata": {"latency": 2.5}}}}}}
    (tmp_path / "p.json").write_text(json.dumps(by_provider, indent=1))
    rows = R.explode_by_provider(R.read_json(spark, str(tmp_path / "p.json"), schemas.RESPONSES_BY_PROVIDER))
    assert {(r.question_id, r.provider, r.latency) for r in rows.collect()} == {("q1", "p", 1.5), ("q1", "r", 2.5)}
    listed = {"responses_by_domain": {"retail": [
        {"question": "a", "context": "", "responses": [{"model": "m", "provider": "p", "response": "x", "metadata": {"has_error": False}}]},
        {"question": "b", "context": "", "responses": [{"model": "m", "provider": "p", "response": "", "metadata": {"has_error": True}}]}]}}
    (tmp_path / "d.json").write_text(json.dumps(listed, indent=1))
    rows = R.explode_by_domain(R.read_json(spark, str(tmp_path / "d.json"), schemas.RESPONSES_BY_DOMAIN))
    assert {(r.domain, r.q_idx, r.has_error) for r in rows.collect()} == {("retail", 0, False), ("retail", 1, True)}
    pool = {"retail": {"questions": [{"id": "r1", "question": "a"}, {"id": "r2", "question": "b"}], "context": "ctx", "evaluation_criteria": "e"}}
    (tmp_path / "pool.json").write_text(json.dumps(pool))
    got = R.read_question_pool(spark, str(tmp_path / "pool.json")).collect()
    assert {(r.domain, r.question_idx, r.id, r.context) for r in got} == {("retail", 0, "r1", "ctx"), ("retail", 1, "r2", "ctx")}


def test_event_log_append_and_stream(spark, tmp_path):
    path = str(tmp_path / "log")
    events = spark.createDataFrame(
        [("p", "groq", "m", "r", 1.0, 2, .5, None, "run1")],
        "prompt string, provider string, model string, response string, latency double, tokens long, score double, timestamp timestamp, run_id string")
    W.append_events(events, path)
    W.append_events(events, path)
    back = R.read_events(spark, path)
    assert back.count() == 2 and back.where("timestamp IS NULL").count() == 0 and back.first().provider == "groq"
    stats = R.file_stats(spark, path).first()
    assert stats.total_entries == 2 and stats.files == 2 and stats.size_mb > 0
    flow = R.stream_events(spark, path).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    flow.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_feedback_export(spark, tmp_path):
    log = spark.createDataFrame(
        [("s", "industry_feedback", "retail", {"quality": 4}, ["x"]), ("s", "session_event", None, {}, [])],
        "session_id string, record_type string, industry string, ratings map<string,int>, response_order array<string>")
    path = W.export_feedback(log, str(tmp_path / "csv"), ["quality"])
    rows = R.read_csv(spark, path).collect()
    assert len(rows) == 1 and rows[0].quality == 4
    assert W.export_feedback(log.where("session_id = 'none'"), str(tmp_path / "none"), ["quality"]) == ""


def test_evaluation_round_trip(spark, tmp_path):
    folder = str(tmp_path)
    for name in ("eval_20240101_000000", "eval_20240102_000000"):
        rows = spark.createDataFrame([(name, "p", .5)], "evaluation_id string, provider string, overall_score double")
        W.save_evaluation(rows, rows, rows, folder)
    assert [r.evaluation_id for r in R.evaluation_history(spark, folder).collect()] == ["eval_20240102_000000", "eval_20240101_000000"]
    assert R.load_evaluation(spark, folder, "eval_20240101_000000").count() == 1
    assert R.load_evaluation(spark, folder, "missing") is None
    plan = R.load_evaluation(spark, folder, "eval_20240101_000000")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(evaluation_id" in plan


def test_snapshots_vectors_and_exports(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0])], "chunk_id int, v array<double>")
    for stamp in ("20240101", "20240102"):
        W.snapshot(rows, str(tmp_path / "snap"), stamp)
    assert spark.read.parquet(str(tmp_path / "snap/history")).count() == 2
    assert spark.read.parquet(str(tmp_path / "snap/current")).count() == 1
    W.save_vectors(rows, {"model": "x", "size": 300}, str(tmp_path / "vec"))
    chunks, settings = R.load_vectors(spark, str(tmp_path / "vec"))
    assert chunks.count() == 1 and settings == {"model": "x", "size": "300"}
    W.export_json(rows, str(tmp_path / "json"), "s1", "u")
    assert spark.read.json(str(tmp_path / "json")).first().export_session == "s1"
    W.append_rows(rows, str(tmp_path / "rows"))
    W.append_rows(rows, str(tmp_path / "rows"))
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 2


def test_registration_and_selection(spark, tmp_path):
    people = spark.createDataFrame([("<b>a@x.org</b>", " Jo ")], "email string, signature string")
    audit = W.register_people(people, str(tmp_path / "people")).first()
    assert (audit.has_email, audit.has_signature) == (True, True)
    assert spark.read.parquet(str(tmp_path / "people")).first().email == "a@x.org"
    chosen = spark.createDataFrame([("B", {"A": "r1", "B": "r2"}, None, 1)], "selected_label string, blind_map map<string,string>, comment string, step int")
    r = W.resolved_selections(chosen).first()
    assert (r.selected_response_id, r.comment, r.step) == ("r2", "", 2)
    ids = W.identified(spark.createDataFrame([(7,)], "n int"), "n").first()
    assert ids.test_id == "auto_test_007" and ids.session_id.startswith("session_") and ids.evaluation_id.startswith("eval_20")


def test_report(spark, tmp_path):
    df = spark.createDataFrame([("a", .9), ("a", .8), ("b", .5), ("b", .4)], "provider string, score double")
    m = S.moments(df, "provider", "score")
    ranked = S.rank_groups(S.with_interval(m)).withColumn("std", F.sqrt("var")).withColumnRenamed("grp", "provider")
    ends = best_and_worst(m, "grp", "mean")
    overall = ends.select("best", "worst", F.lit(4).alias("evaluations"), F.lit(.65).alias("avg_overall"), F.lit(10.0).alias("avg_time_ms"))
    lines = W.report_lines("e1", ranked, S.anova_p(S.anova(m)), overall)
    W.write_report(lines, str(tmp_path / "txt"))
    out = [r.value for r in spark.read.text(str(tmp_path / "txt")).collect()]
    assert out[0] == "EVALUATION SUMMARY REPORT" and "Evaluation ID: e1" in out
    assert out.index("a:") < out.index("b:") < out.index("STATISTICAL SIGNIFICANCE") < out.index("Best Provider: a")
    assert "  Mean Score: 0.8500" in out


def test_catalogue_and_names(spark):
    assert spark.range(1).select(text.display_name(F.lit("overall_score"))).first()[0] == "Overall Score"
    truth = spark.createDataFrame([("retail", "q1", "a", {"k": "v"})], "domain string, question_id string, answer string, details map<string,string>")
    assert json.loads(W.truth_document(truth).first().document) == {"answer": "a", "details": {"k": "v"}}


def test_damaged_files_are_left_out_whole(spark, tmp_path):
    good, bad, cut, missing = (str(tmp_path / n) for n in ("good.csv", "bad.csv", "cut.csv.gz", "none.csv"))
    Path(good).write_text("a,b\n1,x\n2,y\n")
    Path(bad).write_text("a,b\n3,x\nfour,y\n5,z\n")
    whole = gzip.compress(("a,b\n" + "".join(f"{i},{i * 7919}\n" for i in range(20_000))).encode())
    Path(cut).write_bytes(whole[:len(whole) // 2])
    rows, left_out = R.read_many_csv(spark, [good, bad, cut, missing], schemas.struct(a=schemas.L, b=schemas.S))
    assert sorted((r.a, r.b, r.source_file) for r in rows.collect()) == [(1, "x", "good.csv"), (2, "y", "good.csv")]
    found = {r.source_file: r for r in left_out.collect()}
    assert found.keys() == {"bad.csv", "cut.csv.gz", "none.csv"} and (found["bad.csv"].n_rows, found["bad.csv"].n_bad) == (3, 1)
    assert "four,y" in found["bad.csv"].reason and found["none.csv"].reason == "missing" and "end" in found["cut.csv.gz"].reason
    none, all_ = R.read_many_csv(spark, [missing], schemas.struct(a=schemas.L, b=schemas.S))
    assert none.count() == 0 and none.columns == ["a", "b", "source_file", "source_path"] and all_.count() == 1


def awkward(rnd, depth=0):
    kind = rnd.randint(0, 5 if depth < 3 else 2)
    if kind <= 2:
        return rnd.choice([1, -2.5e3, True, None, "", 'a"b\\', "\\\\", "[{,:", "é日😀", "x" * rnd.randint(0, 30), "\n\t\\\""])
    if kind == 3:
        return [awkward(rnd, depth + 1) for _ in range(rnd.randint(0, 4))]
    return {rnd.choice(["k", 'q"', "a,b:{", "\\"]) + str(i): awkward(rnd, depth + 1) for i in range(rnd.randint(0, 4))}


@pytest.mark.parametrize("size", [1, 3, 17, 1 << 20])
def test_items_whatever_the_ranges(tmp_path, size):
    """Any cut into ranges gives each item once, wherever strings and escapes are cut."""
    rnd = random.Random(size)
    for case in range(25):
        whole = [awkward(rnd) for _ in range(rnd.randint(0, 6))] if case % 2 else {f"k{i}": awkward(rnd) for i in range(rnd.randint(0, 6))}
        path = tmp_path / f"{case}.json"
        path.write_text(json.dumps(whole, ensure_ascii=bool(case % 3), indent=rnd.choice([None, 1])), encoding="utf-8")
        inside, depth, found, length = False, 0, [], path.stat().st_size
        for start in range(0, length, size):
            end = min(length, start + size)
            found += json_items.items(str(path), start, end, inside, depth)
            turns, outside, within = json_items.range_effect(str(path), start, end)
            depth += within if inside else outside
            inside ^= turns
        assert (depth, inside) == (0, False) and not any(e for _, _, _, e in found)
        values = [json.loads(v) for _, _, v, _ in found]
        assert (values if case % 2 else dict(zip([k for _, k, _, _ in found], values))) == whole


def test_a_large_array_is_read_by_several_tasks(spark, tmp_path):
    whole = [{"id": i, "name": f'n "{i}" [', "tags": ["a,b"] * (i % 4)} for i in range(20_000)]
    path = tmp_path / "large.json"
    path.write_text(json.dumps(whole))
    found = json_items.read_json_items(spark, str(path), 1 << 16)
    tasks = found.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(tasks) == -(-path.stat().st_size // (1 << 16)) and max(r["count"] for r in tasks) < 0.2 * len(whole)
    rows = json_items.read_json_array(spark, str(path), "id long, name string, tags array<string>", 1 << 16)
    assert sorted((r.id, r.name, r.tags) for r in rows.drop("error").collect()) == [(x["id"], x["name"], x["tags"]) for x in whole]
    path.write_text(json.dumps(whole)[:-30])  # the end is lost
    errors = json_items.read_json_items(spark, str(path), 1 << 16).where("error IS NOT NULL").collect()
    assert len(errors) == 1 and errors[0].error.startswith("unfinished item") and errors[0].value is None
    (tmp_path / "odd.json").write_text('[1,,"a"]')
    assert [(r.value, r.error) for r in json_items.read_json_items(spark, str(tmp_path / "odd.json")).orderBy("at").collect()] == [("1", None), (None, "empty item"), ('"a"', None)]


def test_small_ranges_are_read_together(spark, tmp_path):
    """neighbouring ranges of a file are one partition, a few a core; each range was one, however small."""
    path = tmp_path / "many.json"
    path.write_text("[" + ",".join(f'{{"id": {i}, "t": "a, [b] \\\\\\" {i}"}}' for i in range(20_000)) + "]")
    found = json_items.read_json_array(spark, str(path), "id long, t string", 1 << 10)
    ranges = json_items.ranges_of(spark, str(path), 1 << 10)
    assert len(ranges) > 200 and found.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert sorted((r.id, r.t, r.error) for r in found.collect()) == [(i, f'a, [b] \\" {i}', None) for i in range(20_000)]
    assert json_items.joined([("a", 0, 4, False, 0), ("a", 4, 8, True, 1), ("a", 8, 9, False, 1), ("b", 0, 4, False, 0)], 8) == [
        ("a", 0, 8, False, 0), ("a", 8, 9, False, 1), ("b", 0, 4, False, 0)]
