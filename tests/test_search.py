import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.operators import chunking as C
from scorelake.operators import retrieval as R
from scorelake.plans import search  # noqa: F401  (registers the queries)
from scorelake.plans.registry import QUERIES


def brute_chunks(t, size, overlap):
    w = t.split()
    if not w:
        return []
    if len(w) <= size:
        return [(0, len(w), t)]
    out, start = [], 0
    while True:
        end = min(start + size, len(w))
        out.append((start, end, " ".join(w[start:end])))
        if end == len(w):
            return out
        start = end - overlap


@pytest.mark.parametrize("size,overlap", [(5, 2), (4, 0), (10, 9)])
def test_chunk_edges(spark, size, overlap):
    texts = ["", "  ", *[" ".join(f"w{i}" for i in range(n)) for n in (1, size, size + 1, 2 * size, 37)], "a  b\nc"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc long, t string")
    got = {}
    for r in C.chunk_text(df, "t", "doc", size, overlap).collect():
        got.setdefault(r.doc, []).append((r.chunk_index, r.start_index, r.end_index, r.chunk_text))
    for i, t in enumerate(texts):
        assert [x[1:] for x in sorted(got.get(i, []))] == brute_chunks(t, size, overlap)
    with pytest.raises(ValueError):
        C.chunk_text(df, "t", "doc", 5, 5)


@pytest.fixture(scope="module")
def blocks(spark):
    rows = spark.range(0, 325).select(
        "id", F.timestamp_micros(F.col("id") * 60_000_000).alias("ts"), F.col("id").cast("double").alias("up"),
        F.when(F.col("id") == 7, 1e6).otherwise(F.col("id") % 10).cast("double").alias("odd"),
        F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("kind"))
    return C.blocked(rows, "id", 150, "file.csv")


def test_block_profiles(blocks):
    ids = {r.chunk_id for r in blocks.select("chunk_id").distinct().collect()}
    assert ids == {"file.csv_0_149", "file.csv_150_299", "file.csv_300_324"}
    out = C.block_outliers(blocks, ["up", "odd"]).collect()
    assert [(r.chunk_id, r.column, r.outliers, r.outlier_values) for r in out] == [("file.csv_0_149", "odd", 1, [1e6])]
    trends = {(r.chunk_id, r.column): r.direction for r in C.block_trends(blocks, "ts", ["up"]).collect()}
    assert set(trends.values()) == {"increasing"}


def test_block_summary_text(blocks):
    out = {r.chunk_id: r.content for r in C.block_summaries(blocks, ["up", "odd"], ["kind"], "ts", ["id", "kind"]).collect()}
    lines = out["file.csv_300_324"].split("\n")
    assert lines[:4] == ["=== CHUNK SUMMARY ===", "Rows 300-324 (25 records)", "Source: file.csv", ""]
    assert "up:" in lines and "  Mean: 312.00, Median: 312.00" in lines
    assert "  Std: 7.36, Range: 300.00-324.00" in lines
    assert "  y: 16 (64.0%)" in lines and "  x: 9 (36.0%)" in lines
    assert "up trend: Increasing (r=1.000)" in lines
    assert lines[-3:] == ["Record 1: id: 300, kind: x", "Record 2: id: 301, kind: y", "Record 3: id: 302, kind: y"]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(600, 16))
    m[:200] = m[0]  # a third of the corpus are copies
    df = spark.createDataFrame([(i, f"s{i % 7}", m[i].tolist()) for i in range(600)], "vid long, source string, v array<double>")
    q = m[[0, 250, 400]] + rng.normal(scale=.1, size=(3, 16))
    queries = spark.createDataFrame([(i, q[i].tolist()) for i in range(3)], "qid long, v array<double>")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    uq = q / np.linalg.norm(q, axis=1, keepdims=True)
    scores = np.round(uq @ unit.T, 9)
    best = {(i, int(j)) for i in range(3) for j in np.lexsort((np.arange(600), -scores[i]))[:10]}
    return df, queries, best


def test_exact_paths_agree(vectors):
    df, queries, best = vectors
    for bound in (10**6, 40):
        out = R.cosine_topk(queries, df, "qid", "vid", "v", 10, slice_rows=bound).collect()
        assert {(r.qid, r.vid) for r in out} == best
        assert sorted(r["rank"] for r in out if r.qid == 0) == list(range(1, 11))


def test_hot_cell_is_cut_into_slices(vectors):
    df, queries, best = vectors
    one = F.lit(0)
    out = R.cell_topk(queries.withColumn("cell", one), df.withColumn("cell", one), "qid", "vid", "v", 10, slice_rows=50, query_rows=2)
    assert {(r.qid, r.vid) for r in out.collect()} == best


def test_fewer_vectors_than_k(vectors, spark):
    df, queries, _ = vectors
    assert R.cosine_topk(queries, df.where("vid < 4"), "qid", "vid", "v", 10).count() == 12
    assert R.cosine_topk(queries.where("qid < 0"), df, "qid", "vid", "v", 10).count() == 0


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_recall_of_registered_queries(spark, size):
    def pairs(name):
        return {(r.label, r.vec_id) for r in QUERIES[name](spark, f"/root/testdata/{size}").collect()}

    best = pairs("cosine_topk")
    for name in ("ann_cells", "ann_hyperplanes"):
        share = len(pairs(name) & best) / len(best)
        print(size, name, share)
        assert share >= 0.9


def test_quality_and_contexts(spark):
    queries = spark.createDataFrame([(1,), (2,)], "qid long")
    found = spark.createDataFrame([(1, 1, .9, "s", "x" * 30), (1, 2, .5, "s", "y" * 900), (1, 3, .4, "t", "z")],
                                  "qid long, rank int, score double, source string, text string")
    out = {r.qid: r for r in R.retrieval_quality(queries, found, "qid", "source", F.lit(10)).collect()}
    assert abs(out[1].avg_similarity - .6) < 1e-12 and out[1].coverage == .3 and abs(out[1].diversity - 2 / 3) < 1e-12
    assert out[2].num_chunks == 0 and out[2].avg_similarity == 0.0
    text = {r.qid: r.context for r in R.format_contexts(queries, found, "qid", "text", 200).collect()}
    # the second chunk overflows the budget, so the third is not tried
    assert text[1] == "[Document 1] (Similarity: 0.900)\n" + "x" * 30 + "\n"
    assert text[2] == "No relevant documents found."


def test_prompt(spark):
    asked = spark.createDataFrame([("q1", "Compare sales", "retail_01"), ("q2", "x", "other")], "query_id string, query_text string, question_id string")
    chunks = spark.createDataFrame(
        [("c0", "f.csv", 0, 9, "body0", ["  a: μ=1.00"]), ("c1", "f.csv", 10, 19, "body1", None)],
        "chunk_id string, source_file string, start_row int, end_row int, content string, stat_lines array<string>")
    found = spark.createDataFrame([("q1", "c1", .5, 2), ("q1", "c0", .75, 1)], "query_id string, chunk_id string, score double, rank int")
    truth = spark.createDataFrame([("retail_01", ["k1"], ["f1", "f2"], "long")], "question_id string, key_points array<string>, factual_claims array<string>, expected_length string")
    out = {r.query_id: r for r in R.prompt_contexts(asked, found, chunks, "query_id", "query_text", "question_id", "chunk_id", 8, truth).collect()}
    text = out["q1"].context
    assert text.index("[Enhanced Data Chunk 1] (Relevance: 0.750)") < text.index("[Enhanced Data Chunk 2] (Relevance: 0.500)")
    for line in ("• k1", "• f2", "Expected analysis depth: long", "• Effect size calculations", "Total dataset chunks: 2",
                 "=== ENHANCED DATASET INFORMATION (100.0% Coverage) ===", "Statistical Summary:", "Rows: 10-19"):
        assert line in text.split("\n")
    assert out["q2"].context == "No relevant data found."


def test_truth_contexts(spark):
    rows = spark.createDataFrame(
        [("q", "Why?", "retail", ["a", "b", "c", "d", "e"], ["f"], "medium", {"data_source": "CSV"})],
        "question_id string, question string, domain string, key_points array<string>, factual_claims array<string>, expected_length string, metadata map<string,string>")
    r = R.truth_contexts(rows).first()
    assert "Data source: CSV" in r.full_context and "Key insights: a, b, c, d, e" in r.full_context
    assert r.limited_context.endswith("Available dataset insights: a, b") and r.key_points_count == 5


def test_given_encoder(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "abcd"), (3, None)], "id long, t string")
    out = {r.id: r.embedding for r in R.encode(df, "t", lambda texts: np.array([[len(t), 1.0] for t in texts])).collect()}
    assert out == {1: [2.0, 1.0], 2: [4.0, 1.0], 3: [0.0, 1.0]}


def test_results_merge_over_small_batches(vectors, spark):
    df, queries, best = vectors
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = R.cosine_topk(queries, df, "qid", "vid", "v", 10).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {(r.qid, r.vid) for r in out} == best


def test_prompt_lines_of_blocks(spark):
    """Figures, trends and outliers of row blocks reach the prompt."""
    rows = spark.range(60).select("id", F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") * 2.0).alias("up"), F.when(F.col("id") == 7, 900.0).otherwise(F.col("id") % 3).alias("odd"))
    blocks = C.blocked(rows, "id", 30, "f.csv")
    lines = {r.chunk_id: r for r in C.block_lines(blocks, ["up", "odd"], "ts").collect()}
    first = next(r for k, r in lines.items() if "_0_" in k)
    assert first.stat_lines[0] == "  up: μ=29.00, σ=17.61, range=[0.00-58.00]" and first.trend_lines[0] == "  up: increasing (r=1.000)"
    assert first.outlier_lines == ["  odd: 1 outliers (3.3%)"] and sum(len(r.outlier_lines) for r in lines.values()) == 1


def test_blocks_of_long_vectors_hold_fewer_rows(spark, monkeypatch):
    """a task's vectors are bounded in numbers, not in rows alone, and are not taken apart into Python objects."""
    monkeypatch.setattr(R, "SLICE_NUMBERS", 160)
    rng = np.random.default_rng(2)
    x = np.round(rng.standard_normal((60, 16)), 3)
    rows = spark.createDataFrame([(f"v{i:02d}", v) for i, v in enumerate(x.tolist())] + [("zero", [0.0] * 16), ("none", None)], "id string, v array<float>")
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(25)], "q long, v array<double>")
    out = R.cosine_topk(asked, rows, "q", "id", "v", 4)
    plan = out._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "InPandas" not in plan
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {(r.q, r["rank"]): (r.id, r.score) for r in out.collect()}
    for q, line in enumerate(unit[:25] @ unit.T):
        for rank, i in enumerate(np.argsort(-line)[:4], 1):
            assert got[q, rank][0] == f"v{i:02d}" and abs(got[q, rank][1] - line[i]) < 1e-6
