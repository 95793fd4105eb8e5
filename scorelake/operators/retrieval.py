"""Vector search, retrieval quality and prompt contexts.

The exact search is a block join: a matrix product of a block of queries with a block of
vectors that keeps only the best ``k`` per query.  No (query, vector) pair ever becomes a
row; each task hands on at most ``k`` rows per query.  Stored indexes are in ``vector_index``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.functions import text as X
from scorelake.operators.windows import within_budget

SLICE_ROWS = 50_000  # vectors in one task of the block join, at most
SLICE_NUMBERS = 1 << 22  # numbers of those vectors, 32 MB
QUERY_ROWS = 2_000  # queries in one task of the block join


def l2_norm(vector: str) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def normalised(df: DataFrame, vector: str) -> DataFrame:
    unit = F.transform(vector, lambda x: x.cast("double") / F.col("_norm"))
    scaled = F.when(F.col("_norm") > 0, unit).otherwise(F.transform(vector, lambda x: x.cast("double")))
    return df.withColumn("_norm", l2_norm(vector)).withColumn(vector, scaled).drop("_norm")


def with_vectors(df: DataFrame, vector: str) -> DataFrame:
    """Rows that have a vector; one with a missing number counts as none."""
    return df.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))


def _unit_rows(vectors) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype="float64") for v in vectors])
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms > 0, norms, 1.0)


def _unit_matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """The same from Arrow's own numbers, batch by batch, so that there is one copy beside them."""
    out, at = np.empty((len(vectors), len(vectors[0]))), 0
    for part in vectors.chunks:
        if not pc.all(pc.equal(pc.list_value_length(part), out.shape[1])).as_py():
            raise ValueError("vectors differ in length")
        rows = part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), out.shape[1])
        norms = np.sqrt(np.einsum("ij,ij->i", rows, rows, dtype="float64"))
        np.divide(rows, np.where(norms > 0, norms, 1.0)[:, None], out=out[at:at + len(part)])
        at += len(part)
    return out


TILE_SCORES = 1 << 19  # scores computed at a time, 4 MB


def _best(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int):
    """Query row, id and score of the k best vectors per query; ties go to the lower id."""
    step = max(1, TILE_SCORES // max(1, len(ids)))
    found = []
    for at in range(0, len(queries), step):
        rows, chosen, values = _best_of_tile(queries[at:at + step], ids, vectors, k)
        found.append((rows + at, chosen, values))
    return tuple(np.concatenate(x) for x in zip(*found))


def _best_of_tile(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int):
    scores = np.round(queries @ vectors.T, 9)
    rows, chosen, values = [], [], []
    for i, line in enumerate(scores):
        if len(line) > k:
            cut = np.partition(line, len(line) - k)[len(line) - k]
            pick = np.flatnonzero(line >= cut)
        else:
            pick = np.arange(len(line))
        pick = pick[np.lexsort((ids[pick], -line[pick]))][:k]
        rows.append(np.full(len(pick), i))
        chosen.append(ids[pick])
        values.append(line[pick])
    return np.concatenate(rows), np.concatenate(chosen), np.concatenate(values)


def _result_schema(queries: DataFrame, query_id: str, corpus: DataFrame, corpus_id: str) -> T.StructType:
    return T.StructType([
        T.StructField(query_id, queries.schema[query_id].dataType),
        T.StructField(corpus_id, corpus.schema[corpus_id].dataType),
        T.StructField("score", T.DoubleType()),
    ])


def _ranked(partial: DataFrame, query_id: str, corpus_id: str, k: int) -> DataFrame:
    order = Window.partitionBy(query_id).orderBy(F.desc("score"), corpus_id)
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _merge(parts: list, k: int):
    """The k best of several (query row, id, score) results, per query row."""
    rows, ids, scores = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    first = np.searchsorted(rows, rows, side="left")
    keep = np.arange(len(rows)) - first < k
    return rows[keep], ids[keep], scores[keep]


def _cells(df: DataFrame, per_task: int) -> Column:
    """Map from cell to the number of slices its rows need; there are few cells."""
    sizes = df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / per_task).cast("int").alias("n"))
    return sizes.agg(F.map_from_entries(F.collect_list(F.struct("cell", "n")))).scalar()


def _spread(df: DataFrame, own: str, other: str, key: str) -> DataFrame:
    """Hash rows over their own slices and repeat them for every slice of the other side."""
    mine = F.pmod(F.xxhash64(key), F.element_at("_own", F.col("cell"))).cast("int")
    others = F.sequence(F.lit(0), F.element_at("_other", F.col("cell")) - 1)
    met = df.where(F.map_contains_key("_other", F.col("cell")))
    return met.withColumn(own, mine).withColumn(other, F.explode(others)).drop("_own", "_other")


def cell_topk(
    queries: DataFrame, corpus: DataFrame, query_id: str, corpus_id: str, vector: str, k: int,
    slice_rows: int = SLICE_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """Best ``k`` per query among the vectors that share one of its cells.

    Both sides carry ``cell``.  Every cell is cut into blocks of bounded size on both
    sides, so a cell that holds a third of the corpus becomes many tasks.  Long vectors make
    smaller blocks.
    """
    width = corpus.select(F.max(F.size(vector))).first()[0] or 1
    slice_rows, query_rows = (max(1, min(n, SLICE_NUMBERS // max(1, width))) for n in (slice_rows, query_rows))
    schema = _result_schema(queries, query_id, corpus, corpus_id)
    c_slices, q_slices = _cells(corpus, slice_rows), _cells(queries, query_rows)
    left = queries.select("cell", query_id, vector).withColumn("_own", q_slices).withColumn("_other", c_slices)
    right = corpus.select("cell", corpus_id, vector).withColumn("_own", c_slices).withColumn("_other", q_slices)
    left, right = _spread(left, "_q", "_c", query_id), _spread(right, "_c", "_q", corpus_id)
    keys = ["cell", "_q", "_c"]

    def search(q: pa.Table, c: pa.Table) -> pa.Table:
        r, ids, scores = np.zeros(0, np.int64), [], np.zeros(0)
        if q.num_rows and c.num_rows:
            r, ids, scores = _best(_unit_matrix(q[vector]), c[corpus_id].to_numpy(), _unit_matrix(c[vector]), k)
        return pa.table({query_id: q[query_id].take(pa.array(r)), corpus_id: pa.array(ids, c.schema.field(corpus_id).type), "score": pa.array(scores)})

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, schema)
    once = found.groupBy(query_id, corpus_id).agg(F.max("score").alias("score"))
    return _ranked(once, query_id, corpus_id, k)


def cosine_topk(
    queries: DataFrame, corpus: DataFrame, query_id: str, corpus_id: str, vector: str, k: int,
    slice_rows: int = SLICE_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """Exact cosine top-k: blocks of bounded size on both sides meet, whatever the number of queries."""
    zero = F.lit(0)
    queries, corpus = (with_vectors(x, vector).withColumn("cell", zero) for x in (queries, corpus))
    return cell_topk(queries, corpus, query_id, corpus_id, vector, k, slice_rows, query_rows)


def encode(df: DataFrame, text: str, encoder: Callable[[list[str]], np.ndarray], name: str = "embedding") -> DataFrame:
    """Vectors from a given encoder, called once per Arrow batch of texts."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(texts: pd.Series) -> pd.Series:
        return pd.Series(list(np.asarray(encoder(texts.fillna("").tolist()), dtype="float32")))

    return df.withColumn(name, vectors(text))


def store_stats(chunks: DataFrame, vector: str, source: str) -> DataFrame:
    return chunks.agg(
        F.count(F.lit(1)).alias("total_chunks"), F.max(F.size(vector)).alias("dimension"),
        F.countDistinct(source).alias("sources"),
    )


def retrieval_quality(
    queries: DataFrame, results: DataFrame, query_id: str, source: str, total_chunks: Column
) -> DataFrame:
    """Similarity range, coverage and source variety per query; zeros without results."""
    found = results.groupBy(query_id).agg(
        F.avg("score").alias("avg_similarity"), F.min("score").alias("min_similarity"),
        F.max("score").alias("max_similarity"), F.count(F.lit(1)).alias("num_chunks"),
        F.countDistinct(source).alias("num_sources"),
    )
    joined = queries.select(query_id).join(found, query_id, "left").withColumn("_total", total_chunks)
    zero = F.lit(0)
    return joined.select(
        query_id,
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("avg_similarity", "min_similarity", "max_similarity")],
        F.coalesce(F.col("num_chunks") / F.col("_total"), F.lit(0.0)).alias("coverage"),
        F.coalesce(F.col("num_sources") / F.col("num_chunks"), F.lit(0.0)).alias("diversity"),
        F.coalesce("num_chunks", zero).alias("num_chunks"), F.coalesce("num_sources", zero).alias("num_sources"),
    )


def format_contexts(
    queries: DataFrame, results: DataFrame, query_id: str, text: str, budget: int = 2000, length: str | None = None
) -> DataFrame:
    """Context per query within a character budget; at most the retrieved k chunks meet.

    With ``length``, the texts' lengths, texts over the budget may be left out.
    """
    header = F.format_string("[Document %d] (Similarity: %.3f)\n", F.col("rank"), F.col("score"))
    pieces = results.withColumn("_piece", F.concat(header, text, F.lit("\n")))
    size = F.length("_piece") if length is None else F.length(header) + F.col(length) + 1
    kept = within_budget(pieces, [query_id], "rank", size, budget)
    joined = kept.groupBy(query_id).agg(
        F.concat_ws("\n", F.transform(
            F.sort_array(F.collect_list(F.struct("rank", "_piece"))), lambda s: s["_piece"])).alias("context"),
        F.count(F.lit(1)).alias("chunks_used"),
    )
    return queries.select(query_id).join(joined, query_id, "left").select(
        query_id, F.coalesce("context", F.lit("No relevant documents found.")).alias("context"),
        F.coalesce("chunks_used", F.lit(0)).alias("chunks_used"),
    )


# --- fixed values: prose that prompts and contexts must hold word for word, the section titles in the two functions below included ---
LIMITED_INSTRUCTIONS = (
    "Instructions: Use the available dataset information ({} coverage) along with the ground truth insights above to provide a comprehensive business "
    "analysis. The ground truth serves as a reference for what information should be included and verified."
)
CLOSING = (
    "=== CROSS-CHUNK ANALYSIS INSTRUCTIONS ===",
    "Use the enhanced dataset information above to provide a comprehensive business analysis.",
    "Consider patterns across multiple chunks and identify overarching trends.",
    "Focus on accuracy, relevance, and actionable insights for the business question.",
    "",
    "Key analysis requirements:",
    "• Synthesize information across multiple data chunks",
    "• Identify patterns and trends in the data",
    "• Provide specific, actionable business insights",
    "• Support conclusions with data evidence",
)


def _bullets(items: Column) -> Column:
    return F.transform(items, lambda x: F.concat(F.lit("• "), x))


def prompt_contexts(
    queries: DataFrame, results: DataFrame, chunks: DataFrame, query_id: str, query_text: str,
    question_id: str, chunk_id: str, top_k: int, truth: DataFrame | None = None,
) -> DataFrame:
    """Full analysis prompt per query.

    ``chunks`` holds chunk_id, source_file, start_row, end_row, content and the optional
    line arrays stat_lines, trend_lines, outlier_lines; ``truth`` holds question_id,
    key_points, factual_claims, expected_length.
    """
    empty = F.array().cast("array<string>")
    total = chunks.agg(F.count(F.lit(1))).scalar()
    met = results.join(chunks, chunk_id)
    sections = []
    for column, title in (
        ("stat_lines", "Statistical Summary:"), ("trend_lines", "Trend Analysis:"), ("outlier_lines", "Outlier Detection:"),
    ):
        if column in chunks.columns:
            lines = F.coalesce(column, empty)
            sections.append(
                F.when(F.size(lines) > 0, F.concat(F.array(F.lit(title)), lines, F.array(F.lit("")))).otherwise(empty)
            )
    piece = F.concat(
        F.array(
            F.format_string("[Enhanced Data Chunk %d] (Relevance: %.3f)", "rank", "score"),
            F.concat(F.lit("Source: "), "source_file"),
            F.concat(F.lit("Rows: "), "start_row", F.lit("-"), "end_row"),
            F.concat(F.lit("Chunk ID: "), chunk_id), F.lit(""),
        ),
        *sections, F.array(F.col("content"), F.lit("")),
    )
    gathered = met.groupBy(query_id).agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("rank", piece.alias("p")))), lambda s: s["p"])).alias("_pieces"),
        F.count(F.lit(1)).alias("_found"),
    )
    out = queries.withColumn("_total", total).join(gathered, query_id, "left")
    guided = F.lit(False)
    opening = empty
    if truth is not None:
        out = out.join(truth.withColumn("_guided", F.lit(True)), question_id, "left")
        guided = F.coalesce("_guided", F.lit(False))
        opening = F.concat(
            F.array(F.lit("=== ENHANCED GROUND TRUTH GUIDANCE ==="), F.concat(F.lit("Question: "), query_text),
                    F.lit(""), F.lit("Key insights to consider:")),
            _bullets(F.coalesce("key_points", empty)), F.array(F.lit(""), F.lit("Factual claims to verify:")),
            _bullets(F.coalesce("factual_claims", empty)),
            F.array(F.lit(""), F.concat(F.lit("Expected analysis depth: "), F.coalesce("expected_length", F.lit("medium"))), F.lit("")),
        )
    hint = X.guidance(query_text)
    percent = F.least(F.lit(top_k), F.col("_total")) / F.col("_total") * 100
    lines = F.concat(
        F.when(guided, opening).otherwise(empty),
        F.array(F.lit("=== DYNAMIC ANALYSIS GUIDANCE ==="), F.lit("Analysis focus areas:")), _bullets(hint["focus"]),
        F.array(F.lit(""), F.lit("Data requirements:")), _bullets(X.requirements(question_id)),
        F.array(F.lit(""), F.format_string("=== ENHANCED DATASET INFORMATION (%.1f%% Coverage) ===", percent),
                F.concat(F.lit("Total dataset chunks: "), F.col("_total").cast("string")),
                F.concat(F.lit("Retrieved chunks: "), F.col("_found").cast("string")), F.lit("")),
        F.col("_pieces"), F.array(*[F.lit(x) for x in CLOSING]),
    )
    context = F.when(F.col("_found") > 0, F.concat_ws("\n", lines)).otherwise("No relevant data found.")
    return out.select(query_id, F.coalesce("_found", F.lit(0)).alias("chunks_used"), context.alias("context"))


def truth_contexts(truth: DataFrame, coverage: float = 0.4) -> DataFrame:
    """Full and limited reference contexts with their lengths, counts and quality."""
    points, claims = F.concat_ws(", ", "key_points"), F.concat_ws(", ", "factual_claims")
    source = F.coalesce(F.try_element_at("metadata", F.lit("data_source")), F.lit("Unknown"))
    kind = F.coalesce(F.try_element_at("metadata", F.lit("analysis_type")), F.lit("Unknown"))
    full = F.concat_ws(
        "\n", F.concat(F.lit("Complete dataset analysis for "), "domain", F.lit(" domain:")),
        F.concat(F.lit("Data source: "), source), F.concat(F.lit("Analysis type: "), kind),
        F.concat(F.lit("Key insights: "), points), F.concat(F.lit("Factual claims: "), claims),
        F.lit("Dataset coverage: 100.0% (Full access)"),
    )
    n = F.greatest(F.lit(1), F.floor(F.size("key_points") * coverage)).cast("int")
    some = F.concat(F.lit("Available dataset insights: "), F.concat_ws(", ", F.slice("key_points", F.lit(1), n)))
    limited = F.concat_ws(
        "\n", F.concat(F.lit("Business Analysis Task for "), "domain", F.lit(" domain:")),
        F.concat(F.lit("Question: "), "question"), F.lit(""),
        F.lit(f"Available Dataset Information ({coverage:.0%} coverage):"),
        F.concat(F.lit("Data source: "), source, F.lit(" (Partial access)")), F.concat(F.lit("Analysis type: "), kind),
        F.lit(f"Dataset coverage: {coverage * 100}% (Limited access)"), F.lit(""),
        F.lit("Ground Truth Reference (for guidance):"),
        F.concat(F.lit("Key insights to consider: "), points), F.concat(F.lit("Factual claims to verify: "), claims),
        F.concat(F.lit("Expected analysis depth: "), "expected_length"), F.lit(""), F.lit(LIMITED_INSTRUCTIONS.format(f"{coverage:.0%}")),
        F.when(F.size("key_points") > 0, some),
    )
    both = truth.withColumn("full_context", full).withColumn("limited_context", limited)
    return both.withColumns({
        "full_length": F.length("full_context"), "limited_length": F.length("limited_context"),
        "key_points_count": F.size("key_points"), "factual_claims_count": F.size("factual_claims"),
        "full_quality": X.context_quality("full_context"), "limited_quality": X.context_quality("limited_context"),
    })
