"""The operators' queries over the given tables, each beside its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm import (
    alignment, decontaminate, exact_dedup, html_blocks, licenses, packing, secrets, simhash_dedup, suffix_dedup, token_files, toxicity, trie,
    window_dedup,
)
from scorelake.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_suffix_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document that long repeats cover."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@query("op2_html_blocks")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page."""
    return html_blocks.extract(table(spark, sf_dir, "pages"))


@query("op3_secrets")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in each document."""
    return secrets.secrets(table(spark, sf_dir, "documents"))


@query("op4_decontaminate")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and items that each document shares with the benchmark."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_token_files")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place and checksum of each document in the token files, read back from them."""
    return token_files.token_documents(table(spark, sf_dir, "documents"))


@query("op6_licenses")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License texts in the documents."""
    return licenses.licenses(table(spark, sf_dir, "documents"))


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of each document."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_simhash_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of each document."""
    return simhash_dedup.near_groups(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH n AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""


@query("op9_exact_dedup", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of equal texts of each document and the row that stays."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("text_key")


@query("op10_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of documents packed into sequences."""
    return packing.pack(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH w AS (
    SELECT doc_id, i, list[i] AS word, CASE WHEN i + 34 <= len(list) THEN md5(array_to_string(list[i:i + 34], ' ')) END AS k
    FROM (SELECT doc_id, list, unnest(range(1, len(list) + 1)) AS i
          FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS list FROM documents))
), f AS (
    SELECT doc_id, i, word, k IS NOT NULL AND count(*) OVER (PARTITION BY k) > 1 AS twice FROM w
), g AS (
    SELECT doc_id, i, word, bool_or(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM f
), d AS (
    SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept
    FROM g GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN d USING (doc_id)
"""


@query("op11_window_dedup", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that repeated windows cover."""
    found = window_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op12_token_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between the tokens of two vocabularies in each document."""
    return alignment.token_links(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH t AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS pos, digest, words
    FROM (SELECT conv_id, turn, sha256(length(r) || ':' || r || x) AS digest, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words
          FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL))
), c AS (
    SELECT conv_id, count(*) AS n, conv_id - conv_id % 20 AS base, xor(4294967295, list_reduce(
        list_concat([4294967295], [(ascii(s[(1 + i // 8)::INTEGER]) >> (i % 8)::INTEGER) & 1 FOR i IN range(8 * length(s))]),
        lambda a, b: xor(a >> 1, 3988292384 * (xor(a, b) & 1)))) % 4 AS h
    FROM (SELECT conv_id, CAST(conv_id AS VARCHAR) AS s FROM t) GROUP BY conv_id, s
), m AS (
    SELECT c.*, least(c.h, coalesce(b.n, 0)) AS taken, least(c.h, coalesce(b.n, 0)) + greatest(c.n - c.h, 0) AS length
    FROM c LEFT JOIN c b ON b.conv_id = c.base
), turns AS (
    SELECT m.conv_id, pos + 1 AS d, digest, words, length FROM m JOIN t ON t.conv_id = m.base AND pos < h
    UNION ALL
    SELECT m.conv_id, pos - h + taken + 1, digest, words, length FROM m JOIN t ON t.conv_id = m.conv_id AND pos >= h
), p AS (
    SELECT conv_id, d, words, length, sha256(string_agg(digest, ',') OVER (PARTITION BY conv_id ORDER BY d)) AS k FROM turns
    UNION ALL SELECT conv_id, 0, 0, length, '' FROM m
), nodes AS (
    SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words,
           sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = length), '')) AS ends_sha256
    FROM p GROUP BY d, k
), linked AS (
    SELECT n.*, u.conv_id AS parent_conv_id, u.k AS up
    FROM nodes n LEFT JOIN p a ON a.conv_id = n.conv_id AND a.d = n.d - 1 LEFT JOIN nodes u ON u.d = a.d AND u.k = a.k
), kids AS (
    SELECT n.d, n.k, count(l.k) AS n_children FROM nodes n LEFT JOIN linked l ON l.d = n.d + 1 AND l.up = n.k GROUP BY n.d, n.k
), sums AS (
    SELECT a.d, a.k, CAST(sum(CAST(q.n_children = 0 AS INTEGER)) AS BIGINT) AS n_leaves, CAST(sum((n.n_convs - 1) * n.words) AS BIGINT) AS saved_tokens
    FROM nodes n JOIN kids q ON q.d = n.d AND q.k = n.k JOIN p a ON a.conv_id = n.conv_id AND a.d <= n.d GROUP BY a.d, a.k
)
SELECT l.conv_id, l.d AS depth, l.parent_conv_id, l.n_convs, q.n_children, s.n_leaves, s.saved_tokens, l.ends_sha256
FROM linked l JOIN kids q ON q.d = l.d AND q.k = l.k JOIN sums s ON s.d = l.d AND s.k = l.k
"""


@query("op13_conversation_trie", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of rebuilt conversations with subtree totals."""
    return trie.trie(table(spark, sf_dir, "conversations"))
