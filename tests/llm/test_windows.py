"""Repeated word windows against brute force."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from scorelake.llm import queries, window_dedup

SMALL = "/root/testdata/sf0.001"


def brute(texts, size):
    words = [re.findall("[^\x20\x09-\x0D]+", t or "") for t in texts]
    counts = Counter(tuple(w[i:i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if counts[tuple(w[i:i + size])] > 1:
                gone[i:i + size] = [True] * size
        out.append((len(w), gone, " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def found(df):
    out = {}
    for r in df.collect():
        gone = {i for a, b in r.spans for i in range(a, b + 1)}
        assert len(gone) == r.n_removed == sum(b - a + 1 for a, b in r.spans)
        assert all(b + 1 < c for (_, b), (c, _) in zip(r.spans, r.spans[1:]))  # runs are maximal
        out[r.doc_id] = (r.n_words, [i in gone for i in range(r.n_words)], r.kept)
    return out


def test_query_equals_sql_and_brute_force(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    ours = queries.QUERIES["op11_window_dedup"](spark, SMALL).toPandas().sort_values("doc_id").reset_index(drop=True)
    theirs = con.execute(queries.ORACLES["op11_window_dedup"] + " ORDER BY doc_id").df()
    assert ours.equals(theirs[ours.columns.tolist()].astype(ours.dtypes))
    rows = con.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
    for got, (n, gone, left) in zip(ours.itertuples(), brute([t for _, t in rows], 35)):
        assert (got.n_words, got.n_removed, got.kept_sha256) == (n, sum(gone), hashlib.sha256(left.encode()).hexdigest())
    assert ours.n_removed.sum() > 0


@pytest.mark.parametrize("size, chunk, block", [(1, 40, 8), (3, 60, 16), (5, 1 << 20, 1 << 20)])
def test_equals_brute_force(spark, size, chunk, block):
    rnd = random.Random(size)
    texts = ["".join(rnd.choice(["a", "b", "ça", " ", " ", "\t\n", "\x0b", "\x1c"]) for _ in range(rnd.randint(0, 60))) for _ in range(150)]
    texts += ["hot text of nine words that many rows share"] * 60 + [None, "", "  ", "a " * 3000, "é" * 5000]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, kept string, block int").repartition(6)
    got = found(window_dedup.without_repeats(docs, size, chunk, block))
    assert [got[i] for i in range(len(texts))] == brute(texts, size)


def test_edges(spark):
    assert window_dedup.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    nulls = spark.createDataFrame([(None, None), (None, "a b"), (1, "a b"), (1, "a b")], "doc_id string, text string")
    rows = window_dedup.without_repeats(nulls, 2).collect()
    assert sorted((r.doc_id or "", r.n_words, r.n_removed) for r in rows) == [("", 0, 0), ("", 2, 2), ("1", 2, 2), ("1", 2, 2)]


def test_sketch_never_counts_too_little(spark):
    """Even a sketch of four cells a block lets every repeated window through, and one of many cells few others."""
    rnd = random.Random(1)
    words = [b" ".join(b"%d" % rnd.randint(0, 400) for _ in range(4000)) for _ in range(2)]
    powers = [window_dedup._powers(b, 1 << 15) for b in window_dedup.BASES]
    chunks = [window_dedup.Chunk([w], 2, powers) for w in words]
    every = np.concatenate([c.hashes(0) for c in chunks])
    twice = {h for h, n in Counter(every.tolist()).items() if n > 1}
    for cells, most in ((4, 1.0), (1 << 16, 0.02)):
        sketches = [window_dedup.Sketch(c.hashes(0), 3, cells) for c in chunks]
        sent = [dict(s.parts()) for s in sketches]
        answers = [{}, {}]
        for block in sorted(set(sent[0]) | set(sent[1])):
            has = [i for i in (0, 1) if block in sent[i]]
            for i, mask in zip(has, window_dedup.counted([sent[i][block] for i in has])):
                answers[i][block] = mask
        passed = set()
        for c, s, a in zip(chunks, sketches, answers):
            passed |= set(c.hashes(0)[s.often(iter([a[b] for b in sorted(a)]))].tolist())
        assert twice <= passed
        assert len(passed - twice) <= most * len(set(every.tolist()) - twice)
