"""Exact, near and substring de-duplication against brute force."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from scorelake.llm.common import keep_rows
from scorelake.llm import components, exact_dedup, queries, simhash_dedup, suffix_dedup

SMALL = "/root/testdata/sf0.001"
EMPTY = "doc_id long, text string"


def test_exact_dedup_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    ours = queries.QUERIES["op9_exact_dedup"](spark, SMALL).toPandas().sort_values("doc_id").reset_index(drop=True)
    theirs = con.execute(queries.ORACLES["op9_exact_dedup"] + " ORDER BY doc_id").df()
    assert ours.equals(theirs[ours.columns.tolist()].astype(ours.dtypes))


def test_exact_dedup_edges(spark):
    rows = [(5, "a  b", "x"), (3, "a\tb", "y"), (3, "a b", "y"), (None, "a b", "z"), (7, None, "w"), (6, "", "w"), (8, " ", "v"), (9, "A b", "v")]
    rows += [(100 + i, "hot text", "h") for i in range(300)] + [(50, "x" * 200_000, "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep_id string").repartition(5)
    got = exact_dedup.exact_groups(docs, top=1, counters=64).toPandas()
    group = got[got.text_sha256 == hashlib.sha256(b"a b").hexdigest()]
    assert len(group) == 4 and set(group.keep_id) == {3} and set(group.group_size) == {4} and group.kept.sum() == 1
    assert set(got[got.text_sha256 == hashlib.sha256(b"").hexdigest()].keep_id) == {6}
    hot = got[got.text_sha256 == hashlib.sha256(b"hot text").hexdigest()]
    assert len(hot) == 300 and set(hot.keep_id) == {100} and hot.kept.sum() == 1
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([3, 6, 8, 9, 50, 100])
    assert exact_dedup.exact_groups(spark.createDataFrame([], EMPTY)).count() == 0


def fingerprint(text):
    words = re.findall("[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def classes(fps, ids, bits):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(fps))]


def test_simhash_groups(spark):
    rnd = random.Random(3)
    vocabulary = ["Ab", "cd", "é", "x1", "y", "zz", "Wort"]
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([0, 1, 3, 4, 9, 40, 300]))) for _ in range(60)]
    for t in list(texts[:30]):
        words = t.split(" ")
        words[rnd.randrange(len(words))] = "new"
        texts.append(" ".join(words))
    texts += [None, "", " \n", texts[0], "word " * 30_000]
    rows = [(i * 7 % 101, t, "c") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(4)
    got = {(r.doc_id, r.text_key): r for r in simhash_dedup.near_groups(docs).collect()}
    ids, fps = [r[0] for r in rows], [fingerprint(r[1]) for r in rows]
    expected = dict(zip(ids, zip(fps, classes(fps, ids, 4))))
    assert {d: (int(r.fingerprint, 16), r.component_id) for (d, _), r in got.items()} == expected
    kept = simhash_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in expected.values()})
    assert simhash_dedup.near_groups(spark.createDataFrame([], EMPTY)).count() == 0


@pytest.mark.parametrize("cell_rows", [20_000, 5])
def test_simhash_links_are_complete(spark, cell_rows):
    """Every pair within four bits ends in one component, in one cell per anchor or in a grid of them."""
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    for _ in range(160):
        flips = rng.choice(64, rng.integers(1, 5), replace=False)
        fps = np.append(fps, fps[rng.integers(len(fps))] ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64)))
    fps = np.unique(fps).view(np.int64)
    nodes = spark.createDataFrame([(int(x),) for x in fps], "fp long").repartition(3)
    found = {r.u: r.v for r in components.components(simhash_dedup.links(nodes, 4, cell_rows)).collect()}
    expected = classes([int(x) & (2**64 - 1) for x in fps], [int(x) for x in fps], 4)
    assert [found.get(int(x), int(x)) for x in fps] == expected


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (500, 501), (501, 500)]
    got = {r.u: r.v for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 130)}, 501: 500}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def removed(docs, length):
    counts, raws = Counter(), [(t or "").encode() for _, t in docs]
    for raw in raws:
        counts.update(raw[i:i + length] for i in range(len(raw) - length + 1))
    out = []
    for (doc_id, _), raw in zip(docs, raws):
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if counts[raw[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((doc_id, len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("gram, group", [(6, 20_000), (8, 2)])
def test_repeats_on_small_strings(spark, gram, group):
    rnd = random.Random(gram)
    docs = [(i, "".join(rnd.choice("abcé") for _ in range(rnd.randint(0, 120)))) for i in range(100)]
    for i in range(100, 180):
        a, b = rnd.choice(docs)[1], rnd.choice(docs)[1]
        p, q = sorted((rnd.randint(0, len(a)), rnd.randint(0, len(a))))
        docs.append((i, b[:rnd.randint(0, len(b))] + a[p:q] + b))
    docs += [(300, None), (301, ""), (302, "a" * 90), (303, "ab" * 50), (304, "a" * 20), (305, docs[5][1]), (5, docs[5][1])]
    table = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, place string").repartition(3)
    assert sorted(map(tuple, suffix_dedup.remove_repeats(table, 20, gram, group).collect())) == removed(docs, 20)


def test_repeats_on_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    expected = removed([(r.doc_id, r.text) for r in docs.collect()], 200)
    assert sorted(map(tuple, queries.QUERIES["op1_suffix_dedup"](spark, SMALL).collect())) == expected
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], EMPTY)).count() == 0


def test_interval_tree():
    # banana's suffixes a, ana, anana, banana, na, nana
    assert sorted(suffix_dedup.intervals([1, 3, 0, 0, 2])) == [(1, 0, 2), (2, 4, 5), (3, 1, 2)]
    assert suffix_dedup._common(b"abcd", b"abxd") == 2 and suffix_dedup._common(b"", b"a") == 0 and suffix_dedup._common(b"ab", b"abc") == 2


def test_rows_are_told_apart_by_any_kind_of_id(spark):
    """Text ids, the least number and a missing one are three different ids."""
    for kind, ids in (("string", ["a", "-9223372036854775808", None, "a"]), ("long", [1, -(2**63), None, 1])):
        docs = spark.createDataFrame([(i, "same") for i in ids], f"doc_id {kind}, text string")
        keys = docs.where("doc_id IS NULL").select("doc_id", F.xxhash64("text").alias("text_key"))
        assert [r.doc_id for r in keep_rows(docs, keys).collect()] == [None]
        assert len(keep_rows(docs, keys, keep=False).collect()) == 3 and len(keep_rows(docs, keys, True, False).collect()) == 2
        assert [r.doc_id for r in exact_dedup.drop_copies(docs).collect()] == [min(i for i in ids if i is not None)]
