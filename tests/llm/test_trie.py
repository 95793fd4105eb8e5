"""Conversation trie against a plain one in memory."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from scorelake.llm import queries, trie

SMALL = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, depth string, one int"


def brute(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            convs[conv].append(((turn is not None, turn or 0), tie, (role, text)))
    turns = {c: [x[2] for x in sorted(t)] for c, t in convs.items()}
    members = defaultdict(list)
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        family = 20 * abs(c) // 20 and abs(c) % 20 * (1 if c >= 0 else -1)  # rest with the sign of the id
        rebuilt[c] = tuple(turns.get(c - family, [])[:h] + own[h:])
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, own in members.items():
        words = len(re.findall("[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(own) - 1) * words
    out = []
    for node, own in members.items():
        ends = ",".join(map(str, sorted(c for c in own if rebuilt[c] == node)))
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), kids[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_query_equals_sql_and_brute_force(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SMALL}/conversations.parquet'")
    ours = queries.QUERIES["op13_conversation_trie"](spark, SMALL)
    rows = got(ours)
    theirs = con.execute(f"SELECT {', '.join(ours.columns)} FROM ({queries.ORACLES['op13_conversation_trie']})").fetchall()
    assert rows == sorted(theirs, key=str)
    assert rows == brute(con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall())


def test_strange_conversations(spark):
    rnd = random.Random(8)
    rows = [(c, t, rnd.choice(["user", "assistant", None]), rnd.choice(["a", "b c", "", None])) for c in [*range(0, 45), -3, -20, 2**40] for t in range(rnd.randint(0, 5))]
    rows += [(60, t % 3 if t % 5 else None, "user", f"long {t // 2}") for t in range(130)]  # a long one, with ties, repeats and missing turns
    rows += [(c, 0, "user", "same") for c in range(100, 160)] + [(None, 1, "user", "lost"), (7, 9, "user", "x" * 100_000)]
    conversations = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(5)
    assert got(trie.trie(conversations)) == brute(rows)


def test_empty(spark):
    assert trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("shape", ["chain", "star", "caterpillar", "random"])
def test_contraction_of_any_shape(spark, shape, monkeypatch):
    rnd, n = random.Random(1), 300
    parent = {"chain": lambda i: i - 1, "star": lambda i: 0, "caterpillar": lambda i: i - 1 if i % 2 else max(0, i - 2), "random": lambda i: rnd.randint(max(0, i - 9), i - 1)}[shape]
    up = [None, *[parent(i) for i in range(1, n)]]
    depth, total = [0] * n, [1 + i % 7 for i in range(n)]
    for i in range(1, n):
        depth[i] = depth[up[i]] + 1
    for i in range(n - 1, 0, -1):
        total[up[i]] += total[i]
    nodes = spark.createDataFrame([(i, up[i], depth[i], 1 + i % 7) for i in range(n)], "id long, parent long, depth long, weight long")
    rounds = []
    written = trie.saved
    monkeypatch.setattr(trie, "saved", lambda df, label: rounds.append(label) or written(df, label))
    assert dict(map(tuple, trie.subtree_totals(nodes, ["weight"]).collect())) == dict(enumerate(total))
    assert rounds.count("live") <= 14  # not one round a level


def test_a_long_conversation_is_cut_over_tasks(spark):
    turns = spark.range(4000).select(F.lit(5).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("same").alias("text"))
    held = trie._sorted(trie._turns(turns)).groupBy("part").count().agg(F.max("count")).first()[0]
    assert held < 2500
