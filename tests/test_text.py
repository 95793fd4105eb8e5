import math
import random
import re
import sys
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from scorelake.functions import similarity, text
from scorelake.operators import scoring

SAMPLES = [
    ("What drives sales growth in retail stores?", "Sales growth is driven by retail stores. However, pricing matters. Therefore margins fell 12.5% in 2021."),
    ("trend of revenue", "Revenue was $1,200.50 in New York. Revenue was $1,200.50 in Boston."),
    ("", "No query words here at all."),
    ("the of and", "the of and"),
    ("Été à Paris?", "L'été à Paris was long. Paris Match said so. " + "word " * 250),
    ("numbers", "x" * 210 + ". " + "x" * 205 + "y. Hence done."),
    ("one two", ""),
]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, q, r, "Revenue was $1,200.50 in New York. Growth is 12.5%") for i, (q, r) in enumerate(SAMPLES)]
    return spark.createDataFrame(data, "id int, query string, response string, truth string")


def test_space_set_is_the_unicode_one():
    assert set(text.SPACES) == {chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace()}


def test_words_and_sentences(spark):
    strings = ["a  b\tc\n", "", " \x85x\xa0y　z ", "one. two .. three.", "\x1fq\x1c"]
    df = spark.createDataFrame([(s,) for s in strings], "t string")
    for r in df.select("t", text.words("t").alias("w"), text.sentences("t").alias("s")).collect():
        assert r.w == r.t.split()
        assert r.s == [s.strip() for s in r.t.split(".") if s.strip()]


def brute_relevance(q, r, cap=None):
    def terms(t):
        toks = [w for w in re.findall(r"\b\w\w+\b", t.lower()) if w not in set(text.RELEVANCE_STOP_WORDS)]
        return Counter(toks + [f"{a} {b}" for a, b in zip(toks, toks[1:])])

    a, b = terms(q), terms(r)
    kept = sorted(set(a) | set(b), key=lambda t: (-(a[t] + b[t]), t))[:cap]
    weigh = {t: 1.0 if a[t] and b[t] else 1 + math.log(1.5) for t in kept}
    dot = sum(a[t] * b[t] * weigh[t] ** 2 for t in kept)
    norms = [math.sqrt(sum((c[t] * weigh[t]) ** 2 for t in kept)) for c in (a, b)]
    return dot / (norms[0] * norms[1]) if all(norms) else 0.0


def test_relevance(rows):
    got = {r.id: r.relevance for r in scoring.tfidf_relevance(rows, "id", "query", "response").collect()}
    for i, (q, r) in enumerate(SAMPLES):
        assert abs(got[i] - brute_relevance(q, r)) < 1e-9, i


def test_relevance_of_many_terms(spark):
    rng = random.Random(2)
    many = " ".join(f"w{rng.randrange(900)}" for _ in range(3000))
    df = spark.createDataFrame([(0, many[:4000], many)], "id int, query string, response string")
    for most in (None, 1000):
        got = scoring.tfidf_relevance(df, "id", "query", "response", max_terms=most).first().relevance
        assert abs(got - brute_relevance(many[:4000], many, most)) < 1e-9


def brute_facts(t):
    found = set()
    for p in text.FACT_PATTERNS:
        found.update(re.findall(p, t))
    found.update(s.strip() for s in t.split(".") if s.strip() and any(v in s.lower() for v in text.FACT_VERBS))
    return found


def test_facts(rows):
    for r in rows.select("response", "truth", text.facts("response").alias("f"), text.fact_f1("response", "truth").alias("f1")).collect():
        said, true = brute_facts(r.response), brute_facts(r.truth)
        assert set(r.f) == said
        shared = len(said & true)
        p, c = (shared / len(said) if said else 0), shared / len(true)
        assert abs(r.f1 - (2 * p * c / (p + c) if p + c else 0)) < 1e-12


def brute_coherence(t):
    parts = [s.strip() for s in t.split(".") if s.strip()]
    if len(parts) < 2:
        return 1.0
    sims = [SequenceMatcher(None, a, b).ratio() for a, b in zip(parts, parts[1:])]
    return .7 * sum(sims) / len(sims) + .3 * min(sum(c in t.lower() for c in text.CONNECTORS) / 3, 1)


def test_coherence_and_fuzzy(rows):
    out = rows.select("response", "truth", scoring.coherence("response").alias("c"), similarity.sequence_ratio("response", "truth").alias("z"))
    for r in out.collect():
        assert abs(r.c - brute_coherence(r.response)) < 1e-12
        assert abs(r.z - SequenceMatcher(None, r.response, r.truth).ratio()) < 1e-12


def test_completeness(rows):
    stop = set(text.STOP_WORDS)
    for r in rows.select("query", "response", text.completeness("response", "query").alias("c")).collect():
        asked = {w.lower() for w in r.query.split() if w.lower() not in stop}
        low = r.response.lower()
        expected = 1.0 if not asked else (
            .5 * sum(w in low for w in asked) / len(asked) + .3 * min(len(r.response.split()) / 10, 1)
            + .2 * (1 if any(p in low for p in text.CONCLUSIONS) else .5))
        assert abs(r.c - expected) < 1e-12


def test_overall(rows):
    timed = rows.withColumn("response_time_ms", F.lit(500.0)).withColumn("tokens_used", F.lit(20))
    timed = timed.withColumn("truth", F.when(F.col("id") != 1, F.col("truth")))
    got = {r.id: r for r in scoring.score_responses(timed).collect()}
    assert len(got) == len(SAMPLES)
    assert got[1].overall_score == 0.0 and got[1].ci_high == 0.0
    r = got[0]
    parts = [r[c] for c in text.OVERALL_WEIGHTS]
    score = sum(w * r[c] for c, w in text.OVERALL_WEIGHTS.items())
    mean = sum(parts) / 6
    std = math.sqrt(sum((p - mean) ** 2 for p in parts) / 6)
    assert abs(r.overall_score - score) < 1e-12
    assert abs(r.ci_low - max(0, score - std)) < 1e-12 and abs(r.ci_high - min(1, score + std)) < 1e-12


def test_small_scores(spark):
    df = spark.createDataFrame(
        [("Sales to each CUSTOMER rose; in-store inventory too", "retail"), ("nothing", "finance"), ("x", "other")], "t string, d string")
    got = [r[0] for r in df.select(text.keyword_relevance("t", "d")).collect()]
    assert got == [1.0, .2, 0.0]
    eff = spark.range(1).select(
        text.token_efficiency(F.lit("a b c d"), F.lit(0), F.lit("a")), text.time_efficiency(F.lit(0.0), F.lit(10)),
        text.time_efficiency(F.lit(1000.0), F.lit(250))).first()
    assert list(eff) == [0.0, 0.0, .25]
    shape = spark.createDataFrame([("intro\n  - item\n```code```",), ("plain. text",)], "t string")
    flags = [(r.a, r.b) for r in shape.select(text.shape("t")["has_code_blocks"].alias("a"), text.shape("t")["has_bullet_points"].alias("b")).collect()]
    assert flags == [(True, True), (False, False)]
