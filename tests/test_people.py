import pytest
from pyspark.sql import functions as F

from scorelake.operators import blinding as B
from scorelake.operators import feedback as P
from scorelake.operators import joins as J
from scorelake.operators import privacy as Y
from scorelake.operators import quality as Q


def test_ranking_rules(spark):
    ranks = [{"A": 1, "B": 2, "C": 3}, {"A": 1, "B": 1, "C": 3}, {"A": 1, "B": 3}, {"A": 0, "B": 1}, {}]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(ranks)], "id int, r map<string,int>")
    got = {r.id: r.v for r in df.select("id", B.valid_ranking("r").alias("v")).collect()}
    assert got == {0: True, 1: False, 2: False, 3: False, 4: False}
    assert df.where("id = 3").select(B.label_of_rank("r")).first()[0] == "B"


def test_blind_maps_are_bijections(spark):
    items = ["m1", "m2", "m3", "m4", "m5", "m6"]
    df = spark.range(200).select("id", B.blind_map(F.array(*[F.lit(x) for x in items]), F.col("id").cast("string")).alias("m"))
    rows = df.collect()
    assert all(sorted(r.m) == list("ABCDEF") and sorted(r.m.values()) == items for r in rows)
    assert len({r.m["A"] for r in rows}) == 6
    assert rows == df.collect()


def test_samples(spark):
    pool = spark.range(100).select("id", F.when(F.col("id") < 90, "big").otherwise("small").alias("domain"))
    got = B.sample_per_stratum(pool, "domain", "id", 5, "s").collect()
    assert len({r.id for r in got}) == 10 and sorted(r.sample_order for r in got if r.domain == "big") == [1, 2, 3, 4, 5]
    assert {r.id for r in got} != {r.id for r in B.sample_per_stratum(pool, "domain", "id", 5, "other").collect()}
    with pytest.raises(Exception, match="not enough rows"):
        B.sample_per_stratum(pool, "domain", "id", 11, strict=True).collect()
    sessions = spark.range(40).select(F.col("id").alias("sid"))
    own = B.sample_for_sessions(sessions, pool, "sid", "domain", "id", 7).collect()
    assert len(own) == 40 * 14 and len({(r.sid, r.id) for r in own}) == len(own)
    assert len({tuple(sorted(r.id for r in own if r.sid == s)) for s in range(40)}) > 35


def test_unblind(spark):
    df = spark.createDataFrame([(1, {"A": 2, "B": 1}, ["x", "y"]), (2, {"A": 1, "C": 2}, ["y", "x"])], "id int, r map<string,int>, o array<string>")
    got = {(r.id, r.label): (r.provider, r["rank"]) for r in B.unblind(df, "r", "o", "id").collect()}
    assert got == {(1, "A"): ("x", 2), (1, "B"): ("y", 1), (2, "A"): ("y", 1), (2, "C"): (None, 2)}


def test_feedback(spark):
    log = spark.createDataFrame(
        [("s1", "session_event", "session_start", None, {}, 0), ("s1", "industry_feedback", None, "retail", {"a": 4, "b": 1}, 1),
         ("s1", "industry_feedback", None, None, {"a": 4}, 2), ("s2", "session_event", "session_completion", None, {}, 3)],
        "session_id string, record_type string, event_name string, industry string, ratings map<string,int>, t int",
    ).withColumn("ts", F.timestamp_seconds("t"))
    assert tuple(P.feedback_summary(log).first()) == (2, 2, 1)
    assert {(r.industry, r.n) for r in P.industry_counts(log).collect()} == {("retail", 1), ("unknown", 1)}
    assert P.session_feedback(log, "s1").count() == 3 and P.industry_feedback(log, "retail").count() == 1
    got = {r.session_id: r for r in P.session_stats(log).collect()}
    assert got["s1"].mean_rating == 3.0 and got["s1"].started and not got["s1"].completed
    assert got["s2"].mean_rating == 0.0 and got["s2"].completed
    assert P.flatten_map(log, "ratings", ["a", "b"]).columns[-2:] == ["a", "b"]
    assert P.map_entries(log.select("ratings"), "ratings").count() == 3


def test_joins(spark):
    base = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "k int, s string, n int")
    delta = spark.createDataFrame([(2, None, 7), (3, "c", None)], "k int, s string, n int")
    assert sorted(tuple(r) for r in J.upsert(base, delta, "k").collect()) == [(1, "a", None), (2, "b", 7), (3, "c", None)]
    assert J.delete(base, delta, "k").count() == 1
    assert J.lookup(base, "k", 2).first().s == "b" and J.lookup(base, "k", 9).count() == 0
    asked = spark.createDataFrame([(2,), (9,)], "k int")
    assert sorted((r.k, r.s) for r in J.lookup_many(asked, base, "k").collect()) == [(2, "b"), (9, None)]
    context = spark.createDataFrame([("retail", "c", "e")], "domain string, context string, evaluation_criteria string")
    rows = spark.createDataFrame([("retail",), ("other",)], "domain string")
    assert {(r.domain, r.context) for r in J.attach_context(rows, context).collect()} == {("retail", "c"), ("other", None)}
    meta = spark.createDataFrame([("p", "m", "fam", ["fast"])], "provider string, model string, family string, tags array<string>")
    log = spark.createDataFrame([("p", "m"), ("p", "other")], "provider string, model string")
    got = {r.model: (r.family, r.tags) for r in J.enrich(log, meta, ["provider", "model"]).collect()}
    assert got == {"m": ("fam", ["fast"]), "other": (None, [])}
    failed = spark.createDataFrame([("d", 0, 1), ("d", 1, 2), ("x", 9, 3)], "domain string, q int, id int")
    status = spark.createDataFrame([("d", 0, True), ("d", 1, False)], "domain string, q int, needs_retry boolean")
    assert {r.id for r in J.retry_plan(failed, status, ["domain", "q"]).collect()} == {1, 3}
    reg = spark.createDataFrame([("A@x.org",), ("b@x.org",)], "email string")
    sub = spark.createDataFrame([("a@X.ORG",)], "email string")
    assert [r.email for r in J.can_continue(reg, sub).collect()] == ["b@x.org"]
    assert [r.email for r in J.already_submitted(reg, sub).collect()] == ["A@x.org"]


PII = {
    "write Me.X@Ex-ample.org now": "write [REDACTED] now", "ssn 123-45-6789.": "ssn [REDACTED].",
    "call 555-123-4567": "call [REDACTED]", "card 1234-5678-9012-3456": "card [REDACTED]",
    "card 1234 5678 9012 3456": "card [REDACTED]", "host 10.0.0.255": "host [REDACTED]",
    "iban de44500105175407324931": "iban [REDACTED]", "no 12-34 or a@b": "no 12-34 or a@b", "v1.2.3": "v1.2.3", "": "",
}


def test_redaction(spark):
    df = spark.createDataFrame([(t,) for t in PII], "t string")
    assert {r.t: r.c for r in df.select("t", Y.redact("t").alias("c")).collect()} == PII
    counts = df.select(*[F.sum(c).alias(n) for n, c in Y.pii_counts("t").items()]).first()
    assert counts.email == 1 and counts.card == 1 and counts.ip_address == 1


def test_mask_nested(spark):
    df = spark.sql("""SELECT 'bob' AS username, 5 AS age, named_struct('email', 'a@b.co', 'note', 'ip 1.2.3.4') AS info,
        array('x@y.org', 'ok') AS list, map('token', 't', 'text', 'call 555-123-4567') AS extra,
        map('api_key', 1, 'n', 2) AS numbers, array(named_struct('secret', 's', 'v', 1)) AS items""")
    r = Y.mask_fields(df).first().asDict(True)
    assert r == {
        "username": "[REDACTED]", "age": 5, "info": {"email": "[REDACTED]", "note": "ip [REDACTED]"},
        "list": ["[REDACTED]", "ok"], "extra": {"token": "[REDACTED]", "text": "call [REDACTED]"}, "numbers": {"n": 2},
        "items": [{"secret": "[REDACTED]", "v": 1}]}


def test_markup_and_checks(spark):
    cases = {
        "<script>alert(1)</script> hi": "hi", "a <b onclick = 'x'>b</b>": "a b", "javascript:go": "go",
        "<style>\np{}</style>x": "x", "1 < 2": "1 < 2", "  padded ": "padded", "<IFRAME src=x>ok": "ok"}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.c for r in df.select("t", Y.strip_markup("t").alias("c")).collect()} == cases
    q = spark.createDataFrame([("",), ("fine",), ("<b>x</b>",), ("y" * 5001,)], "q string")
    assert [r[0].is_valid for r in q.select(Q.check_query("q")).collect()] == [False, True, False, False]
    c = spark.createDataFrame([("",), ("short",), ("long enough text",), ("z" * 1001,)], "c string")
    assert [len(r[0]) for r in c.select(Q.issues(Q.comment_rules("c"))).collect()] == [0, 1, 0, 1]
    s = spark.createDataFrame([("session_12", 2), ("sess", 1), ("session_1", 4), (None, 1)], "id string, step int")
    assert [r[0].is_valid for r in s.select(Q.check_session("id", "step")).collect()] == [True, False, False, False]
    m = spark.createDataFrame([("Retail", "A"), ("mining", "G"), (None, None)], "i string, l string")
    assert [tuple(r) for r in m.select(Q.is_industry("i"), Q.is_selection("l")).collect()] == [(True, True), (False, False), (False, False)]


def test_profiles(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "a", None), (3, None, 2.0)], "`My Id` int, `Name (x)` string, v double")
    tidy = Q.tidy_names(df)
    assert tidy.columns == ["my_id", "name_x", "v"]
    assert tuple(Q.duplicate_report(tidy).first()) == (3, 2, 1)
    assert {r.column: (r.type, r.nulls) for r in Q.table_profile(tidy).collect()} == {"my_id": ("int", 0), "name_x": ("string", 1), "v": ("double", 2)}
    top = Q.categorical_profile(tidy, ["name_x"]).first()
    assert (top.value, top.n, top.n_distinct) == ("a", 2, 1)


def test_audit(spark):
    df = spark.createDataFrame([("login", "u1", "HIGH", "mail a@b.co")], "e string, p string, s string, note string")
    r = Y.audit_rows(df, "security", "e", "p", "s").first()
    assert (r.event_type, r.level) == ("security_login", "WARNING") and "[REDACTED]" in r.details and len(r.participant_hash) == 16
