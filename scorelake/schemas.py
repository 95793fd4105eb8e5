"""Explicit schemas of the tables the library reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
TS, DATE = T.TimestampType(), T.DateType()
STRINGS, TEXT_MAP, RANKS = T.ArrayType(S), T.MapType(S, S), T.MapType(S, I)


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def named(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


RETAIL = named(
    ("Customer ID", L), ("Age", L), ("Gender", S), ("Item Purchased", S), ("Category", S),
    ("Purchase Amount (USD)", L), ("Location", S), ("Size", S), ("Color", S), ("Season", S),
    ("Review Rating", D), ("Subscription Status", S), ("Payment Method", S), ("Shipping Type", S),
    ("Discount Applied", S), ("Promo Code Used", S), ("Previous Purchases", L),
    ("Preferred Payment Method", S), ("Frequency of Purchases", S),
)
BARS = named(("Date", DATE), ("Open", D), ("High", D), ("Low", D), ("Close", D), ("Volume", L))
TRUTH = struct(
    question_id=S, question=S, answer=S, category=S, difficulty=S, key_points=STRINGS, factual_claims=STRINGS,
    expected_length=S, domain=S, metadata=TEXT_MAP,
)
EVALUATION = struct(
    evaluation_id=S, question_id=S, provider=S, model=S, query=S, response=S, truth=S, relevance=D,
    factual_accuracy=D, coherence=D, completeness=D, token_efficiency=D, time_efficiency=D,
    overall_score=D, ci_low=D, ci_high=D, response_time_ms=D, tokens_used=L, timestamp=TS,
)
FEEDBACK = struct(
    session_id=S, timestamp=TS, record_type=S, industry=S, selected_response=S, comment=S, ratings=RANKS,
    prompt=S, response_order=STRINGS, blind_map=TEXT_MAP, event_name=S, user_consent=B,
    session_metadata=TEXT_MAP, completed_industries=STRINGS, total_time_seconds=D,
)
RANKING = struct(
    question_id=S, question=S, domain=S, rankings=RANKS, best_response=S, actual_provider=S, confidence=I,
    comment=S, timestamp=TS, session_id=S, tester_email=S, response_order=STRINGS,
)
HEALTH = struct(
    timestamp=TS, provider=S, model=S, status=S, latency=D, response=S, tokens_used=L, error=S,
)
EVENT = struct(
    prompt=S, provider=S, model=S, response=S, latency=D, tokens=L, score=D, timestamp=TS, run_id=S,
)
MODEL = struct(
    provider=S, name=S, family=S, base_model=S, token_limit=I, speed_category=S, tags=STRINGS,
)
_RESPONSE_META = struct(latency=D, token_count=I, timestamp=S, model=S)
_ANSWER = struct(response=S, model_name=S, provider=S, metadata=_RESPONSE_META)
RESPONSES_BY_PROVIDER = struct(
    responses=T.MapType(S, struct(question=S, domain=S, rag_context=S, llm_responses=T.MapType(S, _ANSWER)))
)
_ATTEMPT = struct(latency=D, word_count=I, has_error=B, error_message=S, retry_attempts=I)
_LISTED = struct(model=S, provider=S, response=S, metadata=_ATTEMPT)
RESPONSES_BY_DOMAIN = struct(
    responses_by_domain=T.MapType(S, T.ArrayType(struct(question=S, context=S, responses=T.ArrayType(_LISTED))))
)
QUESTION_POOL = T.MapType(
    S, struct(questions=T.ArrayType(struct(id=S, question=S)), context=S, evaluation_criteria=S)
)
