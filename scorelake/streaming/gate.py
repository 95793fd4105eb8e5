"""Rate limits as keyed state: the same gate decides batches and streams.

A gate holds, per action, the newest admitted request times and, after a violation, the
time the identifier was blocked.  Violations are found by comparing each time with the
one ``limit`` places earlier, and blocked stretches are skipped by binary search, so work
grows with the number of blocks rather than with per-row Python steps.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from scorelake.operators.windows import activity_islands, trailing_count
from scorelake.streaming.refusals import NEVER, decided

MICROS = 1_000_000

# fixed values
BLOCK_SECONDS = 3600
DEFAULT_LIMITS = {
    "api_calls_per_minute": 60, "api_calls_per_hour": 1000, "user_queries_per_hour": 100,
    "file_uploads_per_hour": 10, "evaluation_submissions_per_hour": 50,
}
FALLBACK_LIMIT = 60
PROVIDER_LIMITS = {
    "groq": {"requests_per_minute": 100, "requests_per_hour": 1000},
    "gemini": {"requests_per_minute": 60, "requests_per_hour": 1500},
    "huggingface": {"requests_per_minute": 30, "requests_per_hour": 500},
}


@dataclass(frozen=True)
class Check:
    action: str
    limit: int

    @property
    def window(self) -> int:
        return (3600 if "per_hour" in self.action else 60) * MICROS


def check(action: str = "api_calls_per_minute", limit: int | None = None) -> Check:
    return Check(action, limit or DEFAULT_LIMITS.get(action, FALLBACK_LIMIT))


def provider_checks(provider: str) -> list[Check]:
    limits = PROVIDER_LIMITS.get(provider, {})
    return [
        Check("requests_per_minute", limits.get("requests_per_minute", 60)),
        Check("requests_per_hour", limits.get("requests_per_hour", 1000)),
    ]


class Gate:
    """Limiter state of one identifier.  Checks run in order; a passed check records the
    request even when a later check refuses it.  A refusal blocks every action."""

    def __init__(self, checks: Sequence[Check], block_seconds: int = BLOCK_SECONDS):
        self.checks = list(checks)
        self.block = block_seconds * MICROS
        self.blocked: int | None = None
        self.history = [np.zeros(0, dtype="int64") for _ in self.checks]

    def decide(self, times: np.ndarray) -> np.ndarray:
        """0 admitted, 1 refused by a limit, 2 refused while blocked; times ascend."""
        n, at = len(times), 0
        out = np.full(n, 2, dtype="int8")
        crossings = [self._crossings(times, c) for c in self.checks]
        while at < n:
            if self.blocked is not None:
                at = max(at, int(np.searchsorted(times, self.blocked + self.block, "left")))
                if at == n:
                    break
                self.blocked = None
            stop, failed = min((self._first_violation(times, at, i, crossings[i]), i) for i in range(len(self.checks)))
            out[at:stop] = 0
            for i, c in enumerate(self.checks):
                passed = stop + 1 if stop < n and i < failed else stop
                self.history[i] = np.concatenate([self.history[i], times[at:passed]])[-c.limit:]
            if stop < n:
                out[stop] = 1
                self.blocked = int(times[stop])
            at = stop + 1
        return out

    @staticmethod
    def _crossings(times: np.ndarray, c: Check) -> np.ndarray:
        """Places whose predecessor ``limit`` places back is still inside the window."""
        if len(times) <= c.limit:
            return np.zeros(0, dtype="int64")
        return np.flatnonzero(times[: -c.limit] >= times[c.limit :] - c.window) + c.limit

    def _first_violation(self, times: np.ndarray, at: int, i: int, crossings: np.ndarray) -> int:
        c, known = self.checks[i], self.history[i]
        n = len(times)
        # requests whose predecessor lies in the history kept from before
        step = np.arange(max(0, c.limit - len(known)), min(c.limit, n - at))
        if len(step):
            bad = np.flatnonzero(known[step + len(known) - c.limit] >= times[at + step] - c.window)
            if len(bad):
                return at + int(step[bad[0]])
        k = int(np.searchsorted(crossings, at + c.limit))
        return int(crossings[k]) if k < len(crossings) else n


def rate_limit(
    df: DataFrame, identifier: str, ts: str, request_id: str, checks: Sequence[Check],
    block_seconds: int = BLOCK_SECONDS,
) -> DataFrame:
    """Decision for every request of a log, in event-time order per identifier, ties by ``request_id``.

    Refusals are linked and followed by pointer doubling (``refusals``), so a busy identifier is dealt
    out over all tasks.  A block shorter than a window lets older requests count after it; then a refusal
    does not settle the next one alone, and the log is decided stretch by stretch in ``_one_by_one``.
    Requests without an identifier share one; those without a time count as made before all others.
    """
    if block_seconds * MICROS < max(c.window for c in checks):
        return _one_by_one(df, identifier, ts, request_id, checks, block_seconds)
    when = F.col(ts).cast("timestamp")
    slim = df.select(
        F.col(identifier).alias("who"), F.coalesce(F.unix_micros(when), F.lit(NEVER)).alias("us"), F.col(request_id).alias("request"), when.alias("ts"))
    out = decided(slim, checks, block_seconds)
    return out.select(
        F.col("who").alias(identifier), F.col("request").alias(request_id), F.col("ts").alias(ts), (F.col("reason") == "admitted").alias("allowed"), "reason")


def _one_by_one(
    df: DataFrame, identifier: str, ts: str, request_id: str, checks: Sequence[Check], block_seconds: int
) -> DataFrame:
    """The gate run over each stretch between pauses that clear its state; rows stream through sorted,
    holding only the gate's own bounded state."""
    quiet = max(block_seconds, *[c.window // MICROS for c in checks])
    slim = df.select(identifier, request_id, F.col(ts).cast("timestamp").alias(ts))
    islands = activity_islands(slim, [identifier], ts, quiet)
    ordered = (
        islands.withColumn("_us", F.unix_micros(ts))
        .repartition(identifier, "island")
        .sortWithinPartitions(identifier, "island", "_us", request_id)
    )

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gate, current = None, None
        for batch in batches:
            if not len(batch):
                continue
            verdicts = np.empty(len(batch), dtype="int8")
            who, island = batch[identifier].to_numpy(), batch["island"].to_numpy()
            times = batch["_us"].to_numpy()
            edges = np.flatnonzero((who[1:] != who[:-1]) | (island[1:] != island[:-1])) + 1
            for start, end in zip([0, *edges], [*edges, len(batch)]):
                if current != (who[start], island[start]):
                    gate, current = Gate(checks, block_seconds), (who[start], island[start])
                verdicts[start:end] = gate.decide(times[start:end])
            yield _verdict_frame(batch, identifier, request_id, ts, verdicts)

    return ordered.mapInPandas(decide, _verdict_schema(slim, identifier, request_id, ts))


def _verdict_frame(batch, identifier, request_id, ts, verdicts) -> pd.DataFrame:
    reasons = np.array(["admitted", "limit", "blocked"], dtype=object)
    return pd.DataFrame({
        identifier: batch[identifier], request_id: batch[request_id], ts: batch[ts],
        "allowed": verdicts == 0, "reason": reasons[verdicts],
    })


def _verdict_schema(df: DataFrame, identifier, request_id, ts) -> T.StructType:
    return T.StructType([
        df.schema[identifier], df.schema[request_id], T.StructField(ts, T.TimestampType()),
        T.StructField("allowed", T.BooleanType()), T.StructField("reason", T.StringType()),
    ])


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a key that are taken in at a time.
CHUNK = 10_000
REASONS = ("admitted", "limit", "blocked", "late")
#: Rows of a key that come in several chunks are held in the state store by spans of this length until all are there.
HELD = MICROS


class Limiter(StatefulProcessor):
    """One identifier's gate as keyed state: when it was blocked, and the newest admitted times of each check.

    All of it is one value, read once and written once per key: each call to the state store is a round trip.
    A micro-batch's rows of a key are taken in chunks, in no order of time.  A lone chunk is sorted and
    decided; several are put into a map in the state store, by second, and decided second by second, so
    no more than a chunk and a second of one key is in memory.
    """

    def __init__(self, identifier: str, ts: str, request_id: str, schema: T.StructType, checks: Sequence[Check], block_seconds: int, expires: bool):
        self.names, self.schema, self.checks = (identifier, ts, request_id), schema, list(checks)
        self.out = Row(*schema.names)
        self.block_seconds, self.expires = block_seconds, expires
        self.quiet_ms = 1000 * max(block_seconds, *[c.window // MICROS for c in checks])

    def init(self, handle: StatefulProcessorHandle) -> None:
        long = T.LongType()
        self.handle = handle
        times = T.ArrayType(T.ArrayType(long))
        self.state = handle.getValueState("gate", T.StructType([T.StructField("blocked", long), T.StructField("last", long), T.StructField("times", times)]))
        one = T.StructType([T.StructField("us", long), T.StructField("request", self.schema[self.names[2]].dataType)])
        self.held = handle.getMapState("held", T.StructType([T.StructField("span", long)]), T.StructType([T.StructField("rows", T.ArrayType(one))]))

    def _gate(self) -> tuple[Gate, int | None]:
        gate, last = Gate(self.checks, self.block_seconds), None
        if (known := self.state.get()) is not None:
            blocked, last, times = known
            gate.blocked = None if blocked is None or pd.isna(blocked) else int(blocked)
            gate.history = [np.array(x, "int64") for x in times]
        return gate, None if last is None else int(last)

    def _verdicts(self, key, part: list[tuple], verdicts: np.ndarray) -> Iterator[Row]:
        for (us, request), verdict in zip(part, verdicts.tolist()):
            yield self.out(key[0], request, us, verdict == 0, REASONS[verdict])

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000 if self.expires else -1
        gate, last = self._gate()
        first, spans = None, set()
        pairs = ((row[2], row[1]) for row in rows)
        while chunk := list(islice(pairs, CHUNK)):
            late = [x for x in chunk if x[0] is None or x[0] < watermark]
            if late:
                yield from self._verdicts(key, late, np.full(len(late), 3))
                chunk = [x for x in chunk if x[0] is not None and x[0] >= watermark]
            if first is None and not spans:
                first = chunk
                continue
            for held in (x for x in (first, chunk) if x is not None):
                spans |= self._hold(held)
            first = None
        newest = last
        for part in [first] if first is not None else map(self._take, sorted(spans)):
            if not len(part):
                continue
            part.sort(key=lambda x: (x[0], True) if x[1] is None else (x[0], False, x[1]))
            micros = np.array([us for us, _ in part], "int64")
            # a row older than one that is decided counts as happening then
            counted = micros if newest is None else np.maximum(micros, newest)
            newest = int(counted[-1])
            yield from self._verdicts(key, part, gate.decide(counted))
        if newest is None or newest == last and first is not None and not len(first):
            return
        self.state.update((gate.blocked, newest, [h.tolist() for h in gate.history]))
        if self.expires:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
            self.handle.registerTimer(max(newest // 1000, timerValues.getCurrentWatermarkInMs()) + self.quiet_ms)

    def _hold(self, part: list[tuple]) -> set[int]:
        spans = defaultdict(list)
        for x in part:
            spans[x[0] // HELD].append(x)
        for span, rows in spans.items():
            known = self.held.getValue((span,))[0] if self.held.containsKey((span,)) else []
            self.held.updateValue((span,), ([tuple(x) for x in known] + rows,))
        return set(spans)

    def _take(self, span: int) -> list[tuple]:
        rows = self.held.getValue((span,))[0]
        self.held.removeKey((span,))
        return [tuple(x) for x in rows]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """The identifier has been quiet so long that nothing it did counts any more."""
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def rate_limit_stream(
    stream: DataFrame, identifier: str, ts: str, request_id: str, checks: Sequence[Check],
    block_seconds: int = BLOCK_SECONDS, expire_after: str | None = None,
) -> DataFrame:
    """The same decisions on a stream, with the gate as keyed state.

    Rows are decided in time order within a micro-batch; a row that arrives after a later
    one was decided counts as happening then.  Without ``expire_after`` every identifier
    keeps its bounded state.  With it (a watermark delay) an event-time timer removes idle
    identifiers, and rows later than the watermark come out undecided, with the reason ``late``.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # the store that lists, maps and timers need
    slim = stream.select(identifier, request_id, F.col(ts).cast("timestamp").alias(ts))
    schema = _verdict_schema(slim, identifier, request_id, ts)
    schema[ts].dataType = T.LongType()  # microseconds
    mode = "None"
    if expire_after:
        # the watermark follows a column of its own, or late rows would be gone before the gate sees them
        slim = slim.withColumn("_seen", F.col(ts)).withWatermark("_seen", expire_after).select(identifier, request_id, ts)
        mode = "EventTime"
    slim = slim.withColumn(ts, F.unix_micros(ts))
    limiter = Limiter(identifier, ts, request_id, schema, checks, block_seconds, bool(expire_after))
    # rows, not frames: a frame a key costs far more than a key's few rows
    decisions = slim.groupBy(identifier).transformWithState(limiter, schema, "append", mode)
    return decisions.withColumn(ts, F.timestamp_micros(ts))


def remaining_calls(df: DataFrame, keys: Sequence[str], ts: str, checks: Sequence[Check]) -> DataFrame:
    """After each request: calls left in every window and when its oldest request leaves."""
    out = df
    for c in checks:
        out = trailing_count(out, keys, ts, c.window // MICROS, f"_n_{c.action}", f"_old_{c.action}")
        out = out.withColumn(f"remaining_{c.action}", F.greatest(F.lit(0), c.limit - F.col(f"_n_{c.action}"))).withColumn(
            f"reset_{c.action}", F.timestamp_micros(F.unix_micros(f"_old_{c.action}") + c.window)
        ).drop(f"_n_{c.action}", f"_old_{c.action}")
    return out


def limiter_stats(decisions: DataFrame, identifier: str, action: str | None = None) -> DataFrame:
    keys = [identifier] + ([action] if action else [])
    return decisions.agg(
        F.countDistinct(identifier).alias("identifiers"), F.countDistinct(*keys).alias("actions"),
        F.countDistinct(F.when(~F.col("allowed"), F.col(identifier))).alias("blocked_identifiers"),
    )
