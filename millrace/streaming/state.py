"""Stateful streams (P3, P5, P6). Each runs on a stream or, with the same rows, on a table."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def take_tokens(times: list[float], tokens: float, last: float | None, per_minute: int) -> tuple[list[tuple[bool, int]], float, float | None]:
    """What a bucket of `per_minute` tokens answers at each time (seconds): allowed, or the whole seconds until there is a token."""
    answers = []
    for t in times:
        tokens = min(float(per_minute), tokens + max(0.0, t - last) * per_minute / 60.0) if last is not None else float(per_minute)
        last = t if last is None else max(t, last)
        if tokens >= 1.0:
            tokens -= 1.0
            answers.append((True, 0))
        else:
            answers.append((False, max(1, math.ceil((1.0 - tokens) * 60.0 / per_minute))))
    return answers, tokens, last


def rate_audit(events: DataFrame, per_minute: int, idle_minutes: int = 60) -> DataFrame:
    """events (key, event_id, at) with allowed and retry_after by a token bucket for each key on event time. In a table the rows of
    a key pass one task in order of time and id, a batch at a time with the bucket alone carried on, so a hot key takes time but no
    memory; on a stream the bucket is state, forgotten when its key is idle."""
    kind = dict(events.dtypes)
    schema = f"key {kind['key']}, event_id {kind['event_id']}, allowed boolean, retry_after int"
    rows = events.select("key", "event_id", F.unix_micros(F.col("at").cast("timestamp")).alias("us"))

    def answered(part: pd.DataFrame, tokens: float, last: float | None):
        answers, tokens, last = take_tokens((part["us"] / 1e6).tolist(), tokens, last, per_minute)
        out = part[["key", "event_id"]].assign(allowed=[a for a, _ in answers], retry_after=[r for _, r in answers])
        return out, tokens, last

    if not events.isStreaming:

        def audit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: tuple = (None, 0.0, None)
            for batch in batches:
                for key, part in batch.groupby("key", sort=False, dropna=False):
                    tokens, last = held[1:] if key == held[0] else (0.0, None)
                    out, tokens, last = answered(part, tokens, last)
                    held = (key, tokens, last)
                    yield out

        return rows.where("key is not null and us is not null").repartition("key").sortWithinPartitions("key", "us", "event_id").mapInPandas(audit, schema)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (0.0, None)
        part = pd.concat(list(parts)).sort_values(["us", "event_id"])
        out, tokens, last = answered(part, tokens, last)
        state.update((tokens, last))
        state.setTimeoutDuration(idle_minutes * 60_000)
        yield out

    named = rows.where("key is not null and us is not null")
    return named.groupBy("key").applyInPandasWithState(step, schema, "tokens double, last double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def answers_of(deltas: DataFrame, gap_minutes: int = 10) -> DataFrame:
    """(session, text): the deltas (session, seq, delta, done) of each session in order, up to and with the first that is done.
    Sessions without such a delta give nothing; what comes after it changes nothing."""
    kind = dict(deltas.dtypes)["session"]
    rows = deltas.select("session", "seq", F.coalesce("delta", F.lit("")).alias("delta"), F.coalesce("done", F.lit(False)).alias("done")).where("session is not null and seq is not null")
    if not deltas.isStreaming:
        end = F.min(F.when(F.col("done"), F.col("seq"))).over(Window.partitionBy("session"))
        until = rows.withColumn("end", end).where("seq <= end")
        parts = F.array_sort(F.collect_list(F.struct("seq", "delta")))
        return until.groupBy("session").agg(parts.alias("p")).select("session", F.concat_ws("", F.transform("p", lambda p: p["delta"])).alias("text"))

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        text, done = state.get if state.exists else ("", False)
        state.setTimeoutDuration(gap_minutes * 60_000)
        if done:
            return
        for delta, last in pd.concat(list(parts)).sort_values("seq")[["delta", "done"]].itertuples(index=False):
            text += delta
            if last:
                done = True
                break
        state.update(("" if done else text, done))
        if done:
            yield pd.DataFrame({"session": [key[0]], "text": [text]})

    return rows.groupBy("session").applyInPandasWithState(step, f"session {kind}, text string", "text string, done boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def recent_turns(turns: DataFrame, n: int = 20, keep_hours: int = 24) -> DataFrame:
    """(conv_id, turn, role, rank): the n last turns of a conversation, the newest first. On a stream each batch gives them for
    the conversations it touches, and they are forgotten after `keep_hours` without a new turn."""
    if not turns.isStreaming:
        w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
        return turns.select("conv_id", "turn", "role", F.row_number().over(w).alias("rank")).where(F.col("rank") <= n)
    kind = dict(turns.dtypes)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = json.loads(state.get[0]) if state.exists else []
        for part in parts:
            held = sorted(held + [[int(t), r] for t, r in zip(part["turn"], part["role"])], key=lambda x: -x[0])[:n]
        state.update((json.dumps(held),))
        state.setTimeoutDuration(keep_hours * 3_600_000)
        yield pd.DataFrame({"conv_id": key[0], "turn": [t for t, _ in held], "role": [r for _, r in held], "rank": range(1, len(held) + 1)})

    schema = f"conv_id {kind['conv_id']}, turn {kind['turn']}, role string, rank int"
    return turns.select("conv_id", "turn", "role").where("conv_id is not null and turn is not null").groupBy("conv_id").applyInPandasWithState(step, schema, "turns string", "update", GroupStateTimeout.ProcessingTimeTimeout)
