"""Keyed state machines over streams: operations that run once, failing sources, stuck queues, throttled edits.

One key is worked on by one task at a time, which is the mutual exclusion the machines need. Each has
a batch form in ``vitrine.operators.windows``; both give the same rows for the same ordered input.
State stores: applyInPandasWithState works with any provider.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vitrine.functions.numbers import BACKOFF_MINUTES, BACKOFF_OTHER, DISABLE_AFTER

NO_TIMEOUT = GroupStateTimeout.NoTimeout


def _ordered(frames: Iterator[pd.DataFrame], *columns: str) -> pd.DataFrame:
    rows = list(frames)
    return pd.concat(rows).sort_values(list(columns), kind="stable") if rows else pd.DataFrame(columns=list(columns))


def _first_of(frames: Iterator[pd.DataFrame]) -> tuple[tuple[int, str] | None, int]:
    """The (id, result) with the least id, the first of equal ones, and the number of rows; nothing is gathered or sorted."""
    first, n = None, 0
    for frame in frames:
        ids = frame["id"].to_numpy()
        n += len(ids)
        if len(ids) and (first is None or ids.min() < first[0]):
            at = ids.argmin()
            first = (int(ids[at]), str(frame["result"].iat[at]))
    return first, n


def executed_once(operations: DataFrame) -> DataFrame:
    """(idempotency_key, id, result, repeated): the first operation of a key runs, later ones get its result."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = state.get if state.exists else None
        first, n = _first_of(frames)
        if not n:
            return
        repeated = np.ones(n, bool)
        if known is None:
            known, repeated[0] = first, False
            state.update(known)
        yield pd.DataFrame({"idempotency_key": key[0], "id": known[0], "result": known[1], "repeated": repeated})

    return operations.select("idempotency_key", "id", "result").groupBy("idempotency_key").applyInPandasWithState(
        step, "idempotency_key string, id long, result string, repeated boolean", "id long, result string", "append", NO_TIMEOUT)


def failing_sources(events: DataFrame) -> DataFrame:
    """(domain, id, kind, failure_count, disabled, retry_minutes): each failure with its place in a row of its kind; a success (no kind) starts over."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, count = state.get if state.exists else ("", 0)
        out = []
        for row in _ordered(frames, "at", "id").itertuples(index=False):
            if row.kind is None or row.kind != row.kind:
                last, count = "", 0
                continue
            count = count + 1 if row.kind == last else 1
            last = row.kind
            off = count >= DISABLE_AFTER.get(last, 1 << 62)
            minutes = min(60, 2 ** min(5, count)) if last in ("browser_timeout", "browser_protocol") else BACKOFF_MINUTES.get(last, BACKOFF_OTHER)
            out.append((key[0], row.id, last, count, off, None if off else minutes))
        state.update((last, count))
        frame = pd.DataFrame(out, columns=["domain", "id", "kind", "failure_count", "disabled", "retry_minutes"])
        frame["retry_minutes"] = frame["retry_minutes"].astype("Int64")
        yield frame

    return events.select("domain", "id", "at", "kind").groupBy("domain").applyInPandasWithState(
        step, "domain string, id long, kind string, failure_count long, disabled boolean, retry_minutes long", "kind string, count long", "append", NO_TIMEOUT)


def stuck_queues(checks: DataFrame, threshold: int = 180, cooldown: int = 900) -> DataFrame:
    """(queue, at): alerts on checks (queue, at, oldest_waiting), one a cooldown; a drained queue ends it."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        alerted = state.get[0] if state.exists else None
        out = []
        for row in _ordered(frames, "at").itertuples(index=False):
            if pd.isna(row.oldest_waiting):
                alerted = None
            elif row.at - row.oldest_waiting >= threshold and (alerted is None or row.at - alerted >= cooldown):
                alerted = int(row.at)
                out.append((key[0], alerted))
        state.update((alerted,))
        yield pd.DataFrame(out, columns=["queue", "at"])

    return checks.select("queue", "at", "oldest_waiting").groupBy("queue").applyInPandasWithState(step, "queue string, at long", "alerted long", "append", NO_TIMEOUT)


def throttled(edits: DataFrame, seconds: float = 1.2) -> DataFrame:
    """(message_id, at, final): edits of a message at least ``seconds`` apart; a final one always passes."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for row in _ordered(frames, "at").itertuples(index=False):
            if row.final or last is None or row.at - last >= seconds:
                last = float(row.at)
                out.append((key[0], last, bool(row.final)))
        state.update((last,))
        yield pd.DataFrame(out, columns=["message_id", "at", "final"])

    return edits.select("message_id", "at", "final").groupBy("message_id").applyInPandasWithState(step, "message_id long, at double, final boolean", "last double", "append", NO_TIMEOUT)


def conversation_models(events: DataFrame) -> DataFrame:
    """(chat_id, id, model, turn): messages with their number since the chat last changed its model."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        model, turn = state.get if state.exists else ("", 0)
        out = []
        for row in _ordered(frames, "id").itertuples(index=False):
            model, turn = (row.model, 1) if row.model != model else (model, turn + 1)
            out.append((key[0], row.id, model, turn))
        state.update((model, turn))
        yield pd.DataFrame(out, columns=["chat_id", "id", "model", "turn"])

    return events.select("chat_id", "id", "model").groupBy("chat_id").applyInPandasWithState(step, "chat_id string, id long, model string, turn long", "model string, turn long", "append", NO_TIMEOUT)


def deduplicated_requests(requests: DataFrame, minutes: int = 12) -> DataFrame:
    """(key, at): a request raises a flag that refuses others for ``minutes``; the flag's expiry is its state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        until = state.get[0] if state.exists else None
        out = []
        for row in _ordered(frames, "at").itertuples(index=False):
            if until is None or row.at >= until:
                until = int(row.at) + minutes * 60
                out.append((key[0], int(row.at)))
        state.update((until,))
        yield pd.DataFrame(out, columns=["key", "at"])

    return requests.select("key", "at").groupBy("key").applyInPandasWithState(step, "key string, at long", "until long", "append", NO_TIMEOUT)
