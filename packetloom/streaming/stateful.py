"""The stateful operators as Structured Streaming: keyed state per group, results as batch would give for the same order of events.

Each key's events are folded in (t, seq) order within a micro-batch. State is a few longs a key. With
idle_ms, keys idle for so much processing time are dropped; such a query never runs dry, so it isn't for the availableNow trigger.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _expired(state: GroupState, idle_ms: int | None) -> bool:
    if idle_ms is None:
        return False
    if state.hasTimedOut:
        state.remove()
        return True
    state.setTimeoutDuration(idle_ms)
    return False


def _timeout(idle_ms: int | None) -> str:
    return GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def window_hits(stream: DataFrame, key: str, n: int, span: int, idle_ms: int | None = None) -> DataFrame:
    """Events that complete n of their key (a string column) within span, with the n-th last time."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState):
        if _expired(state, idle_ms):
            return
        ring = list(state.get[0]) if state.exists else []
        rows = []
        for p in pd.concat(list(batches)).sort_values(["t", "seq"]).itertuples(index=False):
            ring = [*ring, int(p.t)][-n:]
            if len(ring) == n and p.t - ring[0] <= span:
                rows.append((k[0], p.seq, p.t, ring[0]))
        state.update((ring,))
        yield pd.DataFrame(rows, columns=[key, "seq", "t", "oldest"])

    lean = stream.select(key, "seq", "t")
    return lean.groupBy(key).applyInPandasWithState(step, f"{key} string, seq long, t long, oldest long", "ring array<long>", "append", _timeout(idle_ms))


def dedup(stream: DataFrame, key: str, window: int, idle_ms: int | None = None) -> DataFrame:
    """The alerts of a stream of firings, and a summary for each window that counted more once a later firing closes it."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState):
        if _expired(state, idle_ms):
            return
        first, last, n = state.get if state.exists else (None, None, 0)
        rows = []
        for p in pd.concat(list(batches)).sort_values(["t", "seq"]).itertuples(index=False):
            if first is None or p.t - first >= window:
                if n > 1:
                    rows.append((k[0], "summary", first, last, n))
                first, last, n = int(p.t), int(p.t), 1
                rows.append((k[0], "alert", first, last, 1))
            else:
                last, n = int(p.t), n + 1
        state.update((first, last, n))
        yield pd.DataFrame(rows, columns=[key, "kind", "first_t", "last_t", "n"])

    lean = stream.select(key, "seq", "t")
    return lean.groupBy(key).applyInPandasWithState(step, f"{key} string, kind string, first_t long, last_t long, n long", "first_t long, last_t long, n long", "append", _timeout(idle_ms))
