"""State machines over events by key: token bucket, circuit breaker, cache. One step function serves batch and stream.

Each machine has a start state (a tuple of numbers) and a step from (state,
time in milliseconds, event) to (state, output). In a batch, a key's events are
grouped and taken in the order of (ts, event_id); in a stream the state is kept
between batches by ``applyInPandasWithState``.
"""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

MS = 1_000_000
OUTPUT = "key string, event_id long, verdict string, level double"


@dataclass(frozen=True)
class TokenBucket:
    """A request takes a token; floor(minutes * per_minute / 60) come back, up to ``burst``."""

    burst: int = 20
    per_minute: int = 60

    def start(self, now: int) -> list:
        return [self.burst, now]

    def step(self, state: list, now: int, event: str) -> tuple[list, str, float]:
        tokens, since = state
        back = int((now - since) / 60_000 * (self.per_minute / 60))
        if back > 0:
            tokens, since = min(self.burst, tokens + back), now
        allowed = tokens > 0
        return [tokens - allowed, since], "allowed" if allowed else "limited", float(tokens - allowed)


@dataclass(frozen=True)
class CircuitBreaker:
    """Opens after ``failures`` errors in a row, tries again after ``recovery`` ms, closes after ``successes``.

    Successes are counted from the start and only set back by a failed trial.
    """

    failures: int = 5
    successes: int = 3
    recovery: int = 60_000
    failing: str = "error"

    def start(self, now: int) -> list:
        return ["closed", 0, 0, 0]

    def step(self, state: list, now: int, event: str) -> tuple[list, str, float]:
        mode, failed, good, retry = state
        if mode == "open":
            if now < retry:
                return state, "rejected", float(failed)
            mode = "half_open"
        if event != self.failing:
            good += 1
            if mode == "closed":
                failed = 0
            elif good >= self.successes:
                mode, failed, retry = "closed", 0, 0
        else:
            failed += 1
            if mode == "half_open":
                mode, retry, good = "open", now + self.recovery, 0
            elif failed >= self.failures:
                mode, retry = "open", now + self.recovery
        return [mode, failed, good, retry], mode, float(failed)


@dataclass(frozen=True)
class Cache:
    """Least recently used entries go beyond ``size``; entries live ``ttl`` ms. The event is the key that is asked for."""

    size: int = 3
    ttl: int = 3_600_000

    def start(self, now: int) -> list:
        return []

    def step(self, state: list, now: int, event: str) -> tuple[list, str, float]:
        held = OrderedDict((k, t) for k, t in state)
        hit = event in held and now - held[event] <= self.ttl
        if hit:
            held.move_to_end(event)
        else:
            held.pop(event, None)
            held[event] = now
            while len(held) > self.size:
                held.popitem(last=False)
        return [[k, t] for k, t in held.items()], "hit" if hit else "miss", float(len(held))


def _run(machine, key, state, rows: pd.DataFrame) -> tuple[list, pd.DataFrame]:
    out = []
    rows = rows.sort_values(["ts", "event_id"])
    for ts, event_id, event in zip(rows["ts"].astype("datetime64[ns]").astype("int64") // MS, rows["event_id"], rows["event"], strict=True):
        state = machine.start(int(ts)) if state is None else state
        state, verdict, level = machine.step(state, int(ts), event)
        out.append((str(key), int(event_id), verdict, level))
    return state, pd.DataFrame(out, columns=["key", "event_id", "verdict", "level"])


def replay(events: DataFrame, machine) -> DataFrame:
    """(key, event_id, verdict, level) of a table (key, ts, event_id, event). A key's events must fit in memory; a stream keeps only its state."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _run(machine, key[0], None, rows)[1]

    return events.groupBy("key").applyInPandas(run, OUTPUT)


def stream(events: DataFrame, machine, timeout: str = "NoTimeout") -> DataFrame:
    """The same over a streaming table; state is kept as JSON text."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else None
        rows = pd.concat(list(batches), ignore_index=True)
        held, out = _run(machine, key[0], held, rows)
        state.update((json.dumps(held),))
        yield out

    return events.groupBy("key").applyInPandasWithState(run, OUTPUT, "state string", "append", timeout)


__all__ = ["Cache", "CircuitBreaker", "TokenBucket", "replay", "stream"]
