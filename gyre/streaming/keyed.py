"""Keyed state over ordered events: token buckets, circuit breakers, alerts, sliding logs.

Each machine is a plain class with a step; the batch form folds it over the
sorted rows of a key, the streaming form keeps it as the state of the key.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gyre.session import ship


@dataclass
class TokenBucket:
    """limit requests a window of seconds, with bursts of burst times as many."""

    limit: int
    window: float
    burst: float = 1.5
    tokens: float | None = None
    last: float = 0.0

    def step(self, now: float, _: float = 0.0) -> bool:
        most = int(self.limit * self.burst)
        self.tokens = most if self.tokens is None else min(most, self.tokens + (now - self.last) * self.limit / self.window)
        self.last = now
        allowed = self.tokens >= 1
        self.tokens -= allowed
        return allowed


@dataclass
class MicroBatch:
    """Batches of at most size items, closed wait seconds after their first. A step says whether its item opens a batch."""

    size: int
    wait: float
    held: int = 0
    since: float = 0.0

    def step(self, now: float, _: float = 0.0) -> bool:
        opens = self.held in (0, self.size) or now - self.since >= self.wait
        if opens:
            self.held, self.since = 0, now
        self.held += 1
        return opens


@dataclass
class CircuitBreaker:
    """Opens after failures, lets trial requests through after a timeout, closes after successes. value 1 is a failure."""

    failures_to_open: int = 5
    successes_to_close: int = 2
    timeout: float = 60.0
    trials: int = 3
    state: str = "closed"
    failures: int = 0
    successes: int = 0
    opened: float = 0.0
    tried: int = 0

    def step(self, now: float, failed: float) -> bool:
        if self.state == "open":
            if now - self.opened < self.timeout:
                return False
            self.state, self.tried = "half_open", 0
        elif self.state == "half_open":
            if self.tried >= self.trials:
                return False
            self.tried += 1
        if failed:
            self.failures += 1
            if self.state == "half_open" or self.failures >= self.failures_to_open:
                self.state, self.opened, self.successes = "open", now, 0
        else:
            self.successes += 1
            if self.state == "half_open" and self.successes >= self.successes_to_close:
                self.state, self.failures, self.successes = "closed", 0, 0
        return True


@dataclass
class SlidingLog:
    """At most limit granted requests in any window of seconds."""

    limit: int
    window: float
    granted: deque = field(default_factory=deque)

    def step(self, now: float, _: float = 0.0) -> bool:
        while self.granted and self.granted[0] <= now - self.window:
            self.granted.popleft()
        if len(self.granted) >= self.limit:
            return False
        self.granted.append(now)
        return True


@dataclass
class Cooldown:
    """An alert a key, and no other within a cooldown of seconds."""

    seconds: float
    last: float | None = None

    def step(self, now: float, _: float = 0.0) -> bool:
        if self.last is not None and now - self.last < self.seconds:
            return False
        self.last = now
        return True


@dataclass
class TwoLimits:
    """Buckets of a key for the current minute and for the current hour, each full at its start; limits has (a minute, an hour) for each kind of request.

    A request that the minute denies takes nothing from the hour. value is the
    kind.
    """

    limits: dict[int, tuple[int, int]]
    burst: float = 1.5
    minute: list[float] | None = None
    hour: list[float] | None = None

    def _take(self, bucket: list[float] | None, now: float, limit: int, window: int) -> tuple[list[float], bool]:
        most, start = int(limit * self.burst), now // window
        tokens = most if bucket is None or bucket[0] != start else min(most, bucket[1] + (now - bucket[2]) * limit / window)
        return [start, tokens - (tokens >= 1), now], tokens >= 1

    def step(self, now: float, kind: float) -> bool:
        a_minute, an_hour = self.limits[int(kind)]
        self.minute, allowed = self._take(self.minute, now, a_minute, 60)
        if allowed:
            self.hour, allowed = self._take(self.hour, now, an_hour, 3600)
        return allowed


@dataclass
class FifoCache:
    """A bounded cache: what was put in first goes first, and nothing lives longer than seconds. A step says whether its key was a hit; a miss is put in."""

    size: int
    seconds: float
    held: dict = field(default_factory=dict)

    def step(self, now: float, key: float) -> bool:
        if key in self.held and now - self.held[key] < self.seconds:
            return True
        self.held.pop(key, None)
        while len(self.held) >= self.size:
            del self.held[next(iter(self.held))]
        self.held[key] = now
        return False


@dataclass
class TieredCache:
    """Two tiers that each forget what was used longest ago. A hit in the second is promoted to the first; a miss is put into both. A step says whether the first had it."""

    first: int
    second: int
    upper: dict = field(default_factory=dict)
    lower: dict = field(default_factory=dict)

    @staticmethod
    def _use(tier: dict, key: float, size: int) -> None:
        tier.pop(key, None)
        tier[key] = True
        if len(tier) > size:
            del tier[next(iter(tier))]

    def step(self, _: float, key: float) -> bool:
        hit = key in self.upper
        if not hit:
            self._use(self.lower, key, self.second)
        self._use(self.upper, key, self.first)
        return hit


def fold(events: DataFrame, machine: Callable[[], object], key: str, seconds: str, order: str, value: str) -> DataFrame:
    """(key, order, allowed) of events in the order of their time and id in each key.

    The order within a key is the semantics: a key's events are folded by one
    task, in Arrow batches of bounded size, so that its memory doesn't grow.
    """
    ship(events.sparkSession)
    fields = events.select(key, order).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = object(), None
        for pdf in batches:
            out = []
            for k, t, v in zip(pdf[key], pdf[seconds], pdf[value], strict=True):
                if k != current:
                    current, state = k, machine()
                out.append(state.step(t, v))
            yield pd.DataFrame({key: pdf[key], order: pdf[order], "allowed": out})

    dealt = events.select(key, order, seconds, value).repartition(key).sortWithinPartitions(key, seconds, order)
    kind = lambda n: fields[n].dataType.simpleString()
    return dealt.mapInPandas(run, f"{key} {kind(key)}, {order} {kind(order)}, allowed boolean")


def token_bucket_stream(events: DataFrame, key: str, seconds: str, order: str, limit: int, window: float, burst: float = 1.5) -> DataFrame:
    """The streaming form: the bucket is the state of the key and survives batches."""
    ship(events.sparkSession)
    kind = events.select(key, order).schema

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (None, 0.0)
        bucket = TokenBucket(limit, window, burst, tokens, last)
        for pdf in frames:
            pdf = pdf.sort_values([seconds, order])
            yield pd.DataFrame({key: pdf[key], order: pdf[order], "allowed": [bucket.step(t) for t in pdf[seconds]]})
        state.update((float(bucket.tokens), float(bucket.last)))

    schema = f"{key} {kind[key].dataType.simpleString()}, {order} {kind[order].dataType.simpleString()}, allowed boolean"
    return events.groupBy(key).applyInPandasWithState(step, schema, "tokens double, last double", "append", GroupStateTimeout.NoTimeout)
