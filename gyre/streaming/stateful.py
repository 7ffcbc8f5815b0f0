"""Machines of keyed.py as stateful processors: state in the store, ended by timers on event time."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import asdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gyre.streaming.keyed import MicroBatch, SlidingLog


def _in_order(frames: Iterator[pd.DataFrame], *columns: str) -> list[np.ndarray]:
    """The columns of a key's rows in one micro-batch by the first two, time and id: what a batch brings of a key is held, its bound is that of the batch.

    A stream has many keys with few rows, so that arrays are sorted, not frames.
    """
    held = list(frames)
    arrays = [held[0][c].to_numpy() if len(held) == 1 else np.concatenate([f[c].to_numpy() for f in held]) for c in columns]
    place = np.lexsort((arrays[1], arrays[0]))
    return [a[place] for a in arrays]


class _Keyed(StatefulProcessor):
    """key, order, seconds and value name the columns of the events; a subclass has the state."""

    def __init__(self, key: str, order: str, seconds: str, value: str):
        self.key, self.order, self.seconds, self.value = key, order, seconds, value

    def _end_at(self, seconds: float, before: float | None) -> None:
        """One timer for the key, at that time; before is the time of the one that the key's state had set, None without state. Each call goes to the store and back."""
        new, old = (None if x is None else int(x * 1000) + 1 for x in (seconds, before))
        if new == old:
            return
        if old is not None:
            self.handle.deleteTimer(old)
        self.handle.registerTimer(new)

    def close(self) -> None:
        pass


class MachineProcessor(_Keyed):
    """Any machine: its fields are the state. idle: seconds after the last event after which the machine is as new, so that its state ends."""

    def __init__(self, machine: Callable[[], object], idle: float | None, **columns: str):
        super().__init__(**columns)
        self.machine, self.idle = machine, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("machine", T.StructType([T.StructField("fields", T.StringType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        machine, before, held = self.machine(), None, self.state.get()
        if held is not None:
            fields, before = json.loads(held[0])
            for name, value in fields.items():
                setattr(machine, name, value)
        at, ids, values = _in_order(rows, self.seconds, self.order, self.value)
        allowed = [machine.step(t, v) for t, v in zip(at.tolist(), values.tolist(), strict=True)]
        end = None if self.idle is None else float(at[-1]) + self.idle
        self.state.update((json.dumps([asdict(machine), end]),))
        if end is not None:
            self._end_at(end, before)
        yield pd.DataFrame({self.key: key[0], self.order: ids, "allowed": allowed})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        self.state.clear()
        yield from ()


class SlidingLogProcessor(_Keyed):
    """The times of granted requests are a list in the state; it ends a window after the last of them."""

    def __init__(self, limit: int, window: float, **columns: str):
        super().__init__(**columns)
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.granted = handle.getListState("granted", T.StructType([T.StructField("at", T.DoubleType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        log = SlidingLog(self.limit, self.window, deque(x[0] for x in self.granted.get()))
        before = log.granted[-1] + self.window if log.granted else None
        at, ids = _in_order(rows, self.seconds, self.order)
        allowed = [log.step(t) for t in at.tolist()]
        self.granted.put([(t,) for t in log.granted])
        self._end_at(log.granted[-1] + self.window, before)
        yield pd.DataFrame({self.key: key[0], self.order: ids, "allowed": allowed})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        self.granted.clear()
        yield from ()


class MicroBatchProcessor(_Keyed):
    """Items wait in a list until there are size of them, or wait seconds have passed since the first: then a row for the batch leaves, by a timer if no item comes."""

    def __init__(self, size: int, wait: float, **columns: str):
        super().__init__(**columns)
        self.size, self.wait = size, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", T.StructType([T.StructField("id", T.LongType()), T.StructField("at", T.DoubleType())]))

    def _released(self, key, items: list[tuple[int, float]]) -> dict:
        return {self.key: key[0], "first": items[0][0], "last": items[-1][0], "n": len(items)}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        items = [(int(x[0]), float(x[1])) for x in self.held.get()]
        machine = MicroBatch(self.size, self.wait, len(items), items[0][1] if items else 0.0)
        before = items[0][1] + self.wait if items else None
        out = []
        at, ids = _in_order(rows, self.seconds, self.order)
        for item in zip(ids.astype("int64").tolist(), at.tolist(), strict=True):
            if machine.step(item[1]) and items:
                out.append(self._released(key, items))
                items = []
            items.append(item)
        self.held.put(items)
        self._end_at(items[0][1] + self.wait, before)
        yield pd.DataFrame(out, columns=[self.key, "first", "last", "n"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        items = [(int(x[0]), float(x[1])) for x in self.held.get()]
        self.held.clear()
        yield pd.DataFrame([self._released(key, items)] if items else [], columns=[self.key, "first", "last", "n"])


def processed(events: DataFrame, processor: _Keyed, time: str, delay: str, schema: str) -> DataFrame:
    """The rows of a processor over a stream of events; time is the column of the watermark."""
    return events.withWatermark(time, delay).groupBy(processor.key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="EventTime")


def allowed_stream(events: DataFrame, processor: _Keyed, time: str, delay: str = "0 seconds") -> DataFrame:
    """(key, order, allowed) of a processor that judges each event."""
    kind = lambda c: events.schema[c].dataType.simpleString()
    return processed(events, processor, time, delay, f"{processor.key} {kind(processor.key)}, {processor.order} {kind(processor.order)}, allowed boolean")


def batch_stream(events: DataFrame, processor: MicroBatchProcessor, time: str, delay: str = "0 seconds") -> DataFrame:
    """(key, first, last, n) of each batch that a MicroBatchProcessor releases."""
    kind = events.schema[processor.key].dataType.simpleString()
    return processed(events, processor, time, delay, f"{processor.key} {kind}, first long, last long, n long")
