"""Streams against plain folds and batch twins, over several slices with a restart between them; joins on time."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gyre.operators.temporal import asof_join, interval_join
from gyre.streaming.event_time import sessions, windowed
from gyre.streaming.keyed import CircuitBreaker, MicroBatch, SlidingLog
from gyre.streaming.replay import replayed
from gyre.streaming.stateful import MachineProcessor, MicroBatchProcessor, SlidingLogProcessor, allowed_stream, batch_stream

SCHEMA = "event_id long, user_id long, s double, failed double, slice int"
COLUMNS = {"key": "user_id", "order": "event_id", "seconds": "s", "value": "failed"}
START = 1_700_000_000


def events(seed, n=300, users=6):
    r = random.Random(seed)
    at = sorted(START + r.randrange(90_000) for _ in range(n))
    # half of all events are of one user
    return [(i, 0 if r.random() < 0.5 else r.randrange(1, users), float(t), float(r.random() < 0.4), min(2, (t - START) // 30_000)) for i, t in enumerate(at)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("s"))


def folded(rows, machine):
    """event_id -> what the machine of its user says."""
    state, out = {}, {}
    for i, user, s, failed, _ in sorted(rows, key=lambda x: (x[2], x[0])):
        out[i] = state.setdefault(user, machine()).step(s, failed)
    return out


@pytest.mark.parametrize(("make", "machine"), [
    (lambda: SlidingLogProcessor(3, 4000.0, **COLUMNS), lambda: SlidingLog(3, 4000.0)),
    (lambda: MachineProcessor(lambda: CircuitBreaker(timeout=900.0), None, **COLUMNS), lambda: CircuitBreaker(timeout=900.0)),
])
def test_machines_keep_their_state_over_restarts(spark, make, machine):
    rows = events(1)
    got = replayed(frame(spark, rows), "slice", 3, lambda s: allowed_stream(s, make(), "ts"))
    assert {x.event_id: x.allowed for x in got.collect()} == folded(rows, machine)


def test_timers_release_batches(spark):
    """Batches equal those of the fold; those that no later item would close leave by a timer."""
    rows = events(2)
    end = [(10**6, -1, float(START + 10**7), 0.0, 3)]
    got = replayed(frame(spark, rows + end), "slice", 4, lambda s: batch_stream(s, MicroBatchProcessor(5, 1500.0, **COLUMNS), "ts")).where("user_id >= 0")
    opens = folded(rows, lambda: MicroBatch(5, 1500.0))
    batches = defaultdict(list)
    for i, user, *_ in sorted(rows, key=lambda x: (x[2], x[0])):
        if opens[i]:
            batches[user].append([])
        batches[user][-1].append(i)
    assert sorted(tuple(x) for x in got.collect()) == sorted((u, b[0], b[-1], len(b)) for u, bs in batches.items() for b in bs)


def test_late_rows_are_left_out(spark):
    """A window that the watermark has passed takes no rows that come later; one that it hasn't still does."""
    early, late, still = (1, 7, START + 10.0, 0.0, 0), (2, 7, START + 20.0, 0.0, 2), (3, 7, START + 50_000.0, 0.0, 2)
    rows = [early, (4, 8, START + 50_000.0, 0.0, 1), late, still, (5, 9, START + 10.0**6, 0.0, 3)]
    got = replayed(frame(spark, rows), "slice", 4, lambda s: windowed(s, "user_id", "ts", "1 hour", "2 hours"))
    assert sorted((x.user_id, x.n) for x in got.collect()) == [(7, 1), (7, 1), (8, 1)]


def test_sessions_go_on_over_slices(spark):
    rows = events(3)
    end = [(10**6, -1, float(START + 10**7), 0.0, 3)]
    got = replayed(frame(spark, rows + end), "slice", 4, lambda s: sessions(s, "user_id", "ts", "600 seconds", "10 seconds")).where("user_id >= 0")
    want = []
    for user in {r[1] for r in rows}:
        times = sorted(r[2] for r in rows if r[1] == user)
        run = [times[0]]
        for t in times[1:] + [float("inf")]:
            if t - run[-1] >= 600:
                want.append((user, run[0], run[-1] + 600, len(run)))
                run = []
            run.append(t)
    assert sorted((x.user_id, x.start.timestamp(), x.end.timestamp(), x.n) for x in got.collect()) == sorted(want)


@pytest.mark.parametrize("width", [50.0, 1000.0, 1e6])
def test_asof_join(spark, width):
    """Ties, gaps of many buckets, keys on one side, nulls; a struct of the last row's columns."""
    r = random.Random(5)
    left = [(i, r.choice([1, 1, 1, 2, 3, None]), r.choice([None, *map(float, range(0, 3000, 37))])) for i in range(150)]
    right = [(i, r.choice([1, 1, 2, 4, None]), r.choice([None, *map(float, range(0, 3000, 111))]), r.choice([None, "x", "y"])) for i in range(60)]
    got = asof_join(spark.createDataFrame(left, "a long, k int, t double"), spark.createDataFrame(right, "b long, k int, t double, v string"), "k", "t", "b", width)
    found = {x.a: None if x.found is None else (x.found.b, x.found.v) for x in got.collect()}
    for a, k, t in left:
        fits = [(u, b, v) for b, k2, u, v in right if k is not None and t is not None and u is not None and k2 == k and u <= t]
        want = max(fits, key=lambda x: x[:2])[1:] if fits else None
        assert found[a] == want


@pytest.mark.parametrize("width", [7.0, 100.0])
def test_interval_join(spark, width):
    r = random.Random(6)
    left = [(i, r.choice([1, 1, 2, None]), float(s := r.randrange(500)), s + r.choice([-1.0, 0.0, 5.0, 60.0])) for i in range(80)]
    right = [(i, r.choice([1, 1, 2, 3]), r.choice([None, *map(float, range(500))])) for i in range(80)]
    got = interval_join(spark.createDataFrame(left, "a long, k int, f double, e double"), spark.createDataFrame(right, "b long, k int, t double"), "k", "f", "e", "t", width)
    want = sorted((a, b) for a, k, f, e in left for b, k2, t in right if k is not None and k == k2 and t is not None and f <= t <= e)
    assert sorted((x.a, x.b) for x in got.collect()) == want and want


def test_progress_counts_once_when_a_batch_runs_again(spark, tmp_path):
    """The newest state of a task wins whatever the order of arrival; other lines are ignored; a batch that is written twice changes nothing."""
    from gyre.streaming.progress import PROGRESS, compacted, current, event_text, progress_of, upsert
    from gyre.streaming.replay import replayed_into

    rows = [(i, i % 3, float(100 - i if i % 2 else i), f"stage {i}", i / 10, i // 4) for i in range(12)]
    frame = spark.createDataFrame(rows, "id long, task long, at double, stage string, percent double, slice int")
    lines = frame.select("slice", F.explode(F.split(event_text(), "\n")).alias("value")).unionByName(spark.createDataFrame([(1, "data: {broken"), (1, ": comment"), (2, 'data: {"other": 1}')], "slice int, value string"))
    path, seen = str(tmp_path / "p"), []

    def write(batch, number):
        upsert(path)(batch, number)
        upsert(path)(batch, number)
        seen.append(number)

    replayed_into(lines, "slice", 3, progress_of, write)
    want = {task: max((at, i, stage) for i, t, at, stage, _, _ in rows if t == task) for task in range(3)}
    assert {x.task: (x.at, x.id, x.stage) for x in current(spark, path, PROGRESS).collect()} == want
    assert seen == [0, 1, 2] and compacted(spark, path, str(tmp_path / "c"), PROGRESS).count() == 3


def test_two_limits():
    """A minute's bucket is full at its start and refills within it; what it denies takes nothing from the hour."""
    from gyre.streaming.keyed import TwoLimits

    machine = TwoLimits({0: (2, 4), 1: (1000, 4)})
    assert [machine.step(t, 0) for t in (0.0, 0.0, 0.0, 0.0)] == [True, True, True, False]
    assert [machine.step(30.0, 0), machine.step(30.0, 0)] == [True, False]
    # the hour had six, and has two left
    assert [machine.step(60.0, 1) for _ in range(4)] == [True, True, False, False]
    assert machine.step(3600.0, 1)


def test_contexts_are_compressed(spark):
    """Old turns give way to a summary of the last five points; few long turns stay; folds go on over batches."""
    from gyre.operators.dialogue import Context, context_sizes

    context = Context(100)
    for k in range(4):
        context.add(["user", "assistant"][k % 2], f"turn {k}. " + "x" * 90)
    assert (len(context.held), context.times) == (0, 1)
    assert context.summary == "User asked: turn 0. " + "x" * 90 + " | Assistant: turn 1 | User asked: turn 2. " + "x" * 90 + " | Assistant: turn 3"
    few = Context(100)
    for _ in range(3):
        few.add("user", "y" * 400)
    assert (len(few.held), few.times, few.tokens) == (3, 0, 300)
    rows = [(c, t, ["user", "assistant", "system", None][t % 4], None if t == 5 else "word. " * (t + 1)) for c in range(3) for t in range(12)] + [(None, 1, "user", "x"), (1, None, "user", "x")]
    got = {(x.conv_id, x.turn): tuple(x)[2:] for x in context_sizes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 40).collect()}
    assert len(got) == 36
    for c in range(3):
        context = Context(40)
        for _, t, role, text in (r for r in rows if r[0] == c and r[1] is not None):
            context.add(role or "", text or "")
            assert got[c, t] == (len(context.held), context.tokens, context.times, context.summary)


def test_timers_are_not_listed():
    """A key without state sets its timer and asks for none; a key with state deletes the one it knows of; the same time stays."""
    calls = []

    class Handle:
        def __getattr__(self, name):
            return lambda *x: calls.append((name, *x))

    processor = SlidingLogProcessor(3, 10.0, **COLUMNS)
    processor.handle = Handle()
    processor._end_at(5.0, None)
    processor._end_at(7.0, 5.0)
    processor._end_at(7.0, 7.0)
    assert calls == [("registerTimer", 5001), ("deleteTimer", 5001), ("registerTimer", 7001)]
