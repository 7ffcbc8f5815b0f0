"""Repair of the structure of conversations by a scan of min-plus matrices.

A conversation should have turns whose roles begin with the letters
`(s?(ua)+)?`. The states of that pattern are: nothing yet, after s, after u,
after a. Each turn is a 4x4 matrix: its element (i, j) is the cheapest way from
state i to state j over this turn, as (cost, audit), where audit has the
initials of the edits (Delete, Insert, Keep, Rerole); insertions before the turn
are closed into it. The product of matrices adds costs and joins audits, and
takes the least. Equal costs over the same turns have audits of which none
begins another, so that the order of audits is kept under joining and the
product is associative. Runs of turns are therefore reduced by trees wherever
they lie, and the runs of a long conversation by trees over runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gyre.session import materialize, ship

#: Turns of a run that one row stands for; runs that are joined at once.
RUN, FAN = 4096, 64
COSTS = {"K": 0, "I": 2, "R": 2, "D": 3}
TRUNCATED = 1
#: States that a conversation may end in.
FINAL = (0, 3)
#: From a state by a role's initial.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

#: (cost, audit) by 4 * from + to; None: no way.
Matrix = tuple


def least(x, y):
    return y if x is None else x if y is None else min(x, y)


def product(x: Matrix, y: Matrix) -> Matrix:
    out = [None] * 16
    for i in (0, 4, 8, 12):
        for k in range(4):
            a = x[i + k]
            if a is None:
                continue
            for j in range(4):
                b = y[4 * k + j]
                if b is None:
                    continue
                cost, old = a[0] + b[0], out[i + j]
                if old is None or cost <= old[0]:
                    way = (cost, a[1] + b[1])
                    if old is None or way < old:
                        out[i + j] = way
    return tuple(out)


def identity() -> Matrix:
    return tuple((0, "") if i % 5 == 0 else None for i in range(16))


@lru_cache
def insertions() -> Matrix:
    """Any number of inserted turns: the closure of one."""
    one = [None] * 16
    for (state, role), to in NEXT.items():
        if role != "s":
            one[4 * state + to] = (COSTS["I"], "I")
    out = step = identity()
    for _ in range(4):
        step = product(step, tuple(one))
        out = tuple(map(least, out, step))
    return out


@lru_cache
def turn_matrix(initial: str, faulty: bool, truncated: bool) -> Matrix:
    """The insertions before a turn, then its own edit. faulty: it must go."""
    own = [(COSTS["D"], "D") if i % 5 == 0 else None for i in range(16)]
    if not faulty:
        extra = TRUNCATED if truncated else 0
        for (state, role), to in NEXT.items():
            ways = [(COSTS["K"] + extra, "K")] if role == initial else []
            ways += [(COSTS["R"] + extra, "R")] if role != "s" else []
            for way in ways:
                own[4 * state + to] = least(own[4 * state + to], way)
    return product(insertions(), tuple(own))


def reduced(matrices: list[Matrix]) -> Matrix:
    """The product of all, in order, as a tree of pairs."""
    while len(matrices) > 1:
        matrices = [product(*matrices[i : i + 2]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
    return matrices[0] if matrices else identity()


def cheapest(whole: Matrix) -> tuple[int, str]:
    """The cheapest way of a whole conversation, insertions at its end included."""
    ended = product(whole, insertions())
    return min(ended[j] for j in FINAL if ended[j] is not None)


def replayed(audit: str) -> Iterator[tuple[int, int, str, str, int]]:
    """For each turn of a conversation, in order: (place, inserted, edit, role, after).

    place: turns that stand before in the result; inserted: turns put in right
    before this one; role: a rerolled turn's new one; after: turns put in after
    the last. The result ends with an assistant and alternates before, so that a
    role follows from the turns that are left.
    """
    left, place, inserted = len(audit) - audit.count("D"), 0, 0
    turns = len(audit) - audit.count("I")
    for edit in audit:
        if edit == "I":
            inserted += 1
            continue
        turns -= 1
        role = role_of(left - place - inserted)
        after = left - place - inserted - (edit != "D") if turns == 0 else 0
        yield place, inserted, edit, role, after
        place += inserted + (edit != "D")
        inserted = 0


def role_of(left: int) -> str:
    """The role of a turn that so many turns of the result are left from, itself included."""
    return "assistant" if left % 2 else "user"


class Repaired(NamedTuple):
    """conversations: a row for each id with its counts, cost and audit; rows: the repaired turns."""

    conversations: DataFrame
    rows: DataFrame


SPACE = "\t\n\x0b\x0c\r "


def _solid(text: str) -> Column:
    """A text without the white space at its end."""
    return F.rtrim(F.col(text), F.lit(SPACE))


def damaged(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) with faults by the checksum of `conv_id:turn` modulo 20: 0 drops a turn, 1 empties
    its text, 2 removes its `[.!?]`, 3 repeats it, 4 makes its role user. Nulls in names, roles and texts are one space."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), named("role").alias("role"), named("text").alias("text"), kind.alias("kind"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("_")).drop("_")


def _ordered(turns: DataFrame) -> DataFrame:
    """All turns with their number g in the order of conversations, (turn, nulls first, role, text) in each; written.

    The order is that of ranges of the whole table, so that a long conversation
    lies in many tasks. A turn's fault, but for duplicates, goes with it, and a
    digest of its role and text.
    """
    own = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role")]
    # the ranges' ends are sampled: the start of a text keeps them small
    ranged = turns.repartitionByRange(*own, F.substring("text", 1, 64)).sortWithinPartitions(*own, "text")
    last = F.substring(_solid("text"), -1, 1)
    rows = ranged.select(
        "conv_id", "turn", "role", "text", (_solid("text") == "").alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"),
        F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)).alias("digest"),
        F.spark_partition_id().alias("task"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place"),
    )
    rows = materialize(rows, "ordered")
    sizes = sorted(tuple(r) for r in rows.groupBy("task").count().collect())  # a row for each task
    before = [(task, sum(n for _, n in sizes[:i])) for i, (task, _) in enumerate(sizes)]
    starts = turns.sparkSession.createDataFrame(before, "task int, before long")
    return rows.join(F.broadcast(starts), "task").withColumn("g", F.col("before") + F.col("place")).drop("task", "before", "place")


_STATS = ("first_g", "n", "blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns")


def _schema(kind: T.DataType) -> T.StructType:
    long, text = T.LongType(), T.StringType()
    stats = [T.StructField(c, text if c in ("first", "last") else long) for c in _STATS]
    return T.StructType([T.StructField("conv_id", kind), T.StructField("run", long), *stats, T.StructField("costs", T.ArrayType(long)), T.StructField("audits", T.ArrayType(text))])


def _illegal(a: str, b: str) -> int:
    return a + b not in ("su", "ua", "au")


def _joined(x: dict, y: dict) -> dict:
    """The counts of two adjacent runs."""
    out = {c: x[c] + y[c] for c in ("n", "blank", "duplicate", "truncated", "illegal", "turns")}
    out["illegal"] += _illegal(x["last"], y["first"])
    out["turns"] -= x["high"] is not None and x["high"] == y["low"]
    return out | {"first_g": x["first_g"], "first": x["first"], "last": y["last"], "low": y["low"] if x["low"] is None else x["low"], "high": x["high"] if y["high"] is None else y["high"]}


def _row(conv_id, run: int, stats: dict, whole: Matrix) -> dict:
    return {"conv_id": conv_id, "run": run, **stats, "costs": [None if w is None else w[0] for w in whole], "audits": [None if w is None else w[1] for w in whole]}


def _folded(schema: pa.Schema):
    """Rows (g, conv_id, turn, initial, blank, duplicate, truncated), in the order of g in each run: a row for each conversation of a run."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, stats, own = None, None, []
        made = []
        for batch in batches:
            for g, conv, turn, initial, blank, duplicate, truncated in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if stats is None or key != (conv, g // RUN):
                    if stats is not None:
                        made.append(_row(*key, stats, reduced(own)))
                    key, stats, own = (conv, g // RUN), None, []
                blank_, duplicate_ = bool(blank), bool(duplicate and not blank)
                cut = bool(truncated and not blank and not duplicate)
                one = {"first_g": g, "n": 1, "blank": int(blank_), "duplicate": int(duplicate_), "truncated": int(cut), "illegal": 0, "first": initial, "last": initial, "low": turn, "high": turn, "turns": int(turn is not None)}
                stats = one if stats is None else _joined(stats, one)
                own.append(turn_matrix(initial if initial in ("s", "u", "a") else "", blank_ or duplicate_, cut))
            if len(made) >= 1000:
                yield pa.RecordBatch.from_pylist(made, schema)
                made = []
        if stats is not None:
            made.append(_row(*key, stats, reduced(own)))
        if made:
            yield pa.RecordBatch.from_pylist(made, schema)

    return fold


def _merged(schema: pa.Schema):
    def merge(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["run"])
        stats = {c: rows[0][c] for c in _STATS}
        for r in rows[1:]:
            stats = _joined(stats, r)
        whole = reduced([tuple(None if c is None else (c, a) for c, a in zip(r["costs"], r["audits"], strict=True)) for r in rows])
        return pa.Table.from_pylist([_row(rows[0]["conv_id"], rows[0]["part"], stats, whole)], schema)

    return merge


def _reduced_runs(runs: DataFrame, schema: pa.Schema) -> DataFrame:
    """A row for each conversation: its runs are joined FAN at a time, level by level; those of one run wait."""
    while True:
        ends = runs.groupBy(F.col("conv_id").alias("_id")).agg(F.min("run").alias("from"), F.count("*").alias("parts"))
        placed = runs.join(ends, F.col("conv_id").eqNullSafe(F.col("_id"))).drop("_id")
        many = materialize(placed.where("parts > 1").withColumn("part", F.floor((F.col("run") - F.col("from")) / FAN)).drop("from", "parts"), "many")
        if many.isEmpty():
            return runs
        joined = many.groupBy("conv_id", "part").applyInArrow(_merged(schema), runs.schema)
        runs = materialize(placed.where("parts = 1").select(*runs.columns).unionByName(joined), "runs")


def _solved():
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [cheapest(tuple(None if c is None else (c, a) for c, a in zip(costs, audits, strict=True))) for costs, audits in zip(batch.column("costs").to_pylist(), batch.column("audits").to_pylist(), strict=True)]
            own = [batch.column(c) for c in ("conv_id", *_STATS)]
            yield pa.RecordBatch.from_arrays([*own, pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], names=["conv_id", *_STATS, "cost", "audit"])

    return solve


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(first_g, audit) -> a row for each turn, in batches of bounded size, however long an audit is."""
    names = ["g", "place", "inserted", "edit", "new_role", "after", "left"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    held = []
    for batch in batches:
        for first, audit in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            left = len(audit) - audit.count("D")
            for r, edit in enumerate(replayed(audit)):
                held.append((first + r, *edit, left))
                if len(held) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                    held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


def repaired(turns: DataFrame, ids: DataFrame | None = None) -> Repaired:
    """The cheapest repair of each conversation of turns (conv_id, turn, role, text).

    Turns are taken by number (nulls first), ties by role and text. The first
    fault of a turn counts: blank (white space only), duplicate (role and text
    stand earlier), truncated (its last character that isn't white space is none
    of `.!?`). Edits: keep (0), rerole to user or assistant (2), delete (3,
    required for blank and duplicate turns), insert a user or assistant turn
    without text (2); a truncated turn that stays adds 1. Of the cheapest ways
    to roles whose initials give `(s?(ua)+)?`, that with the least audit is
    taken.

    conversations: conv_id, gaps (numbers missing between the least and the
    largest turn), blank, duplicate, truncated, illegal (neighbours whose
    initials aren't su, ua or au), cost, audit; also for each of ids (a table of
    conv_id) that has no turns, with zeros and an empty audit. rows: conv_id,
    place (from 0), role, text, edit (I, K or R).

    Null roles and texts are one space. Turns without a conversation id are one
    conversation without an id. Repeated rows are duplicates. Other columns are
    dropped. Empty tables give no rows. A conversation may have any number of
    turns: no task holds more than RUN of them, or FAN partial results.
    """
    spark = turns.sparkSession
    ship(spark)
    filled = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = _ordered(turns.select("conv_id", F.col("turn").cast("long").alias("turn"), filled("role"), filled("text")))
    light = rows.select("g", "conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "blank", "truncated")
    firsts = rows.where("not blank").groupBy("conv_id", "digest").agg(F.min("g").alias("g")).select("g", F.lit(True).alias("is_first"))
    light = light.join(firsts, "g", "left").select("g", "conv_id", "turn", "initial", "blank", F.col("is_first").isNull().alias("duplicate"), "truncated")
    schema = _schema(turns.schema["conv_id"].dataType)
    arrow = to_arrow_schema(schema)
    dealt = light.repartition(F.floor(F.col("g") / RUN)).sortWithinPartitions("g")
    runs = _reduced_runs(materialize(dealt.mapInArrow(_folded(arrow), schema), "runs"), arrow)
    solved = materialize(runs.mapInArrow(_solved(), T.StructType([f for f in schema.fields if f.name not in ("run", "costs", "audits")] + [T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())])), "solved")
    gaps = F.when(F.col("turns") > 0, F.col("high") - F.col("low") + 1 - F.col("turns")).otherwise(0)
    found = solved.select("conv_id", gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    if ids is not None:
        named = ids.select(F.col("conv_id").alias("_id")).distinct()
        zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        found = named.join(found, F.col("conv_id").eqNullSafe(F.col("_id")), "left").select(F.col("_id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"))
    edits = solved.select("first_g", "audit").mapInArrow(_edits, "g long, place long, inserted long, edit string, new_role string, after long, left long")
    both = rows.select("g", "conv_id", "role", "text").join(edits, "g")
    role = lambda at: F.when((F.col("left") - at) % 2 == 1, "assistant").otherwise("user")
    added = lambda start, n: F.transform(F.sequence(F.lit(1), n.cast("int")), lambda k: F.struct((start + k - 1).alias("place"), role(start + k - 1).alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit")))
    none = F.array().cast("array<struct<place:bigint,role:string,text:string,edit:string>>")
    own_place = F.col("place") + F.col("inserted")
    own = F.struct(own_place.alias("place"), F.when(F.col("edit") == "R", F.col("new_role")).otherwise(F.col("role")).alias("role"), F.col("text"), F.col("edit"))
    before = F.when(F.col("inserted") > 0, added(F.col("place"), F.col("inserted"))).otherwise(none)
    stays = F.when(F.col("edit") != "D", F.array(own)).otherwise(none)
    after = F.when(F.col("after") > 0, added(own_place + (F.col("edit") != "D").cast("int"), F.col("after"))).otherwise(none)
    lines = both.select("conv_id", F.explode(F.concat(before, stays, after)).alias("x")).select("conv_id", "x.*")
    return Repaired(found, lines)


def joined_hash(lines: DataFrame) -> DataFrame:
    """(conv_id, place, line) -> (conv_id, sha256): the digest of each conversation's lines, joined by newlines, in order.

    A digest is taken as the sorted lines pass, so that no conversation is held
    in memory; it is one after the other by its nature, so one task reads all
    lines of a conversation.
    """
    ship(lines.sparkSession)
    kind = lines.schema["conv_id"].dataType

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, state = [], None, None
        for batch in batches:
            for conv, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if state is None or conv != key:
                    if state is not None:
                        held.append({"conv_id": key, "sha256": state.hexdigest()})
                    key, state = conv, hashlib.sha256(line.encode())
                else:
                    state.update(b"\n" + line.encode())
            if len(held) > 10_000:
                yield pa.RecordBatch.from_pylist(held, out)
                held = []
        if state is not None:
            held.append({"conv_id": key, "sha256": state.hexdigest()})
        if held:
            yield pa.RecordBatch.from_pylist(held, out)

    schema = T.StructType([T.StructField("conv_id", kind), T.StructField("sha256", T.StringType())])
    out = to_arrow_schema(schema)
    return lines.select("conv_id", "place", "line").repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(digest, schema)
