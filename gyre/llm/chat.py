"""Preference pairs: the turns that two conversations share, once, and what each adds, with masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyre.llm.columns import col, packed, unpacked

# The markers of the public ChatML layout.
START, END = "<|im_start|>", "<|im_end|>"


def conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row (conv_id, turns) for each conversation, its turns in order; ties by role and text.

    Rows without a conversation id belong to none. Null roles and texts are
    empty; a null turn number comes first.
    """
    turn = F.struct(F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    own = F.col(f"`{conv_col}`")
    sort = F.sort_array(F.collect_list(turn))
    plain = F.transform(sort, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return turns.where(own.isNotNull()).groupBy(own.alias("conv_id")).agg(plain.alias("turns"))


def _header(t: Column) -> Column:
    return F.concat(F.lit(START), t["role"], F.lit("\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), t["text"], F.lit(END + "\n"))), "")


def trained_spans(turns: Column, role: str = "assistant") -> Column:
    """Spans (start, end) of code points in the rendered turns that count for the loss: a role's text with its end marker."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(_header(t))
        end = start + F.length(t["text"]) + F.lit(len(END))
        span = F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end")))
        return F.struct((end + 1).cast("int").alias("at"), F.when(t["role"] == role, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, zero, step, lambda acc: acc["spans"])


def shared_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(differs > 0, differs.cast("int") - 1).otherwise(F.size(a))


def other_answers(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", role: str = "assistant") -> DataFrame:
    """(donor, conv_id, turn, role, text): for each conversation a variant that ends with the last answer of another one.

    A variant has the turns before the conversation's last turn of a role, then
    the last such turn of its neighbour: the conversation with the next integer
    id, or else that before. Its id is -1 - conv_id. Of answers with one turn
    number the last by text counts. Conversations without an answer or without a
    neighbour that has one have no variant, nor have rows without an id.
    """
    own = turns.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), F.col(f"`{role_col}`").alias("role"), F.col(f"`{text_col}`").alias("text"))
    last = own.where((F.col("role") == role) & F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("a"))
    # each answer goes to the conversation before (first choice) and to that after
    offers = last.select(F.explode(F.array(*[F.struct((F.col("conv_id") + d).alias("conv_id"), F.lit(d).alias("d")) for d in (-1, 1)])).alias("to"), F.col("conv_id").alias("donor"), F.col("a.text").alias("text"))
    chosen = offers.groupBy("to.conv_id").agg(F.min_by(F.struct("donor", "text"), F.col("to.d")).alias("o"))
    ends = last.join(chosen, "conv_id").select("conv_id", F.col("a.turn").alias("at"), "o.donor", F.col("o.text").alias("answer"))
    before = own.join(ends.select("conv_id", "at", "donor"), "conv_id").where("turn is null or turn < at").select("donor", (-1 - F.col("conv_id")).alias("conv_id"), "turn", "role", "text")
    return before.unionByName(ends.select("donor", (-1 - F.col("conv_id")).alias("conv_id"), F.col("at").alias("turn"), F.lit(role).alias("role"), F.col("answer").alias("text")))


def preference_pairs(turns: DataFrame, pairs: DataFrame, **columns: str) -> DataFrame:
    """For each row (chosen_id, rejected_id) of pairs: n_shared turns, the prompt
    (these turns rendered once), chosen and rejected (the other turns of each,
    rendered), and chosen_spans and rejected_spans, the spans of a completion
    that are not masked.

    Pairs of which a conversation doesn't exist give no row; equal pairs count
    once; a conversation paired with itself is all prompt; an empty table gives
    no rows. Columns of pairs other than the ids are kept, but for those with
    the outputs' names (without case). A conversation is a row, however long.
    """
    outputs = ("chosen_id", "rejected_id", "n_shared", "prompt", "chosen", "rejected", "chosen_spans", "rejected_spans")
    whole = conversations(turns, **columns)
    rows, own = packed(pairs, outputs, chosen_id=col("chosen_id"), rejected_id=col("rejected_id"))
    a = whole.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("a"))
    b = whole.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("b"))
    both = rows.distinct().join(a, "chosen_id").join(b, "rejected_id").withColumn("n_shared", shared_turns(F.col("a"), F.col("b")))
    rest = lambda c: F.slice(F.col(c), F.col("n_shared") + 1, F.size(c))
    both = both.select("row", "chosen_id", "rejected_id", "n_shared", F.slice("a", F.lit(1), F.col("n_shared")).alias("p"), rest("a").alias("a"), rest("b").alias("b"))
    made = {"prompt": rendered(F.col("p")), "chosen": rendered(F.col("a")), "rejected": rendered(F.col("b")), "chosen_spans": trained_spans(F.col("a")), "rejected_spans": trained_spans(F.col("b"))}
    return both.select(*unpacked(own), "chosen_id", "rejected_id", "n_shared", *[c.alias(n) for n, c in made.items()])


def span_text(spans: Column) -> Column:
    """Spans as text, for instance `13:40 55:61`."""
    return F.array_join(F.transform(spans, lambda s: F.concat(s["start"], F.lit(":"), s["end"])), " ")
