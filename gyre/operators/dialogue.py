"""The context of a conversation that is kept within a number of tokens: older turns give way to a summary."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyre.session import ship

#: Shares of the tokens at which a context is compressed, and that recent turns keep.
FULL, RECENT = 0.9, 0.2
#: Points of a summary, the last ones, and characters of a long turn in one.
POINTS, LONG = 5, 100


def point(role: str, text: str) -> str | None:
    """What a summary says of a turn: the start of a question, the first sentence of an answer; nothing of other roles."""
    text = text.strip()
    if role == "user":
        return f"User asked: {text[:LONG]}..." if len(text) > LONG else f"User asked: {text}"
    if role == "assistant":
        return "Assistant: " + (text[: text.index(".")] if "." in text else text[:LONG])
    return None


class Context:
    """Turns that are held, as (tokens, point), and the tokens of all of them and of the summary."""

    def __init__(self, most: int):
        self.most, self.tokens, self.times, self.summary = most, 0, 0, ""
        self.held: deque[tuple[int, str | None]] = deque()

    def add(self, role: str, text: str) -> None:
        self.held.append((len(text) // 4, point(role, text)))
        self.tokens += len(text) // 4
        if self.tokens > self.most * FULL and len(self.held) >= 4:
            self._compress()

    def _compress(self) -> None:
        recent, kept = 0, 0
        for n, _ in reversed(self.held):
            if kept + n > int(self.most * RECENT):
                break
            recent, kept = recent + 1, kept + n
        older = len(self.held) - recent
        if older < 2:
            return
        points = [p for _, p in (self.held.popleft() for _ in range(older)) if p is not None]
        self.summary = " | ".join(points[-POINTS:])
        self.tokens, self.times = kept + len(self.summary) // 4, self.times + 1


def context_sizes(turns: DataFrame, most: int) -> DataFrame:
    """(conv_id, turn, held, tokens, compressed, summary) after each turn (conv_id, turn, role, text), in their order; ties by role and text.

    A conversation is folded by one task, in batches of bounded size; its state
    is bounded by most, as a full context is compressed. Nulls are empty.
    """
    ship(turns.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, context = object(), None
        for frame in frames:
            out = []
            for conv, turn, role, text in frame.itertuples(index=False):
                if conv != current:
                    current, context = conv, Context(most)
                context.add(role, text)
                out.append((conv, turn, len(context.held), context.tokens, context.times, context.summary))
            yield pd.DataFrame(out, columns=["conv_id", "turn", "held", "tokens", "compressed", "summary"])

    filled = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = turns.where("conv_id IS NOT NULL AND turn IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), filled("role"), filled("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInPandas(run, "conv_id long, turn long, held int, tokens long, compressed int, summary string")
