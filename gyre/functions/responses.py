"""Objects out of responses that have text around them or are broken."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_object(text: Column) -> Column:
    """The first whole JSON object in a text: from its first brace to the one that closes it; null if none does.

    Braces within strings don't count, nor do quotes behind a backslash. The
    text is folded once, over the characters that matter: a brace, a quote, or
    a backslash with what it escapes.
    """
    start = F.instr(text, "{")
    rest = F.substring(text, start, F.length(text))
    # the text as pieces that end with what matters: depth and length are summed over these
    pieces = F.regexp_extract_all(rest, F.lit(r'(?s)[^{}"\\]*(?:[{}"]|\\.|\\$)'), F.lit(0))
    zero = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s: Column, piece: Column) -> Column:
        mark = F.right(piece, F.lit(1))
        # an escaped character is no mark
        plain = ~piece.rlike(r"(?s)\\.$") & ~piece.endswith("\\")
        at = s["at"] + F.length(piece)
        quoted = F.when(plain & (mark == '"'), ~s["quoted"]).otherwise(s["quoted"])
        depth = F.when(plain & ~s["quoted"] & (mark == "{"), s["depth"] + 1).when(plain & ~s["quoted"] & (mark == "}"), s["depth"] - 1).otherwise(s["depth"])
        return F.when(s["end"] > 0, s).otherwise(F.struct(depth.alias("depth"), quoted.alias("quoted"), at.alias("at"), F.when((depth == 0) & (s["depth"] == 1), at).otherwise(0).alias("end")))

    end = F.aggregate(pieces, zero, step)["end"]
    return F.when((start > 0) & (end > 0), F.substring(rest, F.lit(1), end))
