"""Columns of a caller's table beside those that an operator adds; names are compared without case, as Spark does."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def others(df: DataFrame, outputs: Iterable[str]) -> list[T.StructField]:
    """The fields of df that don't have the name of an output."""
    taken = {name.lower() for name in outputs}
    return [f for f in df.schema.fields if f.name.lower() not in taken]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col(quoted(name))


def packed(df: DataFrame, outputs: Iterable[str], **inputs: Column) -> tuple[DataFrame, list[T.StructField]]:
    """df as (row, inputs): its other columns in a struct, so that no name of an operator's own clashes with one of them; and their fields."""
    own = others(df, outputs)
    row = F.struct(*[col(f.name).alias(f.name) for f in own]) if own else F.struct(F.lit(None).alias("_"))
    return df.select(row.alias("row"), *[c.alias(name) for name, c in inputs.items()]), own


def unpacked(own: list[T.StructField]) -> list[Column]:
    """The columns that packed() put away."""
    return [F.col("row").getField(f.name).alias(f.name) for f in own]
