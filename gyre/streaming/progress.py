"""Progress events: lines of an event stream, and a table of the newest state of each task that is updated by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a line of progress holds.
PROGRESS = "task long, id long, at double, stage string, percent double"


def event_text() -> Column:
    """A row of progress in the layout of server-sent events: three lines and an empty one."""
    data = F.to_json(F.struct("task", "id", "at", "stage", "percent"))
    return F.concat(F.lit("event: progress\nid: "), F.col("id").cast("string"), F.lit("\ndata: "), data, F.lit("\n"))


def progress_of(lines: DataFrame) -> DataFrame:
    """The columns of PROGRESS from lines (value) of an event stream; lines other than data, and data that is no progress, are left out."""
    data = F.from_json(F.substring_index(F.col("value"), "data: ", -1), PROGRESS)
    return lines.where(F.col("value").startswith("data: ")).select(data.alias("d")).where("d.task IS NOT NULL AND d.id IS NOT NULL").select("d.*")


def upsert(path: str, key: str = "task", order: tuple[str, ...] = ("at", "id")):
    """For foreachBatch: the newest row of each key in a batch goes to a folder of the batch's own number.

    A batch that runs again, after a failure or a restart, overwrites what it
    wrote, so that each counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        best = batch.groupBy(key).agg(F.max_by(F.struct(*[c for c in batch.columns if c != key]), F.struct(*order)).alias("x"))
        best.select(key, "x.*").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def current(spark: SparkSession, path: str, schema, key: str = "task", order: tuple[str, ...] = ("at", "id")) -> DataFrame:
    """The newest row of each key over all batches."""
    rows = spark.read.schema(schema).option("basePath", path).parquet(path).drop("batch")
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(*order)).alias("x")).select(key, "x.*")


def compacted(spark: SparkSession, path: str, to: str, schema, **names) -> DataFrame:
    """The current state as a table of its own, with a row for each key, so that reading it doesn't grow with the batches."""
    current(spark, path, schema, **names).write.mode("overwrite").parquet(to)
    return spark.read.parquet(to)
