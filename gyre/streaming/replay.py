"""A table as a stream: its rows arrive in slices, and the streaming query is stopped and started again from its checkpoint between them."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyre.session import fresh_path, ship

#: State goes to RocksDB: transformWithState needs it, and it isn't held in the heap.
_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with these settings, which it loses again afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def replayed_into(lines: DataFrame, slice_col: str, n: int, transform: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, int], None]) -> None:
    """As replayed, for text lines (value) that arrive in slices, with the batches given to write (batch, number)."""
    spark = lines.sparkSession
    ship(spark)
    source, checkpoint = (fresh_path(spark, name) for name in ("lines", "stream-state"))
    for k in range(n):
        lines.where(F.col(slice_col) == k).select("value").write.mode("append").text(source)
        run = transform(spark.readStream.text(source)).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        run.awaitTermination()


def replayed(rows: DataFrame, slice_col: str, n: int, transform: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """What transform gives for a stream of rows, of which those with slice 0 arrive first, then 1, to n - 1.

    Each slice is written to the folder that the stream watches; then the query
    runs until it has read all there is, with timers and windows that are due,
    and stops. The next slice starts it again from its checkpoint. Rows of other
    slices don't arrive. Input, checkpoint and output are in the shared folder.
    """
    spark = rows.sparkSession
    ship(spark)
    source, sink, checkpoint = (fresh_path(spark, name) for name in ("arrived", "emitted", "stream-state"))
    schema = rows.drop(slice_col).schema
    with settings(spark, _STORE):
        for k in range(n):
            rows.where(F.col(slice_col) == k).drop(slice_col).write.mode("append").parquet(source)
            out = transform(spark.readStream.schema(schema).parquet(source))
            run = out.writeStream.outputMode(mode).format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
            run.awaitTermination()
    return spark.read.schema(out.schema).parquet(sink)
