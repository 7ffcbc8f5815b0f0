"""Session settings, shipping of the code, shared scratch tables."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()
#: Scratch tables by application, in the order of their making.
_scratch: dict[str, list[str]] = {}


def build(cores: str = "*", app: str = "gyre", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench share."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    return SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=settings).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers of this application and bound its Arrow batches, once."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    # whole texts travel to Python: small batches bound the memory of both sides
    for name, value in {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}.items():
        spark.conf.set(name, value)
    root = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="gyre-ship-"))
    atexit.register(shutil.rmtree, to, ignore_errors=True)
    with zipfile.ZipFile(to / "gyre_code.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(str(to / "gyre_code.zip"))


def trim() -> None:
    """In a Python worker at the end of a task: give memory back that it no longer uses, as workers outlive tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or under a local master a temporary one, else the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.startswith("local["):
            found = "file://" + tempfile.mkdtemp(prefix="gyre-shared-")
            atexit.register(shutil.rmtree, found[7:], ignore_errors=True)
        else:
            found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_gyre_scratch"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """df, written as Parquet to the shared folder and read back: cuts lineage, and lost executors cost no rerun of it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    _scratch.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, plan: Callable[[], DataFrame], name: str) -> DataFrame:
    """What plan gives, written and read back; the scratch tables that were made for it are deleted then."""
    own = _scratch.setdefault(spark.sparkContext.applicationId, [])
    before = len(own)
    out = materialize(plan(), name)
    made, own[before:] = own[before:-1], own[-1:]
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in made:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    return out


def sized(small: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """small (of narrow rows), hinted for a broadcast only if it has at most most_rows rows; beyond that the join shuffles.

    small must be cheap to count: a materialized or a base table.
    """
    return F.broadcast(small) if small.limit(most_rows + 1).count() <= most_rows else small


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores: for work that costs more than moving the rows of a small input. A larger one stays as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df._jdf.queryExecution().toRdd().getNumPartitions() < n else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
