"""Vectors as npy files in blocks of rows, with a table of which key is where: read by ranges of rows, or by key at an offset."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gyre.session import materialize, ship

#: Rows of a file at most, and bytes between two rows that are rather read over than left out.
BLOCK, GAP = 4096, 16 << 10
INDEX = "key long, file string, row int, start long, size int"


def _folder(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_vectors(rows: DataFrame, id_col: str, vec_col: str, path: str, half: bool = False, block: int = BLOCK) -> DataFrame:
    """Write rows with a vector to npy files under path; their index (key, file, row, start, size), a written table.

    start and size are a row's bytes in its file. Each task writes its rows in
    blocks, each to a file under a name of its own that is moved into place when
    it is whole; files that the index doesn't name are leftovers of lost tasks.
    Keys are integers; rows without a key or a vector are left out, as are null
    elements' rows. All vectors of a table have one length.
    """
    ship(rows.sparkSession)
    kind = np.dtype("<f2" if half else "<f4")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _folder(path)
        fs.create_dir(root, recursive=True)
        keys: list[np.ndarray] = []
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            own, m = np.concatenate(keys)[:block], np.concatenate(held)[:block]
            rest = np.concatenate(keys)[block:], np.concatenate(held)[block:]
            keys[:], held[:] = [rest[0]], [rest[1]]
            out = io.BytesIO()
            np.lib.format.write_array_header_1_0(out, {"descr": kind.str, "fortran_order": False, "shape": m.shape})
            head, name = out.tell(), f"{uuid.uuid4().hex}.npy"
            with fs.open_output_stream(f"{root}/.{name}", compression=None) as sink:
                sink.write(out.getvalue())
                sink.write(m.tobytes())
            fs.move(f"{root}/.{name}", f"{root}/{name}")
            size = m.shape[1] * kind.itemsize
            at = np.arange(len(own))
            return pa.RecordBatch.from_arrays([pa.array(own), pa.array([name] * len(own)), pa.array(at.astype(np.int32)), pa.array(head + at * size), pa.array(np.full(len(own), size, np.int32))], names=["key", "file", "row", "start", "size"])

        for batch in batches:
            if batch.num_rows:
                keys.append(batch.column(0).to_numpy())
                held.append(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(kind))
            while sum(map(len, keys)) >= block:
                yield flush()
        if sum(map(len, keys)):
            yield flush()

    v = F.col(vec_col)
    good = rows.where(F.col(id_col).isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull()))
    return materialize(good.select(F.col(id_col).cast("long").alias("key"), F.transform(v, lambda x: x.cast("float")).alias("v")).mapInArrow(write, INDEX), "vector-index")


def merged(starts: Sequence[int], sizes: Sequence[int], gap: int = GAP) -> list[tuple[int, int]]:
    """(start, end) of the reads that cover sorted byte ranges; those nearer than gap are one."""
    out: list[tuple[int, int]] = []
    for start, size in zip(starts, sizes, strict=True):
        if out and start - out[-1][1] <= gap:
            out[-1] = (out[-1][0], max(out[-1][1], start + size))
        else:
            out.append((start, start + size))
    return out


def get_vectors(keys: DataFrame, index: DataFrame, path: str, half: bool = False, gap: int = GAP) -> DataFrame:
    """(key, vector, read) for the keys (key) that the index has; read: the bytes that were read for it and those it shares a read with, at the first of them.

    Keys meet the index in a join; each file's rows are then read in their order,
    only where they are. Repeated keys give one row.
    """
    ship(keys.sparkSession)
    kind = np.dtype("<f2" if half else "<f4")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _folder(path)
        for batch in batches:
            files = batch.column("file").to_numpy(zero_copy_only=False)
            key, start, size = (batch.column(c).to_numpy() for c in ("key", "start", "size"))
            vectors, cost = [None] * len(files), np.zeros(len(files), np.int64)
            for name in dict.fromkeys(files.tolist()):
                at = np.flatnonzero(files == name)
                at = at[np.argsort(start[at], kind="stable")]
                with fs.open_input_file(f"{root}/{name}") as source:
                    k = 0
                    for lo, hi in merged(start[at].tolist(), size[at].tolist(), gap):
                        data = source.read_at(hi - lo, lo)
                        cost[at[k]] = hi - lo
                        while k < len(at) and start[at[k]] < hi:
                            i = at[k]
                            vectors[i] = np.frombuffer(data, kind, size[i] // kind.itemsize, start[i] - lo).astype(np.float32)
                            k += 1
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(vectors, pa.list_(pa.float32())), pa.array(cost)], names=["key", "vector", "read"])

    found = keys.select(F.col("key").cast("long").alias("key")).distinct().join(index, "key")
    dealt = found.select("key", "file", "start", "size").repartition("file").sortWithinPartitions("file", "start")
    return dealt.mapInArrow(read, "key long, vector array<float>, read long")


class _Range(InputPartition):
    def __init__(self, file: str, first: int, last: int):
        self.file, self.first, self.last = file, first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.rows = options["path"], int(options.get("rows", BLOCK))

    def partitions(self) -> list[InputPartition]:
        """Ranges of rows of each file; only headers are read here."""
        fs, root = _folder(self.path)
        out: list[InputPartition] = []
        for info in fs.get_file_info(pafs.FileSelector(root)):
            if info.base_name.endswith(".npy") and not info.base_name.startswith("."):
                with fs.open_input_file(info.path) as source:
                    n = _header(source)[0][0]
                out += [_Range(info.base_name, lo, min(n, lo + self.rows)) for lo in range(0, n, self.rows)]
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        fs, root = _folder(self.path)
        with fs.open_input_file(f"{root}/{partition.file}") as source:
            (_, width), kind, head = _header(source)
            size = width * kind.itemsize
            data = source.read_at((partition.last - partition.first) * size, head + partition.first * size)
        m = np.frombuffer(data, kind).reshape(-1, width).astype(np.float32)
        n = len(m)
        yield pa.RecordBatch.from_arrays([pa.array([partition.file] * n), pa.array(np.arange(partition.first, partition.last, dtype=np.int32)), pa.array(list(m), pa.list_(pa.float32()))], names=["file", "row", "vector"])


def _header(source) -> tuple[tuple[int, int], np.dtype, int]:
    """Shape, type and length of a npy file's header."""
    start = io.BytesIO(source.read_at(512, 0))
    np.lib.format.read_magic(start)
    shape, _, kind = np.lib.format.read_array_header_1_0(start)
    return shape, kind, start.tell()


class VectorFiles(DataSource):
    """spark.read.format("vector_files").option("rows", n).load(path): (file, row, vector), a partition for each n rows of a file."""

    @classmethod
    def name(cls) -> str:
        return "vector_files"

    def schema(self) -> str:
        return "file string, row int, vector array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_vectors(spark: SparkSession, path: str, rows: int = BLOCK) -> DataFrame:
    ship(spark)
    spark.dataSource.register(VectorFiles)
    return spark.read.format("vector_files").option("rows", str(rows)).load(path)
