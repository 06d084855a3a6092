"""What the text operators share: scratch tables, Arrow columns, byte tables.

Scratch tables cut lineage.  They go to the folder in ``spark.checkpoint.dir``,
which driver and executors share; only where that is unset and driver and executors
are one process (tests, a laptop) is a temporary folder made and set.  Operators drop
the tables that nothing reads any more.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None
_written: list[tuple[SparkSession, str]] = []

#: The white space of every word pattern here: space and 0x09-0x0D.
SPACE = b" \t\n\x0b\x0c\r"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Lower-cases A-Z and turns every other ASCII character that is no letter or digit into a space.
ALNUM_LOWER = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)


def scratch_root(spark: SparkSession) -> str:
    global _own_dir
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is unset: name a folder there that the driver and all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="lagwise-")
        spark.sparkContext.setCheckpointDir(_own_dir)
    return _own_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/lagwise-{uuid.uuid4().hex}/{name}"
    _written.append((spark, path.rpartition("/")[0]))
    return path


#: Rows that a task writes at least, where their number is known: on a local file system each file costs three processes or more.
FILE_ROWS = 1 << 18


def materialize(df: DataFrame, name: str, partition_by: str | None = None, rows: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back; of at most ``rows`` rows in no more tasks than these need."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    path = scratch_path(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def sweep(spark: SparkSession) -> None:
    """Let Spark clear the shuffles that no plan holds any more: files go when their plans are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop(*tables: DataFrame, sweeps: bool = True) -> None:
    """Delete tables of ``materialize`` that nothing reads any more; a sweep lets Spark clear the shuffles that led to them."""
    for table in tables:
        folder = table.scratch.rpartition("/")[0]
        _delete(table.sparkSession, folder)
        _written[:] = [x for x in _written if x[1] != folder]
    if sweeps:
        sweep(tables[0].sparkSession)


def drop_part(table: DataFrame, column: str, value: str) -> None:
    """Delete the rows with this value of the column that a table of ``materialize`` is written by."""
    _delete(table.sparkSession, f"{table.scratch}/{column}={value}")
    sweep(table.sparkSession)


@atexit.register
def release() -> None:
    """Delete the scratch tables of this process; results not yet written are lost with them."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone at exit; its owner then clears the folder
            return


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within, tables are written with so many rows in an Arrow batch: rows that may be wide then don't meet by the ten thousand."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``docs`` has."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def named(columns: Iterable[str]) -> list[Column]:
    """Columns by their names, whatever characters these hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


_dropped: dict[str, Callable[[], None]] = {}
_holder: list[str] = []


def cached(name: str, drop: Callable[[], None]) -> None:
    """Name what empties an operator's cache in this worker."""
    _dropped[name] = drop


def claim(name: str = "") -> None:
    """To be called where a task begins: workers outlive their tasks, so what other operators hold is dropped and given back."""
    if _holder == [name]:
        return
    _holder[:] = [name]
    for other, drop in _dropped.items():
        if other != name:
            drop()
    give_back()


def give_back() -> None:
    """Memory that nothing holds goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of one C library only
    if trim is not None:
        trim(0)


def blobs(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def slices(batch: pa.RecordBatch, column: int, rows: int = 1000, size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most so many rows, and so many bytes in a column but for the last row."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(total[at - 1]) if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(total, before + size, "right"))))
        yield batch.slice(at, to - at)
        at = to


def mix64(z: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, element by element."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def arrow_fs(uri: str):
    """(file system, path) of a URI for Python code on executors: local, HDFS, S3 and so on."""
    from pyarrow import fs

    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri.replace("s3a://", "s3://", 1))
