"""Results that one plan reads many times, written once.

They go to the folder in ``spark.checkpoint.dir``, which driver and executors share, so a lost executor
costs no recomputation of what was written; only where that is unset and driver and executors are one process is a
temporary folder made.  What was written goes when the process ends.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_written: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh place in the shared folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder there that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="lagwise-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        root = f"file://{_own[0]}"
    folder = f"{root.rstrip('/')}/lagwise-{uuid.uuid4().hex}"
    _written.append((spark, folder))
    return f"{folder}/{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def release() -> None:
    """Delete what this process wrote."""
    while _written:
        spark, folder = _written.pop()
        try:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session may be gone at exit; its owner then clears the folder
            return
