"""Where operators put what must outlive a stage: the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import mmap
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_made: list[str] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. Only a local session without a setting gets a temporary folder instead."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set; operators need a folder that all executors share")
        base = _local.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp())
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the folders that operators have made within it; what is to last must be written elsewhere by then."""
    start = len(_made)
    try:
        yield
    finally:
        for path in _made[start:]:
            removed(spark, path)
        del _made[start:]


def removed(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame, computed once and read back from the shared folder; lineage ends here."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of long texts must fit a Python worker; a setting that the user has changed stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "512")


def trimmed(batches: Iterator) -> Iterator:
    """The batches of a Python task; afterwards the worker, which waits for further tasks, gives free memory back."""
    try:
        yield from batches
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def put_stream(uri: str):
    """A new file in the shared folder, opened for writing by an executor; the name must be new, so that a repeated task can't damage an older file."""
    files, path = _filesystem(uri)
    files.create_dir(os.path.dirname(path), recursive=True)
    return files.open_output_stream(path, compression=None)


def put_array(uri: str, array: np.ndarray) -> None:
    """Write an array's bytes as a new file."""
    with put_stream(uri) as out:
        out.write(np.ascontiguousarray(array).tobytes())


def map_array(uri: str, dtype: str) -> np.ndarray:
    """The array, memory-mapped: in place if the shared folder is mounted here, else from an unlinked local copy."""
    files, path = _filesystem(uri)
    if files.type_name == "local":
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    with tempfile.TemporaryFile() as copy, files.open_input_stream(path) as data:
        while block := data.read(1 << 24):
            copy.write(block)
        copy.flush()
        if not copy.tell():
            return np.zeros(0, dtype)
        return np.frombuffer(mmap.mmap(copy.fileno(), 0, access=mmap.ACCESS_READ), dtype)
