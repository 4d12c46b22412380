"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one numpy pass works on; bounds a Python worker's memory.
CHUNK_BYTES = 1 << 20
#: Bytes of an Arrow batch that goes to a Python worker. Spark's default lets texts make batches of 64 MB, of which a task
#: holds several on either side; a session that has another value keeps it.
BATCH_BYTES = 4 << 20
_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; a temporary one only in local mode without a setting.

    As every operator comes through here, this also bounds the session's Arrow batches.
    """
    sc = spark.sparkContext
    if spark.conf.get(_BATCH) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        current = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside remove their shuffle files as soon as they have ended."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back, so that lost executors lose nothing.

    The shuffles that led to the table are removed as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that `cut` wrote and nothing will read again."""
    for table in tables:
        remove(table.sparkSession, table.written_to)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of this library in the shared file system."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def release_memory() -> None:
    """Give back to the system what a task has freed, as its Python worker lives on beside those of later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about `limit` bytes of text, one row at least."""
    try:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            _, offs = text_bytes(batch.column(batch.schema.get_field_index(text)))
            at = 0
            while at < batch.num_rows:
                to = int(np.searchsorted(offs, offs[at] + limit, "right")) - 1
                to = min(max(to, at + 1), batch.num_rows)
                yield batch.slice(at, to - at)
                at = to
    finally:
        release_memory()


def ragged_take(flat: np.ndarray, offs: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate flat[offs[r]:offs[r+1]] for r in rows; returns the values and their offsets."""
    lens = offs[rows + 1] - offs[rows]
    out = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(lens, out=out[1:])
    at = np.repeat(offs[rows] - out[:-1], lens) + np.arange(out[-1])
    return flat[at], out

