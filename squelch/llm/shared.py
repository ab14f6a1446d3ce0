"""Shared folder, stored intermediate tables and Arrow batch helpers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: A word, by the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where none is named, a temporary one is set on a single machine; on a
    cluster that is an error, as executors couldn't read each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="squelch-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Writes a frame as Parquet in the shared folder and reads it back.

    This cuts the lineage with a replicated copy: losing executors later costs
    no recomputation of what came before. The folder's owner clears it.
    """
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


_forget: list[Callable[[], None]] = []
_owner: list[str] = []


def forgettable(clear: Callable[[], None]) -> None:
    """Registers what empties a memory that a worker keeps from task to task."""
    _forget.append(clear)


def owned(operator: str) -> None:
    """Says which operator a task is of; the memories that another one has left in this worker go.

    Spark runs tasks of many jobs in one worker, one after another, so what each
    operator keeps for its next task would add up.
    """
    if _owner and _owner[0] != operator:
        for clear in _forget:
            clear()
        trimmed()
    _owner[:] = [operator]


def trimmed() -> None:
    """Gives the memory that a worker has freed back to the machine; Arrow and glibc keep it otherwise while the worker waits."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = 2_000_000, rows: int = 30_000) -> Iterator[pa.RecordBatch]:
    """Slices a batch so that each slice holds about ``limit`` bytes of text and at most so many rows.

    Whole rows only, so a longer text makes a larger slice of one row.
    """
    _, offsets = text_buffer(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), start + rows, batch.num_rows)
        yield batch.slice(start, end - start)
        start = end
