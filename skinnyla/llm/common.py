"""What the corpus operators share: Arrow helpers, and the session's tables and shared folder."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from skinnyla import session
from skinnyla.session import cut, new_path, shared_dir

__all__ = ["batches", "cut", "forget", "new_path", "per_worker", "release", "shared_dir", "small_batches", "table", "texts_of", "tokenizer_path", "unused", "utf8_buffer"]


_kept: list = []  # name, key and object of per_worker()
_asked = False  # whether what is kept belongs to the function that runs now


def per_worker(name: str, key: object, make: Callable[[], object]) -> object:
    """make() once for each Python worker; a worker keeps only the latest, and only until a function without it reads its batches, as workers outlive a query."""
    global _asked
    if not _kept or _kept[0][:2] != (name, key):
        forget()  # the old one goes before the new one is made
        _kept.append((name, key, make()))
    _asked = True
    return _kept[0][2]


def forget() -> None:
    """Gives back what per_worker() has kept."""
    if _kept:
        _kept.clear()
        release()


def texts_of(column: pa.Array) -> list[str]:
    """Python strings; null becomes the empty text."""
    return [x or "" for x in column.to_pylist()]


def utf8_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the rows' offsets in them; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return (data[offsets[0] : offsets[-1]], offsets - offsets[0]) if len(offsets) else (data[:0], np.zeros(1, np.int64))


def unused(columns: list[str]) -> str:
    """A prefix that no column's name has, for columns of the operators' own beside those of a table."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> SparkSession:
    """Arrow batches of 4 MB unless the session was started with another size.

    Spark's 64 MB a batch are copied several times in the executor's direct memory and in Python.
    """
    if not spark.sparkContext.getConf().contains(BATCH_BYTES):
        spark.conf.set(BATCH_BYTES, "4m")
    return session.reachable(spark)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return session.table(small_batches(spark), folder, name)


def batches(rows: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about most bytes, so that what is made of them stays small."""
    global _asked
    if not _asked:
        forget()
    _asked = False
    for b in rows:
        step = max(1, b.num_rows // max(1, b.nbytes // most))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)
    release()


def release() -> None:
    """Gives freed memory back, as workers stay for the tasks of other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
