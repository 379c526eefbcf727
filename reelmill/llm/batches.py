"""Text columns of Arrow batches as byte buffers for numpy."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20


def text_slices(batches, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of rows with about ``limit`` bytes of text; a longer row comes alone.

    Memory then follows ``limit`` and the longest single text, not the size of Spark's batches. What the
    task before has freed is given back first.
    """
    give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(lengths(batch.column(column)))
        first = 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(first, last - first)
            first = last
    batch = None
    give_back()


def other_name(name: str, taken) -> str:
    """``name``, longer by underscores until no column in ``taken`` has it, in any case."""
    taken = {t.lower() for t in taken}
    while name.lower() in taken:
        name += "_"
    return name


def give_back() -> None:
    """Return freed memory to the system: workers live on, and executors are held to all that they hold."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each text; 0 for null."""
    return np.diff(buffer(column)[1])


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one array, and where each begins (one more entry: the end)."""
    if column.null_count:
        column = column.fill_null("")
    _, places, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if places is None or not n:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    starts = np.frombuffer(places, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    size = int(starts[-1] - starts[0])
    bytes_ = np.frombuffer(data, np.uint8, size, int(starts[0])) if size else np.zeros(0, np.uint8)
    return bytes_, starts - starts[0]


def texts(column: pa.Array) -> list[str]:
    """Python strings; null is empty."""
    return [t or "" for t in column.to_pylist()]


@contextmanager
def arrow_rows(spark, rows: int):
    """Jobs run inside get batches of at most ``rows`` rows, for rows that are large; then the setting is as before."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
