"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows in an Arrow batch of whole texts: a batch stays small where texts are long.
TEXT_ROWS = 1000


def two_columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) under fixed names: other columns, whatever their names, can't clash. Null text is empty."""
    return df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n."""
    return F.crc32(id_col.cast("string")) % n


def map_arrow(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """mapInArrow by a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, TEXT_ROWS):
                out = each(part)
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def sliced(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts in one column have about `limit` bytes, one row at least."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def merged(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches put together until one column has `limit` bytes, so that few hold little."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= limit:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


#: Rows and bytes of a batch that Spark sends to Python.
BATCH_ROWS, BATCH_BYTES = 2 * TEXT_ROWS, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Batches sent to Python hold whole texts, so few rows and bytes each, unless the session asks for fewer still.

    Spark reads these settings when a plan runs, which may be after an operator has returned, so they stay set.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key, "2147483646").rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


_SLOT: dict[Hashable, Any] = {}


def worker_slot(key: Hashable, make: Callable[[], Any]) -> Any:
    """What this Python worker keeps between batches and tasks: one thing at a time, so that another operator's goes first.

    Workers outlive the stage that started them; without this each would hold the caches of all operators so far.
    """
    if key not in _SLOT:
        _SLOT.clear()
        give_back()
        _SLOT[key] = make()
    return _SLOT[key]


def give_back() -> None:
    """Return free memory of this process to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


#: Rows of ids that may be broadcast: some megabytes.
BROADCAST_ROWS = 500_000


def if_small(ids: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint for a stored table of ids of checked size; beyond it Spark joins by a shuffle."""
    return F.broadcast(ids) if ids.count() <= rows else ids
