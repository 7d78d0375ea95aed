"""Helpers shared by the operators of this subpackage: text buffers for vectorised work on
Arrow batches, and 64-bit mixing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

U64 = np.uint64
#: Odd multipliers of the 64-bit finaliser (public "splitmix64" constants).
MIX_1, MIX_2, GOLDEN = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)


def bounded_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Rows of an Arrow batch: with texts of up to some 100 KB a batch stays within tens of MB."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser, in place on a uint64 array."""
    x ^= x >> U64(30)
    x *= MIX_1
    x ^= x >> U64(27)
    x *= MIX_2
    x ^= x >> U64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts of a string or binary column, one after the other, with the start and
    end of each row in them; null is an empty text."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    data = data[bounds[0]: bounds[-1]]
    return data, bounds[:-1] - bounds[0], bounds[1:] - bounds[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the texts of a slice stay near ``most_bytes`` (a longer text stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, _, ends = utf8(batch.column(column))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most_bytes, "right")))
            yield batch.slice(at, to - at)
            at = to


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
