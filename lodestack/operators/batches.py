"""Maps over Arrow batches that are bounded in bytes, however long the texts are."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Bytes of an Arrow batch; one longer row is a batch of its own.
BATCH_BYTES = "4194304b"


def arrow_rows(df: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """df mapped batch by batch. A worker holds one batch and what is made of it, and gives back what it no longer needs."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield make(batch)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library than glibc
            pass

    return df.mapInArrow(run, schema)
