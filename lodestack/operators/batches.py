"""Arrow batches to Python, bounded by bytes: texts differ widely in length, so a number of rows bounds nothing."""

from __future__ import annotations

import ctypes
import re

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows and bytes of a batch to Python.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Batches to Python are bounded: by bytes, and by fewer rows where only rows count."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        found = re.fullmatch(r"(\d+)b?", spark.conf.get(name))
        if not found or not 0 < int(found[1]) <= most:
            spark.conf.set(name, str(most))


def give_back() -> None:
    """Returns freed memory to the system: workers are used again, and what they keep counts against their executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass
