"""Memory of Python workers, which Spark keeps between tasks."""

from __future__ import annotations

import ctypes
import gc
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import SparkSession

BATCH_ROWS = 1000  # rows of whole texts that go to a Python worker at a time


@contextmanager
def small_batches(spark: SparkSession):
    """Within it this session sends Python workers BATCH_ROWS rows at a time, unless it sends fewer: JVM and worker each hold a batch in full, more than once. Results do not depend on it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release() -> None:
    """Give memory that the allocators hold, but nothing uses, back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim:
        trim(0)


def releasing(run):
    """run (batches to batches), after whose last batch the task's memory is released, so that an idle worker holds little."""

    def task(batches):
        yield from run(batches)
        release()

    return task
