"""What several operators share: reading a table, the shared folder, word patterns."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of what is not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only where none is configured (tests) a folder beside the warehouse is set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, column: int, size: int, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about size bytes of that column of strings at most (one row at least), and of rows rows."""
    if not batch.num_rows:
        return
    ends = np.cumsum(np.asarray(pc.binary_length(batch.column(column)).fill_null(0), np.int64))
    a = 0
    while a < batch.num_rows:
        before = int(ends[a - 1]) if a else 0
        b = min(max(a + 1, int(np.searchsorted(ends, before + size, "right"))), a + rows, batch.num_rows)
        yield batch.slice(a, b - a)
        a = b


@lru_cache(maxsize=1)
def one_thread() -> None:
    """Matrix products of this worker run on its task's own thread: tasks are the parallelism, and threads that wait for each other
    burn as much time again. A numpy without the bundled library keeps its setting."""
    for path in sorted((Path(np.__file__).parent.parent / "numpy.libs").glob("*openblas*")):
        library = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                return


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """An Arrow function that gives the memory it no longer uses back to the system at its end, as workers wait for their next task."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # not this C library: nothing to give back
                pass

    return out
