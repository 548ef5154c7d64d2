"""Shared plumbing of the text operators: columns, Arrow batches, written steps."""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.session import cut_lineage

#: Rows in one Arrow batch; texts can be long, so batches are kept short.
BATCH_ROWS = 256
BATCH_BYTES = 16 << 20


def short_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers by the size of a batch, whatever the texts' lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


@contextmanager
def batches_of(spark: SparkSession, rows: int, size: int = BATCH_BYTES) -> Iterator[None]:
    """Arrow batches of so many rows and bytes for the steps written inside; the caller's settings come back."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)}
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def step(df: DataFrame, *done: DataFrame) -> DataFrame:
    """Write a step to the shared folder and go on from the table.

    Tables of earlier steps that nothing reads any more (``done``) are deleted, and shuffle files of
    finished jobs are let go, so the disk holds the current step and not the whole job.
    """
    written = cut_lineage(df)
    context = df.sparkSession.sparkContext
    for table in done:
        for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    context._jvm.System.gc()
    return written


def text_of(name: str) -> Column:
    """Text as bytes, empty for null: no decoding on the way to Python."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")


def texts_of(column: pa.Array) -> list[str | None]:
    """Strings of a column of bytes or strings; what is not UTF-8 becomes U+FFFD."""
    return [text if text is None else text.decode("utf-8", "replace") for text in column.cast(pa.binary()).to_pylist()]


def crc_of(name: str) -> Column:
    """Tells apart rows that share an id; rows with the same id and text are one document."""
    return F.crc32(text_of(name))


def tasks_for(df: DataFrame, rows: int, per_task: int) -> int:
    """Partitions so that one holds ``per_task`` rows or so, and the machine is busy."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-rows // per_task))


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.asarray(column.offsets)
    return offsets - offsets[0], np.asarray(column.flatten())


def held_out(name: str) -> Column:
    """True for the third of ids that no classifier may learn from; a null id is held out too."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def table(columns: dict[str, Iterable], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
