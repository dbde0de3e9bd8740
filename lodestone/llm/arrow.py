"""Small helpers for functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Rows, and characters or bytes, of one slice that a task holds as Python objects.
SLICE_ROWS, SLICE_BYTES = 512, 8 << 20
#: Bytes of a batch between Spark and Python, but for single longer rows.
BATCH_BYTES = 2 << 20


def mapped(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``rows.mapInArrow(run, schema)`` in batches of BATCH_BYTES at most.

    Spark's own bound is 10,000 rows, however long; an executor and its workers hold several such batches for each task, and
    keep much of that memory. The bound is one of the session, as Spark reads it when the rows are asked for; a lower one stays.
    """
    spark, key = rows.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key, None)
    if held is None or not 0 < spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(held) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return rows.mapInArrow(run, schema)


def own_text(docs: DataFrame, text_col: str) -> str | None:
    """The name of the column of ``docs`` that is ``text_col`` as a string already, so that no second one has to go to Python."""
    found = docs.select(F.col(text_col)).schema[0]
    return found.name if isinstance(found.dataType, StringType) and docs.columns.count(found.name) == 1 else None


def slices(batches: Iterator[pa.RecordBatch], text: str, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Parts of the batches of bounded rows and, but for single longer rows, bounded bytes of column ``text``."""
    for batch in batches:
        column, start, held = batch.column(batch.schema.get_field_index(text)), 0, 0
        sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
        for i, n in enumerate(sizes):
            if i > start and (held + n > SLICE_BYTES or i - start >= rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if batch.num_rows > start:
            yield batch.slice(start)


def appended(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch with more columns."""
    names = [*batch.schema.names, *columns]
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=names)
