"""Helpers shared by the operators: memory of Python workers, running totals, batches cut by bytes."""

from __future__ import annotations

import ctypes
import inspect
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import discard, materialize, scratch, shared_dir  # noqa: F401


def frugal(function: Callable) -> Callable:
    """The function of a mapInArrow or applyInArrow call, which at its end gives the memory that it has freed back to the machine. A Python
    worker lives on for the next task, beside those of other stages; what it keeps, they lack."""
    if inspect.isgeneratorfunction(function):

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from function(batches)
            _give_back()

        return run

    def of(*args: object) -> object:
        out = function(*args)
        if sum(x.nbytes for x in args if isinstance(x, pa.Table)) > 1 << 20:
            _give_back()
        return out

    # Spark tells by the number of parameters whether a key is wanted
    return (lambda a, b: of(a, b)) if len(inspect.signature(function).parameters) == 2 else lambda a, b, c: of(a, b, c)


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def running_total(df: DataFrame, order: str, value: str, out: str, block: int = 1024) -> DataFrame:
    """Adds `out`, the sum of `value` over all rows with a smaller `order` (a whole number, unique).

    Two levels: inside blocks of `block` numbers, then over the blocks, so that the one task that sees all blocks gets
    1/`block` of the rows.
    """
    blocks = df.withColumn("_block", F.floor(F.col(order) / block))
    inner = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.groupBy("_block").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_earlier"))
    return (
        blocks.withColumn("_inner", F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .join(starts, "_block")
        .withColumn(out, F.col("_earlier") + F.col("_inner"))
        .drop("_block", "_inner", "_earlier")
    )


def whole_text(col: str | Column = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in batches whose `column` holds about `limit` bytes (one row at least)."""
    for batch in batches:
        sizes = pc.cumulative_sum(pc.fill_null(pc.cast(pc.binary_length(batch.column(column)), pa.int64()), 0)).to_numpy(zero_copy_only=False)
        start = 0
        while start < batch.num_rows:
            base = int(sizes[start - 1]) if start else 0
            end = max(start + 1, int(sizes.searchsorted(base + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end
