"""What the text operators share: table access and Arrow passes over whole texts."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flamelake.functions import workdir

Row = tuple


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone: other columns, whatever their names, never enter an operator."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def held_out(doc_id="doc_id"):
    """The evaluation third of the documents."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def parse(schema: str) -> T.StructType:
    return T.StructType.fromDDL(schema)


#: Spark's Bloom filter of a join's smaller side, of fixed size, from which sizes on it is made.
BLOOM = {
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1m",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g",
}


def stage(df: DataFrame, label: str, **settings: str) -> DataFrame:
    """``workdir.stage`` whose shuffle files go as soon as the table is written; ``settings`` hold meanwhile."""
    conf = df.sparkSession.conf
    settings = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", **settings}
    before = {key: conf.get(key, None) for key in settings}
    for key, value in settings.items():
        conf.set(key, value)
    try:
        return workdir.stage(df, label)
    finally:
        for key, value in before.items():
            conf.unset(key) if value is None else conf.set(key, value)


#: Bytes of text that one step of an Arrow pass works on; a longer text is a step of its own.
STEP_BYTES = 3 << 20


def _steps(batch: pa.RecordBatch, rows: int) -> Iterator[list]:
    """The columns of at most ``rows`` rows and about ``STEP_BYTES`` of text, as Python lists."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        most = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + STEP_BYTES, side="right"))
        end = max(start + 1, min(start + rows, most))
        yield [c.to_pylist() for c in batch.slice(start, end - start).columns]
        start = end


def _give_back() -> None:
    """Return a finished task's memory to the machine: the worker stays and other stages need the room."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_columns(df: DataFrame, make: Callable[[], Callable[[list], list]], schema: str, rows: int = 512) -> DataFrame:
    """As ``map_rows``, for functions that return whole columns (arrays of equal length).

    A function with an attribute ``finish`` gives further columns once its task has read everything.
    """
    fields = parse(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, out = make(), arrow_schema(fields)
        as_batch = lambda made: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, out, strict=True)], schema=out)
        for batch in batches:
            for columns in _steps(batch, rows):
                yield as_batch(work(columns))
        if hasattr(work, "finish"):
            yield as_batch(work.finish())
        del work
        _give_back()

    return df.mapInArrow(run, fields)


def map_rows(df: DataFrame, make: Callable[[], Callable[[list], Iterable[Row]]], schema: str, rows: int = 512) -> DataFrame:
    """One Arrow pass: ``make()`` runs once a task and gives a function from input columns to output rows.

    The function gets the columns of at most ``rows`` rows as Python lists, so
    that memory follows a few documents, not a partition.
    """
    fields = parse(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, out = make(), arrow_schema(fields)
        for batch in batches:
            for given in _steps(batch, rows):
                made = list(work(given))
                columns = list(zip(*made, strict=True)) if made else [()] * len(out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out
                )
        del work
        _give_back()

    return df.mapInArrow(run, fields)
