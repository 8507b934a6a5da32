"""Range sums of a sample stream in windows that close, with late samples as an output of their own.

State is one pair of numbers per open window, ``by`` values and share.  A window is given
out once, when the watermark passes its end; samples that come later are given out at
once as late sums.  Each sample is counted in exactly one of the two, so both
together are the sums of the batch form.  The shares split a window that holds a
large part of all samples over several tasks; readers add them up.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from flamelake.schema import quoted
from flamelake.streaming.state import rocksdb

#: Tasks over which one window of one series is spread at most.
SHARES = 8
_SUMS = T.StructType([T.StructField("samples", T.LongType()), T.StructField("value", T.LongType())])


class _Windows(StatefulProcessor):
    def __init__(self, columns: list[str], step_ms: int):
        self.columns, self.step_ms = columns, step_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", _SUMS)

    def _row(self, key: tuple, late: bool, sums: tuple) -> pd.DataFrame:
        # The last part of a key is its share.
        return pd.DataFrame([(*key[:-1], *sums, late)], columns=self.columns)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        samples = value = 0
        for part in rows:
            samples += len(part)
            value += sum(map(int, part["value"]))
        end = int(key[-2]) + self.step_ms
        if end <= timerValues.getCurrentWatermarkInMs():
            yield self._row(key, True, (samples, value))
            return
        if self.sums.exists():
            before = self.sums.get()
            samples, value = samples + before[0], value + before[1]
        else:
            self.handle.registerTimer(end - 1)  # timers fire when the watermark is past them
        self.sums.update((samples, value))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.sums.exists():
            yield self._row(key, False, tuple(self.sums.get()))
            self.sums.clear()

    def close(self) -> None:
        pass


def _schema(rows: T.StructType, by: Sequence[str]) -> T.StructType:
    return T.StructType(
        [
            *[rows[c] for c in by],
            T.StructField("bucket", T.LongType()),
            *_SUMS.fields,
            T.StructField("late", T.BooleanType()),
        ]
    )


def window_stream(stream: DataFrame, step_ms: int, lateness: str, by: Sequence[str]) -> DataFrame:
    """``(by..., bucket, samples, value, late)`` of a stream ``(timestamp in ms, value, by...)``.

    Buckets align to the epoch.  Samples without a timestamp or value are not counted; null
    is a value of ``by`` like any other; a sum beyond 64 bits is an error, as in the batch form.
    The session needs the RocksDB state store.
    """
    schema = _schema(stream.schema, by)
    # The time column ends before the grouping: the state operator would drop late rows by it.
    keyed = (
        stream.where("timestamp is not null and value is not null")
        .withColumn("_at", F.timestamp_millis("timestamp"))
        .withWatermark("_at", lateness)
        .select(
            *[quoted(c) for c in by],
            (F.col("timestamp") - F.pmod("timestamp", F.lit(step_ms))).alias("bucket"),
            F.pmod(F.xxhash64("timestamp", "value"), F.lit(SHARES)).alias("_share"),
            F.col("value").cast("bigint").alias("value"),
        )
    )
    return keyed.groupBy(*[quoted(c) for c in by], "bucket", "_share").transformWithStateInPandas(
        statefulProcessor=_Windows(schema.names, step_ms), outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )


def write_windows(stream: DataFrame, out: str, checkpoint: str, step_ms: int, lateness: str, by: Sequence[str]) -> StreamingQuery:
    """Run ``window_stream`` over all that has arrived, into ``late=false`` and ``late=true`` below ``out``."""
    with rocksdb(stream.sparkSession):
        return (
            window_stream(stream, step_ms, lateness, by)
            .writeStream.format("parquet")
            .outputMode("append")
            .partitionBy("late")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start(out)
        )


def read_windows(spark: SparkSession, out: str, schema: T.StructType, by: Sequence[str], late: bool) -> DataFrame:
    """Sums of closed windows, or of their late samples; ``schema`` gives the types of ``by``."""
    rows = spark.read.schema(_schema(schema, by)).parquet(out).where(F.col("late") == late)
    return rows.groupBy(*[quoted(c) for c in by], "bucket").agg(F.sum("samples").alias("samples"), F.sum("value").alias("value"))
