"""Session setting that keyed state needs."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_KEY = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, its change log beside the checkpoint."""
    before = spark.conf.get(_KEY, None)
    spark.conf.set(_KEY, PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(_KEY) if before is None else spark.conf.set(_KEY, before)
