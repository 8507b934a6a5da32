"""Shared scratch folder: the one the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files go when the write that made them ends, not when the driver collects its garbage.
DROP_SHUFFLES = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
_LOCAL_ROOTS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Root every executor can reach.

    A folder of this machine is used only for a session that runs on this
    machine alone; a cluster without the setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[application] = tempfile.mkdtemp(prefix="flamelake-")
    return _LOCAL_ROOTS[application]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write an intermediate table that several steps read, and continue from the written copy.

    The plan is cut there, the table is computed once, and a lost executor costs
    a read, not the work before it.  ``options`` are those of the Parquet writer.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    with setting(spark, *DROP_SHUFFLES):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the writes and streams that start inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
