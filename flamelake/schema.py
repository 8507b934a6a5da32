"""Schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

# The label names that get a column of their own in the store.
METADATA_LABELS = (
    "pid",
    "ppid",
    "arch",
    "systemd_unit",
    "node",
    "cgroup_name",
    "compiler",
    "stripped",
    "static",
    "comm",
    "executable",
    "kernel_release",
    "agent_revision",
    "buildid",
    "thread_id",
    "thread_name",
    "namespace",
    "pod",
    "container",
    "containerid",
)

LABEL_COLUMNS = tuple(f"labels.{name}" for name in METADATA_LABELS)

LINE = T.StructType(
    [
        T.StructField("line", T.LongType()),
        T.StructField("function_name", T.StringType()),
        T.StructField("function_system_name", T.StringType()),
        T.StructField("function_filename", T.StringType()),
        T.StructField("function_start_line", T.LongType()),
    ]
)

# Addresses are unsigned 64-bit values kept bit for bit in BIGINT.
FRAME = T.StructType(
    [
        T.StructField("address", T.LongType()),
        T.StructField("mapping_start", T.LongType()),
        T.StructField("mapping_limit", T.LongType()),
        T.StructField("mapping_offset", T.LongType()),
        T.StructField("mapping_file", T.StringType()),
        T.StructField("mapping_build_id", T.StringType()),
        T.StructField("lines", T.ArrayType(LINE)),
    ]
)

STACKTRACE = T.ArrayType(FRAME)

PROFILE_TYPE_COLUMNS = ("name", "sample_type", "sample_unit", "period_type", "period_unit")

SAMPLES = T.StructType(
    [
        T.StructField("duration", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("period", T.LongType()),
        T.StructField("period_type", T.StringType()),
        T.StructField("period_unit", T.StringType()),
        T.StructField("sample_type", T.StringType()),
        T.StructField("sample_unit", T.StringType()),
        T.StructField("stacktrace", STACKTRACE),
        T.StructField("stacktrace_id", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("value", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in LABEL_COLUMNS],
        T.StructField("series_labels", T.MapType(T.StringType(), T.StringType())),
        T.StructField("sample_labels", T.MapType(T.StringType(), T.StringType())),
        T.StructField("num_labels", T.MapType(T.StringType(), T.LongType())),
        T.StructField("ingest_date", T.DateType()),
        T.StructField("date", T.DateType()),
    ]
)


def quoted(name: str) -> str:
    """Backtick a column whose name holds a dot."""
    return f"`{name}`" if "." in name else name
