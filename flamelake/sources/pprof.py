"""pprof blobs to and from a table of messages.

The message table has one row per message of a profile: ``(profile_id, kind,
pos)`` and one column per kind, of which the row's own is set.  Python only
decodes or encodes single messages; joining, validating, numbering and putting
files together is done on the table.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from flamelake.functions.workdir import DROP_SHUFFLES, fresh_path, setting
from flamelake.sources import wire

REJECT = "reject"
KINDS = ("sample_type", "sample", "mapping", "location", "function", "string", "header")

# Rows handed to Spark at a time.
_BATCH = 8192
# Files that a task writes at a time; without it rows are sorted by kind.
_OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"
# Of staged messages.
_STAGED = {"compression": "zstd", "parquet.block.size": str(16 << 20)}
# Messages per encoded part.
PART_MESSAGES = 50_000


def _type_of(spec) -> T.DataType:
    if isinstance(spec, dict):
        return T.StructType([T.StructField(name, _type_of(kind)) for name, kind in spec.values()])
    if isinstance(spec, list):
        return T.ArrayType(_type_of(spec[0]))
    return {
        "int": T.LongType(),
        "bool": T.BooleanType(),
        "ints": T.ArrayType(T.LongType()),
        "text": T.StringType(),
    }[spec]


MESSAGES = T.StructType(
    [
        T.StructField("profile_id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("pos", T.LongType()),
        *[T.StructField(kind, _type_of(spec)) for kind, (_, spec) in wire.NUMBERS.items()],
        T.StructField("header", _type_of(wire.HEADER)),
    ]
)

_ARROW_MESSAGES = to_arrow_schema(MESSAGES)


def _messages(blob: bytes | None, part_kind: str | None, first: int | None) -> Iterator[tuple[str, int, object]]:
    """Messages of a whole profile, or of a part: those of its kind, with positions from ``first`` on."""
    if blob is None or blob[:2] != b"\x1f\x8b":
        yield REJECT, 0, "not gzip"
        return
    try:
        for kind, pos, message in wire.read_profile(gzip.decompress(blob)):
            if part_kind is None or kind == part_kind:
                yield kind, pos + (first or 0), message
    except (wire.Malformed, OSError, EOFError, zlib.error) as error:
        yield REJECT, 0, f"{type(error).__name__}: {error}"


def _batch(kind: str, rows: list[tuple[str, int, object]]) -> pa.RecordBatch:
    """Messages of one kind; the columns of the other kinds are null."""
    ids, positions, bodies = zip(*rows, strict=True)
    column = "string" if kind == REJECT else kind
    arrays = {"profile_id": ids, "kind": [kind] * len(rows), "pos": positions, column: bodies}
    return pa.RecordBatch.from_arrays(
        [
            pa.array(arrays[f.name], f.type) if f.name in arrays else pa.nulls(len(rows), f.type)
            for f in _ARROW_MESSAGES
        ],
        schema=_ARROW_MESSAGES,
    )


def decode(raw: DataFrame) -> DataFrame:
    """Message table of ``raw(profile_id, raw_profile)``; rows with ``part_kind`` and ``first`` are parts.

    Parts of one profile are read by different tasks: each holds messages of one
    kind and says where they stand, and only the header's part gives a header.  A blob that cannot be read gives a ``reject`` row with the reason; the
    messages read before the fault are ignored by validation.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffers: dict[str, list] = {}
        for batch in batches:
            for profile_id, blob, part_kind, first in zip(*batch.columns, strict=True):
                key = profile_id.as_py()
                for kind, pos, message in _messages(blob.as_py(), part_kind.as_py(), first.as_py()):
                    buffer = buffers.setdefault(kind, [])
                    buffer.append((key, pos, message))
                    if len(buffer) >= _BATCH:
                        yield _batch(kind, buffers.pop(kind))
        for kind, buffer in buffers.items():
            yield _batch(kind, buffer)

    part = [
        F.col(c).cast(kind).alias(c) if c in raw.columns else F.lit(None).cast(kind).alias(c)
        for c, kind in (("part_kind", "string"), ("first", "bigint"))
    ]
    return raw.select("profile_id", "raw_profile", *part).mapInArrow(rows, MESSAGES)


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """``raw(profile_id, raw_profile)`` of the files under ``path``, one profile each."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("profile_id"), F.col("content").alias("raw_profile"))


def rejects(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("kind") == REJECT).select("profile_id", F.col("string").alias("reason"))


def write_messages(messages: DataFrame, path: str) -> None:
    """Stage decoded messages once, by kind, for the joins that follow.

    A task keeps a file of each kind open, so its rows are not sorted by kind (and spilled) first; small row
    groups bound what the open files hold.
    """
    spark = messages.sparkSession
    with setting(spark, _OPEN_FILES, str(len(KINDS) + 1)), setting(spark, *DROP_SHUFFLES):
        messages.write.mode("overwrite").options(**_STAGED).partitionBy("kind").parquet(path)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MESSAGES).parquet(path).select(*MESSAGES.names)


# --- export --------------------------------------------------------------------


def _encode_kind(messages: DataFrame, kind: str) -> DataFrame:
    schema = pa.schema([("profile_id", pa.string()), ("pos", pa.int64()), ("field", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = [wire.write_field(kind, message) for message in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(fields, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    narrow = messages.where(F.col("kind") == kind).select("profile_id", "pos", kind)
    return narrow.mapInArrow(rows, "profile_id string, pos bigint, field binary").withColumn("kind", F.lit(kind))


def encode_fields(messages: DataFrame) -> DataFrame:
    """``(profile_id, pos, field, kind)``: each message as the bytes of its profile field.

    One pass per kind, over a staged table that is partitioned by kind: only
    the one column that is set goes to Python.
    """
    encoded = [_encode_kind(messages, kind) for kind in KINDS]
    united = encoded[0]
    for rows in encoded[1:]:
        united = united.unionByName(rows)
    return united


@F.pandas_udf(T.BinaryType())
def _gzip(data):
    return data.map(lambda b: None if b is None else gzip.compress(bytes(b), mtime=0))


def _ordered_kind(kind: str = "kind"):
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col(kind))


def pprof_parts(messages: DataFrame, part_messages: int = PART_MESSAGES) -> DataFrame:
    """Encoded profile in ordered parts ``(profile_id, part_kind, part, first, data)``.

    Fields of a message may be concatenated, so a profile of any size is
    encoded by many tasks, each part holding at most ``part_messages`` messages
    of one kind, of which ``first`` is the position of the first.
    """
    number = F.floor(F.col("pos") / part_messages)
    return (
        encode_fields(messages)
        .withColumnRenamed("kind", "part_kind")
        .groupBy("profile_id", "part_kind", number.alias("_number"))
        .agg(F.expr("listagg(field) within group (order by pos)").alias("data"), F.min("pos").alias("first"))
        .withColumn("part", _ordered_kind("part_kind") * 1_000_000_000 + F.col("_number"))
        .select("profile_id", "part_kind", "part", "first", "data")
    )


def write_pprof(messages: DataFrame, path: str, part_messages: int = PART_MESSAGES) -> None:
    """Write ``pprof_files`` rows to a table; messages are staged, so each kind is read once."""
    spark = messages.sparkSession
    by_kind = fresh_path(spark, "messages")
    write_messages(messages, by_kind)
    files = pprof_files(pprof_parts(read_messages(spark, by_kind), part_messages))
    with setting(spark, *DROP_SHUFFLES):
        files.write.mode("overwrite").parquet(path)


def pprof_files(parts: DataFrame) -> DataFrame:
    """Gzipped pprof as ``(profile_id, part_kind, part, first, raw_profile)``, in parts at every size.

    Each part is a gzip member of its own; the members in the order of ``part``
    are the file, and ``decode`` reads the parts as they are.
    """
    return parts.withColumn("raw_profile", _gzip("data")).drop("data")


def joined_files(files: DataFrame) -> DataFrame:
    """``(profile_id, raw_profile)``: the parts of every profile as one file, for receivers that take whole
    messages (1e9 bytes at most)."""
    whole = F.expr("listagg(raw_profile) within group (order by part)").alias("raw_profile")
    return files.groupBy("profile_id").agg(whole)
