"""As-of join: for each probe the last entry at or before it.

Spark has no such join, and a window per key would put a hot key (a kernel or
libc build id) into one task.  Keys are therefore split by address range.  With
21 bits per level a 64-bit key space takes three levels, and because probes and
entries are distinct per position no group holds more than 2**21 of each:

* level 0 sorts probes and entries that share ``position >> 21``;
* a probe before the first entry of its range asks for the last *range* before
  its own, which is the same question over (far fewer) ranges: level 1 uses
  ``>> 42`` and level 2 the whole key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVEL_BITS = 21
TOP_LEVEL = 2


def asof_lookup(
    probes: DataFrame,
    entries: DataFrame,
    by: Sequence[str],
    position: str,
    payload: Sequence[str],
) -> DataFrame:
    """Distinct ``(by, position)`` of the probes with the entry's position and payload.

    ``position`` is compared as a signed BIGINT in both inputs; use
    ``u64.order_key`` for unsigned addresses.  Several entries at one position
    must be reduced to one beforehand.  Probes without an entry get nulls.
    """
    wanted = probes.select(*by, F.col(position).alias("_pos")).distinct()
    known = entries.select(
        *by,
        F.col(position).alias("_pos"),
        F.struct(F.col(position).alias("_at"), *payload).alias("_hit"),
    )
    found = _level(wanted, known, list(by), 0)
    return found.select(
        *by,
        F.col("_pos").alias(position),
        F.col("_hit._at").alias(f"matched_{position}"),
        *[F.col(f"_hit.{c}").alias(c) for c in payload],
    )


def _level(wanted: DataFrame, known: DataFrame, by: list[str], level: int) -> DataFrame:
    top = level == TOP_LEVEL
    bucket: list[Column] = [] if top else [F.shiftright("_pos", LEVEL_BITS).alias("_bucket")]
    keys = by if top else [*by, "_bucket"]
    no_hit = F.lit(None).cast(known.schema["_hit"].dataType)
    rows = known.select(*by, *bucket, "_pos", "_hit", F.lit(False).alias("_probe")).unionByName(
        wanted.select(*by, *bucket, "_pos", no_hit.alias("_hit"), F.lit(True).alias("_probe"))
    )
    # False sorts first, so an entry at the probe's own position is seen.
    running = Window.partitionBy(*keys).orderBy("_pos", "_probe")
    matched = (
        rows.withColumn("_hit", F.last("_hit", ignorenulls=True).over(running.rowsBetween(Window.unboundedPreceding, 0)))
        .where("_probe")
        .drop("_probe")
    )
    if top:
        return matched
    # The last entry of each range before one with a probe.  All of these ranges are asked for, not
    # just those of probes without a hit: they are few, and the window above is not needed twice.
    summary = (
        known.select(*by, *bucket, "_pos", "_hit")
        .groupBy(*by, "_bucket")
        .agg(F.max_by("_hit", "_pos").alias("_hit"))
        .withColumnRenamed("_bucket", "_pos")
    )
    ranges_before = wanted.select(*by, (F.shiftright("_pos", LEVEL_BITS) - 1).alias("_pos")).distinct()
    earlier = _level(ranges_before, summary, by, level + 1).select(
        *by, (F.col("_pos") + 1).alias("_bucket"), F.col("_hit").alias("_earlier")
    )
    return (
        matched.join(earlier, [*by, "_bucket"], "left")
        .withColumn("_hit", F.coalesce("_hit", "_earlier"))
        .drop("_earlier", "_bucket")
    )
