"""Overlapping ranges as disjoint segments, each with all that covers it.

A segment reaches from one range end to the next, so what covers its first
position covers all of it, and a point lookup becomes an as-of join on segment starts.
The work is cut into pages of 2**PAGE_BITS positions: a range is filed under the
page it begins in and under each later page it covers that holds a range end
(the carry-over); pages without an end need nothing.  A range over everything is
copied once a page in use and its points meet one segment each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flamelake.operators.rangejoin import interval_lookup

PAGE_BITS = 12


def disjoint_segments(ranges: DataFrame, by: Sequence[str], entry: Column, low: str = "low", high: str = "high") -> DataFrame:
    """``(by, start, entries)`` of ranges ``low <= position < high`` (signed BIGINT).

    ``entries`` are the ``entry`` structs of the ranges over the segment, sorted; none for a gap
    between ranges, which therefore ends the segment before it.  Empty ranges count nothing.
    """
    page = lambda c: F.shiftright(c, PAGE_BITS)
    rows = ranges.where(F.col(low) < F.col(high)).select(*by, F.col(low).alias("_low"), F.col(high).alias("_high"), entry.alias("_entry"))
    starts = rows.select(*by, F.explode(F.array("_low", "_high")).alias("start")).distinct().withColumn("page", page("start"))
    carried = interval_lookup(
        starts.select(*by, "page").distinct(),
        rows.withColumn("_first", page("_low") + 1).withColumn("_past", page(F.col("_high") - 1) + 1),
        by,
        "page",
        "_first",
        "_past",
    )
    columns = [*by, "page", "_low", "_high", "_entry"]
    pieces = rows.withColumn("page", page("_low")).select(columns).unionByName(carried.select(columns)).alias("r")
    covers = (F.col("r._low") <= F.col("s.start")) & (F.col("s.start") < F.col("r._high"))
    for column in (*by, "page"):
        covers = covers & (F.col(f"s.{column}") == F.col(f"r.{column}"))
    return (
        starts.alias("s")
        .join(pieces, covers, "left")
        .groupBy(*[F.col(f"s.{c}").alias(c) for c in by], F.col("s.start").alias("start"))
        .agg(F.sort_array(F.collect_list("r._entry")).alias("entries"))
    )
