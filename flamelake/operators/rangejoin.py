"""Point-in-interval join without a range-join operator.

An interval is filed under the finest bucket size of which it covers at most
``2**SPREAD + 1`` buckets; a point is filed under its bucket of every size in
use.  The join is then an equi join on (keys, size, bucket) plus the exact
comparison.  A long interval is copied a bounded number of times, yet spreads
its points over at least ``2**(SPREAD - STEP)`` buckets, and a bucket holds no
more distinct points than its size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEP = 6
SPREAD = 9
SIZES = tuple(range(6, 64, STEP))


def interval_lookup(
    points: DataFrame,
    intervals: DataFrame,
    by: Sequence[str],
    point: str,
    low: str = "low",
    high: str = "high",
) -> DataFrame:
    """Inner join of points and intervals with ``low <= point < high`` (signed BIGINT)."""
    last = F.col(high) - 1
    span = [
        (size, F.shiftright(last, size) - F.shiftright(low, size) <= (1 << SPREAD)) for size in SIZES
    ]
    size = F.lit(SIZES[-1])
    for bits, fits in reversed(span):
        size = F.when(fits, F.lit(bits)).otherwise(size)
    filed = (
        intervals.where(F.col(low) < F.col(high))
        .withColumn("_size", size)
        .withColumn(
            "_bucket",
            F.explode(
                F.expr(f"sequence(shiftright({low}, _size), shiftright({high} - 1, _size), 1L)")
            ),
        )
    )
    # At most len(SIZES) integers: points are copied only for sizes that hold intervals.
    in_use = intervals.where(F.col(low) < F.col(high)).agg(F.collect_set(size).alias("sizes")).scalar()
    probing = (
        points.withColumn("_size", F.explode(F.coalesce(in_use, F.array().cast("array<int>"))))
        .withColumn("_bucket", F.expr(f"shiftright({point}, _size)"))
    )
    return (
        probing.join(filed, [*by, "_size", "_bucket"])
        .where((F.col(low) <= F.col(point)) & (F.col(point) < F.col(high)))
        .drop("_size", "_bucket")
    )
