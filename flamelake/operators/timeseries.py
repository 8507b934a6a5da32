"""Range queries: one series per label set, bucketed by a step."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flamelake.operators.select import _selector
from flamelake.plans.selector import Selector, during, label_column
from flamelake.schema import LABEL_COLUMNS, PROFILE_TYPE_COLUMNS, quoted


def _identity(samples: DataFrame) -> list[Column]:
    """What tells series apart: the profile type and the full label set, map labels as sorted entries."""
    labels = [quoted(c) for c in LABEL_COLUMNS if c in samples.columns]
    if "series_labels" in samples.columns:
        labels.append(F.array_sort(F.map_entries("series_labels")).alias("series_labels"))
    return [*(F.col(c) for c in PROFILE_TYPE_COLUMNS), *labels]


def profiles_in_range(
    samples: DataFrame,
    selector: str | Selector | None,
    start_ms: int,
    end_ms: int,
    limit: int | None = None,
) -> DataFrame:
    """One row per profile (profile type, label set and timestamp) with its summed value.

    ``limit`` keeps the most recent profiles, as a distributed top-k.
    """
    predicate = during(samples, start_ms, end_ms)
    if selector is not None:
        predicate &= _selector(selector).predicate(samples.columns)
    profiles = (
        samples.where(predicate)
        .groupBy(*_identity(samples), "timestamp")
        .agg(F.sum("value").alias("value"), F.max("duration").alias("duration"))
    )
    if limit is not None:
        keys = [quoted(c) for c in profiles.columns if c not in ("timestamp", "value", "duration")]
        profiles = profiles.orderBy(F.desc("timestamp"), *[F.asc_nulls_first(c) for c in keys]).limit(limit)
    if "series_labels" in profiles.columns:
        profiles = profiles.withColumn("series_labels", F.map_from_entries("series_labels"))
    return profiles


def query_range(
    samples: DataFrame,
    selector: str | Selector | None,
    start_ms: int,
    end_ms: int,
    step_ms: int,
    sum_by: Sequence[str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Series over step buckets aligned to the epoch.

    A series is a profile type with a label set, so counts and bytes are never
    added.  ``sum_by`` names the labels that separate series instead of the full
    set (with or without ``labels.``, columns or map labels); a name that is
    neither is an error.  ``duration`` adds each profile's duration once, so
    values are first summed per profile and then per bucket.
    """
    profiles = profiles_in_range(samples, selector, start_ms, end_ms, limit)
    if sum_by is None:
        keys = _identity(profiles)
    else:
        names = [name.removeprefix("labels.") for name in sum_by]
        labels = [label_column(name, profiles.columns).alias(f"labels.{name}") for name in names]
        keys = [*(F.col(c) for c in PROFILE_TYPE_COLUMNS), *labels]
    bucket = (F.col("timestamp") - F.pmod(F.col("timestamp"), F.lit(step_ms))).alias("bucket")
    series = (
        profiles.groupBy(*keys, bucket)
        .agg(F.sum("value").alias("value"), F.sum("duration").alias("duration"))
        .withColumn("value_per_second", F.col("value") / F.lit(step_ms / 1000.0))
    )
    if "series_labels" in series.columns:
        series = series.withColumn("series_labels", F.map_from_entries("series_labels"))
    return series
