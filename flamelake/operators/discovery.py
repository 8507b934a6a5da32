"""What is in the store: profile types, label names, label values, profile metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flamelake.functions.frames import basename
from flamelake.operators.select import _selector
from flamelake.plans.selector import Selector, during, label_column
from flamelake.schema import LABEL_COLUMNS, METADATA_LABELS, PROFILE_TYPE_COLUMNS, quoted


def _window(
    samples: DataFrame, selector: str | Selector | None, start_ms: int | None, end_ms: int | None
) -> DataFrame:
    if start_ms is not None and end_ms is not None:
        samples = samples.where(during(samples, start_ms, end_ms))
    if selector is not None:
        samples = samples.where(_selector(selector).predicate(samples.columns))
    return samples


def profile_types(samples: DataFrame) -> DataFrame:
    """Distinct profile types; ``delta`` marks profiles that cover a duration."""
    return samples.select(*PROFILE_TYPE_COLUMNS, (F.col("duration") != 0).alias("delta")).distinct()


def label_names(
    samples: DataFrame,
    selector: str | Selector | None = None,
    start_ms: int | None = None,
    end_ms: int | None = None,
) -> DataFrame:
    """Labels that occur: fixed label columns and the keys of the label maps, in one pass."""
    rows = _window(samples, selector, start_ms, end_ms)
    fixed = [c for c in LABEL_COLUMNS if c in samples.columns]
    maps = [c for c in ("series_labels", "sample_labels", "num_labels") if c in samples.columns]
    names = [
        F.array_compact(F.array(*[F.when(F.col(quoted(c)).isNotNull(), F.lit(c.removeprefix("labels."))) for c in fixed])),
        *[F.coalesce(F.map_keys(c), F.expr("cast(array() as array<string>)")) for c in maps],
    ]
    # Rows with the same labels are one before their names are listed.
    return rows.select(F.array_distinct(F.concat(*names)).alias("names")).distinct().select(
        F.explode("names").alias("label_name")
    ).distinct()


def label_values(
    samples: DataFrame,
    label: str,
    selector: str | Selector | None = None,
    start_ms: int | None = None,
    end_ms: int | None = None,
) -> DataFrame:
    """Distinct values of a label, in order; any label that ``label_names`` lists.

    A label with a column is read there, others in the label maps; numbers are
    given as text.
    """
    if label in METADATA_LABELS:
        column = label_column(label)
    else:
        maps = [c for c in ("sample_labels", "series_labels", "num_labels") if c in samples.columns]
        if not maps:
            raise ValueError(f"unknown label {label!r}")
        column = F.coalesce(*[F.try_element_at(F.col(c), F.lit(label)).cast("string") for c in maps])
    return (
        _window(samples, selector, start_ms, end_ms)
        .where(column.isNotNull())
        .select(column.alias("label_value"))
        .distinct()
        .orderBy("label_value")
    )


def profile_metadata(samples: DataFrame) -> DataFrame:
    """Binaries and labels of a profile as ``(kind, name)`` rows."""
    binaries = (
        samples.select(F.explode(F.array_distinct(F.transform("stacktrace", lambda f: f["mapping_file"]))).alias("f"))
        .where("f <> ''")
        .select(F.lit("binary").alias("kind"), basename("f").alias("name"))
        .distinct()
    )
    labels = label_names(samples).select(F.lit("label").alias("kind"), F.col("label_name").alias("name"))
    return binaries.unionByName(labels)
