"""Profile selector ``k=v,k=v|name:sample_type:sample_unit:period_type:period_unit``."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flamelake.schema import METADATA_LABELS, PROFILE_TYPE_COLUMNS


@dataclass(frozen=True)
class Selector:
    matchers: tuple[tuple[str, str], ...]
    profile_type: tuple[str, ...]

    def predicate(self, columns: Sequence[str] = ()) -> Column:
        """All label equalities and the five profile-type equalities, for a table with ``columns``."""
        return all_of([*(label_equals(k, v, columns) for k, v in self.matchers), profile_type_is(self.profile_type)])


def parse_selector(text: str) -> Selector:
    parts = text.strip().split("|")
    if len(parts) != 2:
        raise ValueError(f"selector needs exactly one '|', found {len(parts)} part(s): {text!r}")
    matchers = []
    for matcher in parts[0].split(","):
        pair = matcher.strip().split("=")
        if len(pair) != 2:
            raise ValueError(f"label matcher needs exactly one '=': {matcher!r}")
        matchers.append((pair[0], pair[1]))
    meta = tuple(parts[1].strip().split(":"))
    if len(meta) != len(PROFILE_TYPE_COLUMNS):
        raise ValueError(f"profile type needs {len(PROFILE_TYPE_COLUMNS)} fields, found {len(meta)}")
    return Selector(tuple(matchers), meta)


def all_of(predicates: list[Column]) -> Column:
    return reduce(and_, predicates)


def label_column(label: str, columns: Sequence[str] = ()) -> Column:
    """Value of a label: its own column, else the label maps of a table with ``columns``, where the labels
    of a sample go before those of its series.  Null where the label is missing."""
    if label in METADATA_LABELS:
        return F.col(f"`labels.{label}`")
    maps = [c for c in ("sample_labels", "series_labels") if c in columns]
    if not maps:
        raise ValueError(f"unknown label {label!r}")
    return F.coalesce(*[F.try_element_at(F.col(c), F.lit(label)) for c in maps])


def label_equals(label: str, value: str, columns: Sequence[str] = ()) -> Column:
    """Equality on a label; a missing label never matches."""
    return label_column(label, columns) == value


def profile_type_is(values: tuple[str, ...]) -> Column:
    return all_of([F.col(c) == v for c, v in zip(PROFILE_TYPE_COLUMNS, values, strict=True)])


def _utc_date(ms: int) -> dt.date:
    return (dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=ms)).date()


def during(samples: DataFrame, start_ms: int, end_ms: int) -> Column:
    """Closed time range, plus the matching ``date`` range so partitions prune."""
    in_range = F.col("timestamp").between(start_ms, end_ms)
    if "date" in samples.columns:
        in_range &= F.col("date").between(F.lit(_utc_date(start_ms)), F.lit(_utc_date(end_ms)))
    return in_range


def at(samples: DataFrame, time_ms: int) -> Column:
    exact = F.col("timestamp") == time_ms
    if "date" in samples.columns:
        exact &= F.col("date") == F.lit(_utc_date(time_ms))
    return exact
