"""Point-in-time and merged profiles, diffs, and stack and frame filters.

A *profile* is a DataFrame ``(stacktrace, value)``, one row per distinct stack;
a diff adds ``diff``.  Every operator here is one aggregation at most, with
map-side partial sums, so a hot stack costs one row per task in the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flamelake.functions.frames import basename, function_names
from flamelake.plans.selector import Selector, at, during, parse_selector

# Binary name patterns of the interpreters a runtime filter knows.
PYTHON_RUNTIME = r"^(lib)?python[0-9.]*(\.so.*)?$"
RUBY_RUNTIME = r"^(lib)?ruby[0-9.]*(\.so.*)?$"


def _selector(selector: str | Selector) -> Selector:
    return parse_selector(selector) if isinstance(selector, str) else selector


def aggregate_stacks(samples: DataFrame, stacks: DataFrame | None = None) -> DataFrame:
    """``GROUP BY stacktrace, SUM(value)``.

    With a ``stacks(stacktrace_id, stacktrace)`` dimension only the ids are
    shuffled and each distinct stack is looked up once, after the sum.
    """
    if stacks is None:
        return samples.groupBy("stacktrace").agg(F.sum("value").alias("value"))
    sums = samples.groupBy("stacktrace_id").agg(F.sum("value").alias("value"))
    return sums.join(stacks, "stacktrace_id", "left").select("stacktrace", "value")


def single_profile(
    samples: DataFrame,
    selector: str | Selector,
    time_ms: int,
    stacks: DataFrame | None = None,
    require_rows: bool = False,
) -> DataFrame:
    """The profile of a selector at one timestamp."""
    rows = samples.where(_selector(selector).predicate(samples.columns) & at(samples, time_ms))
    if require_rows and rows.isEmpty():
        raise LookupError("no samples for this selector at this time")
    return aggregate_stacks(rows, stacks)


def merge_profile(
    samples: DataFrame,
    selector: str | Selector | None,
    start_ms: int,
    end_ms: int,
    stacks: DataFrame | None = None,
) -> DataFrame:
    """All samples of a closed time range summed per stack."""
    predicate = during(samples, start_ms, end_ms)
    if selector is not None:
        predicate &= _selector(selector).predicate(samples.columns)
    return aggregate_stacks(samples.where(predicate), stacks)


def diff_profile(samples: DataFrame, is_a: Column, is_b: Column, absolute: bool = True) -> DataFrame:
    """Compare side ``b`` with side ``a``: ``value`` is b, ``diff`` is b minus scaled a.

    Both sides are predicates over one sample table, so the full outer join of
    two aggregates becomes a single pass with two conditional sums.  The
    relative form scales a by the ratio of the two totals and truncates.
    """
    sides = (
        samples.where(is_a | is_b)
        .groupBy("stacktrace")
        .agg(
            F.sum(F.when(is_a, F.col("value")).otherwise(F.lit(0))).alias("a"),
            F.sum(F.when(is_b, F.col("value")).otherwise(F.lit(0))).alias("b"),
        )
    )
    if absolute:
        scaled = F.col("a")
        return sides.select("stacktrace", F.col("b").alias("value"), (F.col("b") - scaled).alias("diff"))
    # One row of totals, attached as scalar subqueries.
    total_a = samples.where(is_a).agg(F.sum("value").alias("t")).scalar()
    total_b = samples.where(is_b).agg(F.sum("value").alias("t")).scalar()
    return (
        sides.withColumn("total_a", F.coalesce(total_a, F.lit(0).cast("bigint")))
        .withColumn("total_b", F.coalesce(total_b, F.lit(0).cast("bigint")))
        .select(
            "stacktrace",
            F.col("b").alias("value"),
            F.expr(
                "b - coalesce(cast(a as decimal(19,0)) * cast(total_b as decimal(19,0)) div nullif(total_a, 0L), 0L)"
            ).alias("diff"),
        )
    )


def stack_filter(profile: DataFrame, function: str) -> DataFrame:
    """Keep stacks that hold a function whose name contains ``function``, ignoring case."""
    needle = function.lower()
    return profile.where(F.exists(function_names(), lambda name: F.lower(name).contains(needle)))


def _refilter_frames(profile: DataFrame, keep) -> DataFrame:
    kept = profile.withColumn("stacktrace", F.filter("stacktrace", keep)).where(F.size("stacktrace") > 0)
    measures = [c for c in ("value", "diff") if c in profile.columns]
    return kept.groupBy("stacktrace").agg(*[F.sum(c).alias(c) for c in measures])


def frame_filter(profile: DataFrame, binaries: Sequence[str]) -> DataFrame:
    """Keep frames whose binary is listed; stacks that become equal are merged."""
    return _refilter_frames(profile, lambda f: basename(f["mapping_file"]).isin(list(binaries)))


def runtime_filter(
    profile: DataFrame,
    show_python: bool = False,
    show_ruby: bool = False,
    show_interpreted_only: bool = False,
) -> DataFrame:
    """Drop the frames of interpreters that are not shown, or keep interpreter frames only."""

    def keep(frame: Column) -> Column:
        binary = F.coalesce(basename(frame["mapping_file"]), F.lit(""))
        python, ruby = binary.rlike(PYTHON_RUNTIME), binary.rlike(RUBY_RUNTIME)
        if show_interpreted_only:
            return python | ruby
        visible = F.lit(True)
        if not show_python:
            visible &= ~python
        if not show_ruby:
            visible &= ~ruby
        return visible

    return _refilter_frames(profile, keep)


def filter_totals(profile: DataFrame, shown: Column) -> DataFrame:
    """One row: value shown by the predicate and value filtered out."""
    value = F.col("value")
    return profile.agg(
        F.coalesce(F.sum(F.when(shown, value)), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(~F.coalesce(shown, F.lit(False)), value)), F.lit(0)).alias("filtered"),
    )
