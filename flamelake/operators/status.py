"""Agents and scrape targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Target states and healths.
STATES = ("any", "active", "dropped")
HEALTH = ("unknown", "good", "bad")


def agents_status(pushes: DataFrame, *order: str) -> DataFrame:
    """Last push of each agent from ``pushes(node, ip, pushed_at, error, duration, ...)``.

    An agent is named by its node, else by its address.
    """
    agent = F.coalesce(F.nullif("node", F.lit("")), "ip").alias("agent_id")
    last = F.max_by(F.struct("error", "pushed_at", "duration"), F.struct(*(order or ("pushed_at",))))
    return (
        pushes.groupBy(agent)
        .agg(last.alias("last"))
        .select(
            "agent_id",
            F.col("last.error").alias("last_error"),
            F.col("last.pushed_at").alias("last_push"),
            F.col("last.duration").alias("last_push_duration"),
        )
    )


def targets_by_state(targets: DataFrame, state: str = "any") -> DataFrame:
    """Targets in a state, one row each with its job, so no job is gathered in one place."""
    if state not in STATES:
        raise ValueError(f"unknown state {state!r}")
    return targets if state == "any" else targets.where(F.col("state") == state)


def jobs(targets: DataFrame, keys: Sequence[str] = ("job",)) -> DataFrame:
    """Number of targets per job and health."""
    return targets.groupBy(*keys).agg(
        F.count("*").alias("targets"),
        *[F.count(F.when(F.col("health") == h, True)).alias(h) for h in HEALTH],
    )
