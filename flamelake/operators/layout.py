"""Places of flame graph nodes: record number, left offset and children, as a table of records.

Siblings stand in the order of their names, children from the left edge of their
parent, and records are numbered from 0 with each parent before its subtree.  Both the offset
and the number of a node are sums over its ancestors and itself of what their earlier
siblings take up: a window over siblings, then pointer doubling over ancestors.
Paths of length h need log2(h) rounds of joins; no path or tree is gathered.  Each round is a
written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flamelake.functions.workdir import stage


def _rounds(nodes: DataFrame) -> int:
    """Doublings until every node has looked past its root."""
    return ((nodes.agg(F.max("depth")).first()[0] or 0)).bit_length()


def _with_sizes(nodes: DataFrame, rounds: int) -> DataFrame:
    """``node_id, up, size``: number of nodes of each subtree.

    After a round, ``size`` counts descendants nearer than the distance to ``up``; what
    stands below them is added to the node that far up, summed before the shuffle.
    """
    at = nodes.select("node_id", F.when(F.col("depth") > 0, F.col("parent_id")).alias("up"), F.lit(1).cast("bigint").alias("size"))
    for _ in range(rounds):
        gains = at.where("up is not null").groupBy(F.col("up").alias("node_id")).agg(F.sum("size").alias("gain"))
        beyond = at.select(F.col("node_id").alias("up"), F.col("up").alias("next"))
        at = stage(
            at.join(gains, "node_id", "left")
            .join(beyond, "up", "left")
            .select("node_id", F.col("next").alias("up"), (F.col("size") + F.coalesce("gain", F.lit(0))).alias("size")),
            "layout-sizes",
        )
    return at.select("node_id", "size")


def _summed_over_ancestors(rows: DataFrame, rounds: int) -> DataFrame:
    """``node_id, left, record`` of ``(node_id, up, left, record)``: sums over each node and all above it."""
    at = rows
    for _ in range(rounds):
        above = at.select(
            F.col("node_id").alias("up"), F.col("up").alias("next"), F.col("left").alias("more_left"), F.col("record").alias("more_records")
        )
        at = stage(
            at.join(above, "up", "left").select(
                "node_id",
                F.col("next").alias("up"),
                (F.col("left") + F.coalesce("more_left", F.lit(0))).alias("left"),
                (F.col("record") + F.coalesce("more_records", F.lit(0))).alias("record"),
            ),
            "layout-sums",
        )
    return at.select("node_id", "left", "record")


def flamegraph_layout(nodes: DataFrame) -> DataFrame:
    """Nodes of ``reports.flamegraph`` (also trimmed) with ``record``, ``left`` and ``children``.

    A node covers ``left`` to ``left + cumulative``; ``children`` are the records of its
    children in their order, as many as it has distinct callees.  Siblings are different
    functions, so that a window over them holds no more rows than there are functions.
    """
    nodes = stage(nodes, "layout-nodes")
    rounds = _rounds(nodes)
    earlier = Window.partitionBy("parent_id").orderBy("name", "node_id").rowsBetween(Window.unboundedPreceding, -1)
    own = nodes.join(_with_sizes(nodes, rounds), "node_id").select(
        "node_id",
        F.when(F.col("depth") > 0, F.col("parent_id")).alias("up"),
        F.coalesce(F.sum("cumulative").over(earlier), F.lit(0)).cast("bigint").alias("left"),
        (F.coalesce(F.sum("size").over(earlier), F.lit(0)) + 1).cast("bigint").alias("record"),
    )
    placed = _summed_over_ancestors(stage(own, "layout-own"), rounds).withColumn("record", F.col("record") - 1)
    rows = stage(nodes.join(placed, "node_id"), "layout-placed")
    children = rows.where("depth > 0").groupBy(F.col("parent_id").alias("node_id")).agg(F.sort_array(F.collect_list("record")).alias("children"))
    return rows.join(children, "node_id", "left").withColumn("children", F.coalesce("children", F.array().cast("array<bigint>")))
