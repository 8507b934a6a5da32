"""Connected components of a link table by alternating star contraction, in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flamelake.llm.common import stage


def _towards(edges: DataFrame, both: bool) -> DataFrame:
    """Hang the larger neighbours (``both``) or the smaller ones of every node on its smallest neighbour."""
    links = edges
    if both:
        links = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    hung = links.join(lowest, "u")
    if both:
        return hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    own = lowest.select("u", F.col("m").alias("v"))
    rest = hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return own.unionByName(rest).where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component``: the smallest node reachable, for every node that has a link to another one.

    ``links`` has ``u`` and ``v``; direction, repetition and self links don't
    matter.  Every round is written to the shared folder; rounds grow with the
    logarithm of the number of nodes.
    """
    edges = stage(
        links.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "links",
    )
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select("v", "v").distinct().toDF("node", "component")
            )
        before = state
        edges = stage(_towards(stage(_towards(edges, True), "stars"), False), "stars")
