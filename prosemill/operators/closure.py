"""Nodes reached along links, by doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import checkpointed


def reachable(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(root, node): each node of ``nodes`` (id) with itself and what it reaches over links (a, b), each once; cycles are fine.

    A round joins what was new in the last one with all that is known, so paths
    double; rounds are checkpointed.
    """
    known = checkpointed(links.select(F.col("a").alias("root"), F.col("b").alias("node")).where("root <> node").distinct())
    fresh = known
    while not fresh.isEmpty():
        ahead = known.select(F.col("root").alias("node"), F.col("node").alias("next"))
        behind = known.select("root", F.col("node").alias("middle"))
        longer = fresh.join(ahead, "node").select("root", F.col("next").alias("node")).union(behind.join(fresh.select(F.col("root").alias("middle"), "node"), "middle").select("root", "node"))
        fresh = checkpointed(longer.where("root <> node").distinct().join(known, ["root", "node"], "left_anti"))
        known = checkpointed(known.union(fresh))
    own = nodes.select(F.col("id").alias("root"), F.col("id").alias("node")).distinct()
    return own.union(known.join(own.select("root"), "root", "left_semi"))
