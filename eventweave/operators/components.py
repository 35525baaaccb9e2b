"""Connected components of nodes that share keys, by label propagation.

Labels travel node -> key -> node as `min` aggregates, so a key shared by very many
nodes costs one combined row per task and is never expanded into pairs. A pointer jump
per round makes long chains converge in a logarithmic number of rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """links(node, key) -> (node, component); the component is its smallest node."""
    links = cut_lineage(links.select("node", "key").distinct())  # read twice in every round
    labels = cut_lineage(links.groupBy("node").agg(F.min("node").alias("component")))
    while True:  # every round lowers a label or is the last
        per_key = links.join(labels, "node").groupBy("key").agg(F.min("component").alias("k"))
        heard = links.join(per_key, "key").groupBy("node").agg(F.min("k").alias("component"))
        jump = heard.select(F.col("node").alias("component"), F.col("component").alias("j"))
        moved = heard.join(jump, "component", "left").select(
            "node", F.least("component", F.coalesce("j", "component")).alias("component"))
        moved = cut_lineage(moved)
        changed = moved.join(labels.withColumnRenamed("component", "old"), "node").filter(
            F.col("component") != F.col("old"))
        labels = moved
        if changed.isEmpty():
            return labels
