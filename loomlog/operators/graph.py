"""Connected components of link tables, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.sources.shared import shared_path, written


def components(links: DataFrame, most: int = 40) -> DataFrame:
    """(node, component): the smallest node reachable over links (a, b). Self links name a node; no links, no rows."""
    return by_rounds(written(links.select("a", "b").distinct(), "links"), most)


def by_rounds(links: DataFrame, most: int) -> DataFrame:
    """Label passing with shortcuts. Labels are checkpointed every round; the loop ends when none changes."""
    context = links.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_path(links.sparkSession, "checkpoints"))
    both = links.select("a", "b").union(links.select("b", "a")).toDF("a", "b").distinct().checkpoint()
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).toDF("node", "component")
    for _ in range(most):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("m")).withColumnRenamed("a", "node")
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("c"))
        jump = labels.toDF("c", "next")
        new = step.join(jump, "c", "left").select("node", "old", F.least("c", F.coalesce("next", "c")).alias("component")).checkpoint()
        labels = new.select("node", "component")
        if not new.where("component <> old").limit(1).count():
            return labels
    raise RuntimeError("components did not settle")
