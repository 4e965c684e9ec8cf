"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweft.llm.common import stored


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(id, component): the smallest id that edges (a, b) reach from each id that has one.

    Each round takes the smallest label among an id and its neighbours and then the label of
    that label, so that distances halve. Labels live in stored tables; no link or label comes to
    the driver, which only learns whether any label changed. Loops and repeated edges are fine.
    """
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()
    both = stored(both, "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("id"), F.least("a", "least").alias("component")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels["id"] == near["a"]).select("id", "component", F.least("component", "near").alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("component").alias("far"))
        new = stored(step.join(jump, "next", "left").select("id", F.least("next", F.coalesce("far", "next")).alias("component"), F.col("component").alias("old")), "labels")
        labels = new.select("id", "component")
        if new.where("component < old").isEmpty():
            return labels
    raise RuntimeError(f"no end after {max_rounds} rounds")
