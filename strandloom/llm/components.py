"""Connected components of an edge table, without driver-side data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import durable


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, label): label is the smallest node that can be reached.

    Each round takes the smallest label among the neighbours and then jumps to
    that label's own label, so long chains shrink by half in a round. Edges
    that repeat, self-loops and empty tables are allowed; null ends are left out.
    """
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    both = durable(e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = durable(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("label")))
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("y"), "label"), "y")
            .groupBy(F.col("x").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        low = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        new = durable(
            low.join(jump, "low", "left").select("node", F.coalesce(F.least("low", "far"), "low").alias("new"), (F.coalesce(F.least("low", "far"), "low") < F.col("label")).alias("moved"))
        )
        moved = new.where("moved").limit(1).count()
        labels = new.select("node", F.col("new").alias("label"))
        if not moved:
            return labels
