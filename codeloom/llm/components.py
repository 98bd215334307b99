"""Connected components of an edge table by minimum labels with pointer jumping.

Every round is one table of (node, label) in the shared folder; the driver sees one number
a round.  Labels only fall; a round takes each node's minimum over its neighbours and then
follows the label once, so a chain of n nodes needs about log n rounds.  A node with very
many edges is a frequent join key of the edge side only, which Spark can split, and its
minimum is pre-aggregated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node reachable over (a, b) edges; staged (the caller discards it)."""
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = staged(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = (both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("low"))
                .select(F.col("a").alias("node"), "low"))
        lowered = labels.join(near, "node").select("node", "label", F.least("label", "low").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("via"))
        new = staged(lowered.join(jump, "low").select("node", F.least("low", "via").alias("label"), (F.least("low", "via") < F.col("label")).alias("moved")), "labels")
        moved = new.where("moved").limit(1).count()
        discard(labels)
        path = new.staged_path
        labels = new.drop("moved")
        labels.staged_path = path
        if not moved:
            discard(both)
            return labels
