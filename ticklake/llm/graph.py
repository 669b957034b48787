"""Connected components by minimum-label propagation with pointer jumping.

Labels, edges and counts stay distributed; the driver sees one number a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklake.llm.common import table


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Rows (node, component) for every node with an edge; component is the smallest
    node reachable.  Self-loops, repeated and reversed edges are harmless; rows with
    a null end are ignored.  An empty input gives an empty result."""
    given = edges.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low"), F.col(a).isNull().alias("x"), F.col(b).isNull().alias("y")).where("not x and not y")
    down = table(given.select("high", "low").distinct(), "down")
    # a node keeps one edge, to its least neighbour below; its other neighbours below get
    # theirs to that one, so many stars over the same nodes shrink to about an edge a node
    least = table(down.groupBy("high").agg(F.min("low").alias("least")), "least")
    across = down.join(least, "high").where("low <> least or high = low").select(F.col("low").alias("a"), F.col("least").alias("b"))
    pairs = least.select(F.col("high").alias("a"), F.col("least").alias("b")).unionByName(across.distinct())
    both = table(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = table(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")), "labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("seen")), "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        hooked = labels.join(near, "node", "left").select("node", F.col("label").alias("before"), F.least("label", "seen").alias("hooked"))
        up = labels.select(F.col("node").alias("hooked"), F.col("label").alias("above"))
        after = table(hooked.join(up, "hooked", "left").select("node", "before", F.least("hooked", "above").alias("label")), "labels")
        labels = after.select("node", "label")
        if after.where(~F.col("before").eqNullSafe(F.col("label"))).isEmpty():
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
