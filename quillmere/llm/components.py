"""Connected components of an edge table, wholly distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) of every node that has an edge; root is its component's least node.

    Every round sends the labels that the last one changed over their nodes' edges,
    takes the minimum with map-side combining and jumps one pointer through the
    previous labels. Both
    sides of either join are plain exchanges, so a hub's rows can be split. A
    round is written to the shared folder, which cuts the lineage; rounds go on
    until no label changes. No edges give no rows.
    """
    both = materialise(
        edges.select(F.col(left).alias("u"), F.col(right).alias("v"))
        .where("u <> v")
        .select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e"))
        .select("e.u", "e.v")
        .distinct(),
        "edges",
    )
    least = F.least(F.min("v"), F.col("u"))
    labels = materialise(both.groupBy(F.col("u").alias("node")).agg(least.alias("root")).select("node", "root", (F.col("root") < F.col("node")).alias("fresh")), "labels")
    while True:
        sent = both.join(labels.where("fresh"), F.col("u") == F.col("node")).select(F.col("v").alias("node"), "root", F.lit(None).cast("long").alias("own"))
        best = sent.unionByName(labels.select("node", "root", F.col("root").alias("own"))).groupBy("node").agg(F.min("root").alias("root"), F.max("own").alias("own"))
        jump = labels.select(F.col("node").alias("at"), F.col("root").alias("further"))
        moved = best.join(jump, best.root == jump["at"], "left").select("node", F.least("root", "further").alias("root"), "own")
        after = materialise(moved.select("node", "root", (F.col("root") < F.col("own")).alias("fresh")), "labels")
        changed = after.where("fresh").limit(1).count()
        discard(labels)
        labels = after
        if not changed:
            discard(both)
            return labels.select("node", "root")
