"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.shared import forget, keep

#: Tasks that the rows asking for one node are spread over.
PARTS = 8


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for each end of an edge; label: the smallest node reachable.

    Each round takes the least label among a node and its neighbours, then the label of that label, so the rounds grow
    with the logarithm of the longest chain. A node's neighbours meet in partial aggregates, never in one task; the look-ups
    of a round, by neighbour and by label, are dealt by a part of the asking node too, so a hub or a large component is
    spread over PARTS tasks. Rounds are cut by tables in the shared folder. No edges: no rows. Null ends and self-links are
    ignored.
    """
    part = F.pmod(F.xxhash64("node"), F.lit(PARTS)).alias("part")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).alias("part")
    both = edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = keep(both.union(both.select("other", "node")).distinct(), "links")
    labels = keep(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("label")), "labels")
    while True:
        near = both.withColumn("part", part).join(labels.select(F.col("node").alias("other"), "label", each), ["other", "part"]).select("node", "label")
        least = near.union(labels).groupBy("node").agg(F.min("label").alias("label"))
        used = labels.select("label").distinct()
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further")).join(used, "label").select("label", "further", each)
        new = keep(
            least.withColumn("part", part).join(jump, ["label", "part"], "left").join(labels.select("node", F.col("label").alias("was")), "node")
            .select("node", F.least("label", "further").alias("label"), "was"),
            "labels",
        )
        moved = new.where("label <> was").limit(1).count()
        forget(labels)
        labels = new.select("node", "label")
        if not moved:
            forget(both)
            return labels
