"""Connected components of an edge table, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node each node of edges (a, b) is connected to.

    Labels fall to the least label among the neighbours, then to their label's own label, until
    none falls; a chain of n nodes takes about log n rounds. Aggregations combine on the map side
    and joins are plain shuffles of materialised tables, so that hot nodes can be split.
    """
    ends = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))
    both = cut(edges.where("a != b").select(F.inline(ends)).distinct())
    labels = cut(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = labels.join(seen, "node").join(far, "label", "left").select("node", F.least("label", "near", "far").alias("label"), F.col("label").alias("was"))
        moved = Observation()
        new = cut(new.observe(moved, F.count(F.when(F.col("label") != F.col("was"), 1)).alias("n")))
        labels = new.select("node", "label")
        if not moved.get["n"]:
            return labels
