"""Connected components of an undirected graph, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """v, root (smallest vertex reachable) of the vertices of edges (a, b long). Rounds of neighbour minima and pointer jumping, each written to the shared folder."""
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("b")).select("v", F.least("v", "b").alias("root")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("root").alias("near"))
        better = labels.join(near, "v").select("v", "root", F.least("root", "near").alias("best"))
        jump = labels.select(F.col("v").alias("best"), F.col("root").alias("further"))
        after = materialize(better.join(jump, "best").select("v", F.least("best", "further").alias("root"), (F.least("best", "further") < F.col("root")).alias("moved")), "labels")
        labels = after.select("v", "root")
        if after.where("moved").isEmpty():
            return labels
