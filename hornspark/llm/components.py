"""Connected components by contraction; edges and labels stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node it is connected with.

    Each round every node points to its smallest neighbour, pointers are followed twice, edges move to their
    roots, and those within one root go. What is left shrinks at least by half where anything is left, so the
    rounds grow with the logarithm of the largest component. Minima are aggregated before they are shuffled.
    """
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels: DataFrame | None = None
    while labels is None or not edges.isEmpty():
        ends = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        step = written(ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "step")
        for _ in range(2):
            up = step.select(F.col("node").alias("root"), F.col("root").alias("top"))
            step = step.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        step = written(step, "step")
        if labels is None:
            labels = step
        else:
            up = step.select(F.col("node").alias("root"), F.col("root").alias("top"))
            labels = written(labels.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "labels")
        for end in ("a", "b"):
            edges = edges.join(step.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
        edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return labels
