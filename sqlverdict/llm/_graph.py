"""Connected components of large graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlverdict.llm._spark import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """node, comp for all nodes of the edges (a, b): comp is the smallest node of its component.

    Labels move to neighbours and then jump along themselves, so that chains halve each time. A hub's rows are
    joined against one row, which Spark can split, and minima are partly aggregated before they are shuffled.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        moved = written(step.join(jump, "comp", "left").select("node", "old", F.least("comp", F.coalesce("far", "comp")).alias("comp")), "labels")
        dropped(edges.sparkSession, labels)
        labels = moved
        if moved.where("old <> comp").isEmpty():
            dropped(edges.sparkSession, both)
            return moved.select("node", "comp")
