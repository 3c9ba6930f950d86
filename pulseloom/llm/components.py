"""Connected components as a loop of Spark joins, written to the shared folder after each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """`edges(a, b)` of longs -> `(node, root)` with the least node of each component, for nodes that have an edge.

    Every round takes the least label among a node's neighbours and its label's
    own label (as if the label were a neighbour too), so that paths halve; that is
    one join and one grouping. Self-loops and repeated edges do no harm; an empty
    input gives an empty result.
    """
    both = stage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a IS NOT NULL AND b IS NOT NULL"), "links")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), "labels")
    while True:
        # A label is never above the node it is the label of, so that of a node's label stands for the node's own.
        asked = both.withColumn("was", F.lit(None).cast("long")).union(labels.select("node", "root", "root"))
        told = asked.join(labels.select(F.col("node").alias("b"), "root"), "b")
        step = stage(told.groupBy(F.col("a").alias("node")).agg(F.min("root").alias("root"), F.max("was").alias("was")), "labels")
        labels = step.select("node", "root")
        if step.where("root <> was").isEmpty():
            return labels


def extended(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """`(node, root)` of a graph and further `edges(a, b)` -> those of both: only the edges' roots are joined anew."""
    ends = edges.select("a", "b")
    for c in ("a", "b"):
        ends = ends.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")), c, "left")
    ends = stage(ends.select("a", "b", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb")), "ends")
    moved = components(ends.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).select(F.col("node").alias("was"), F.col("root").alias("now"))
    fresh = ends.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("ra").alias("root")), F.struct(F.col("b").alias("node"), F.col("rb").alias("root")))).alias("x")).select("x.*").distinct()
    every = roots.select("node", "root").union(fresh).distinct()
    return stage(every.join(moved, every["root"] == moved["was"], "left").select("node", F.coalesce("now", "root").alias("root")), "labels")
