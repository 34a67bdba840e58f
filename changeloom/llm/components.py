"""Connected components of an edge table, by joins and reliable intermediate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.sources.shared import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of the edges (a, b); the component is its smallest node.

    In a round every node takes the least node around it, then that node's choice; the edges are
    then drawn between choices, so few are left after the first rounds. Nothing but one flag per
    round reaches the driver.
    """
    left = materialize(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct(), "edges")
    ends = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
    result = ends.withColumn("component", F.col("node"))
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        choice = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("near"))
        choice = materialize(choice, "choices")
        further = choice.select(F.col("node").alias("near"), F.col("near").alias("far"))
        label = materialize(choice.join(further, "near").select("node", "far"), "labels")
        named = label.select(F.col("node").alias("component"), "far")
        result = materialize(
            result.join(named, "component", "left").select("node", F.coalesce("far", "component").alias("component")), "components"
        )
        starts = label.select(F.col("node").alias("a"), F.col("far").alias("to_a"))
        stops = label.select(F.col("node").alias("b"), F.col("far").alias("to_b"))
        left = materialize(
            left.join(starts, "a").join(stops, "b").where("to_a <> to_b")
            .select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges",
        )
    return result
