"""Connected components of a graph given as a table of edges."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """node and component, the least node that links lead to; edges have longs a and b, in any direction.

    Each round gives every node the least label among itself and its neighbours, then the label of that label, and
    ends when no label changes; stars and short chains need few rounds. Hubs are met by partial aggregation. No edges
    give no rows.
    """
    both = checkpointed(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        least = labels.join(near, labels["node"] == near["a"]).select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        of_label = labels.select(F.col("node").alias("label"), F.col("component").alias("further"))
        labels = checkpointed(least.join(of_label, F.col("component") == F.col("label"), "left").select(
            "node", "old", F.least("component", "further").alias("component")))
        if labels.where("old <> component").isEmpty():
            return labels.select("node", "component")
        labels = labels.select("node", "component")
