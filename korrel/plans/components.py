"""Connected components by hooking and pointer jumping, each step a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korrel.plans.scratch import stored


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node that an edge touches; component is the smallest node it reaches.

    Each round hooks every component to its smallest neighbour, follows those pointers to their roots by doubling,
    and renames the edges, so components at least halve: rounds grow with the logarithm of the longest path. Edges
    with a null end are ignored; loops give their node itself. Nothing is collected but counts.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna()
    both = stored(ends.union(ends.select("b", "a")).distinct(), "edges")
    labels = both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node"))
    current = both.filter("a <> b")
    while True:
        up = current.groupBy(F.col("a").alias("from")).agg(F.min("b").alias("least")).select("from", F.least("from", "least").alias("to"))
        up = stored(up, "pointers")
        if up.isEmpty():
            return labels
        while True:
            above = up.select(F.col("from").alias("to"), F.col("to").alias("next"))
            jumped = stored(up.join(above, "to").select("from", "to", "next"), "pointers")
            up = jumped.select("from", F.col("next").alias("to"))
            if jumped.filter("to <> next").isEmpty():
                break
        to = up.withColumnRenamed("to", "root")
        labels = stored(labels.join(to, labels.component == to["from"], "left").select("node", F.coalesce("root", "component").alias("component")), "labels")
        x, y = up.select(F.col("from").alias("a"), F.col("to").alias("ra")), up.select(F.col("from").alias("b"), F.col("to").alias("rb"))
        current = stored(current.join(x, "a").join(y, "b").filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "edges")
