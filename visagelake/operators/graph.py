"""Connected components of large edge lists by contraction."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visagelake.operators import tables


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of edges (a, b), the component being its smallest node.

    Each round maps every node to the least of itself and its neighbours, follows that map once more, and contracts
    the edges; rounds grow with the logarithm of the longest path, and tables are written between them.
    """
    left = tables.save(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    total = None
    while total is None or not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to"))
        near = tables.save(near, "near")
        step = near.join(near.select(F.col("node").alias("to"), F.col("to").alias("further")), "to").select("node", F.col("further").alias("to"))
        step = tables.save(step, "step")
        if total is None:
            total = step.withColumnRenamed("to", "component")
        else:
            moved = total.join(step.select(F.col("node").alias("component"), "to"), "component", "left")
            total = tables.save(moved.select("node", F.coalesce("to", "component").alias("component")), "total")
        tables.drop(near)
        last = left
        ends = left.join(step.withColumnsRenamed({"node": "a", "to": "x"}), "a").join(step.withColumnsRenamed({"node": "b", "to": "y"}), "b")
        left = tables.save(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        tables.drop(last)
    return total
