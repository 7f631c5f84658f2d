"""Connected components of a graph given as an edge table.

Parent pointers are hooked to smaller neighbours and shortened by pointer jumping, which
needs a logarithmic number of rounds. Each round is joins and map-side combined minima,
written as a table in the shared folder; the driver sees one count per round. Labels only
fall, so the rounds end when nothing moved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewave.session import stored_table


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node id it contains.

    ``nodes`` has ``node``; ``edges`` has ``a`` and ``b``, in either direction.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored_table(both.where("a <> b").distinct(), "component-edges")
    lowest = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
    state = stored_table(nodes.select("node").join(lowest, "node", "left").select(
        "node", F.least("node", F.coalesce("low", "node")).alias("parent")), "component-parents")
    moved = 1
    while moved:
        grand = state.alias("s").join(
            state.select(F.col("node").alias("parent"), F.col("parent").alias("grand")), "parent"
        ).select("node", "parent", "grand")
        # smallest grandparent among the neighbours of each node
        near = both.join(grand.select(F.col("node").alias("b"), "grand"), "b").groupBy("a").agg(
            F.min("grand").alias("near"))
        seen = grand.join(near.withColumnRenamed("a", "node"), "node", "left").withColumn(
            "low", F.least("grand", "near", "parent"))
        # offer it to the node itself and to its parent
        offers = seen.select(F.col("node"), "low").unionByName(
            seen.select(F.col("parent").alias("node"), "low")).groupBy("node").agg(F.min("low").alias("low"))
        updated = state.select("node", "parent").join(offers, "node").select(
            "node", F.least("parent", "low").alias("parent"), (F.col("low") < F.col("parent")).alias("moved"))
        state = stored_table(updated, "component-parents")
        moved = state.where("moved").count()
    return state.select("node", F.col("parent").alias("component"))
