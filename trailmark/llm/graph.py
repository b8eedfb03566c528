"""Connected components of an edge table by smallest-label joins with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(row, component) for every row that an edge names; component is the smallest row reached.

    Each round takes the smallest label among a row and its neighbours, then the label of that label.
    Rounds end when no label falls; every round is written to the shared folder.
    """
    pairs = edges.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).where("x < y").distinct()
    pairs = save(pairs, "cc-edges")
    labels = save(
        pairs.select(F.col("y").alias("row"), F.col("x").alias("component")).union(pairs.select(F.col("x").alias("row"), F.col("x").alias("component"))).groupBy("row").agg(F.min("component").alias("component")),
        "cc-labels",
    )
    while True:
        at = labels.select(F.col("row").alias("x"), F.col("component").alias("lx"))
        bt = labels.select(F.col("row").alias("y"), F.col("component").alias("ly"))
        seen = pairs.join(at, "x").join(bt, "y").where("lx <> ly")
        # The label of the larger root falls to the smaller one, then rows follow their root.
        falls = save(seen.select(F.greatest("lx", "ly").alias("root"), F.least("lx", "ly").alias("to")).groupBy("root").agg(F.min("to").alias("to")), "cc-falls")
        if falls.isEmpty():
            return labels
        moved = labels.join(falls.withColumnRenamed("root", "component"), "component", "left").select("row", F.coalesce("to", "component").alias("component"))
        jump = moved.select(F.col("row").alias("component"), F.col("component").alias("next"))
        labels = save(moved.join(jump, "component", "left").select("row", F.coalesce("next", "component").alias("component")), "cc-labels")
