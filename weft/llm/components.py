"""Connected components of an edge list, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of each node that an edge names; the label is the component's least node.

    Each round every node takes the least label among its own and its neighbours', then its label's
    label, so that distances halve; the labels are written to the shared folder, which cuts lineage.
    Nodes are longs. Labels only ever fall, so the loop ends; on an empty edge list it gives no rows.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    both = stored(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "cc-edges")
    labels = stored(both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("node"), F.least("x", "y").alias("label")), "cc-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), "label"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = stored(low.join(jump, "label", "left").select("node", "old", F.least("label", "further").alias("label")), "cc-labels")
        changed = new.where("label <> old").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
