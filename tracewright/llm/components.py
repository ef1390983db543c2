"""Connected components of an edge table, by minimum labels and pointer jumping.

Every round is a few joins and combinable aggregations over the edges; labels are written
to the shared folder each round, so the plan stays short and survives lost executors.
Nothing is collected but counts. Rounds grow with the logarithm of the longest path, as
labels jump to their label's label. A node with very many edges and a label of very many
nodes are looked up without a shuffle (see ``lookup``), so no task gets all of a star.

Defined cases: edges may be repeated, in either direction, or lead from a node to itself
(which is ignored); a null end is an error of the caller; no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, materialize, release


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for each end of ``edges(a, b)``; a component is its least node."""
    spark = edges.sparkSession
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both, edge_path = materialize(both.where("a != b").distinct(), "edges")
    labels, path = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    for _ in range(max_rounds):
        near = lookup(both, labels.withColumnRenamed("node", "b"), ["b"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        new, near_path = materialize(labels.join(near, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("old")), "near")
        up = new.select(F.col("node").alias("component"), F.col("component").alias("up"))
        jumped = lookup(new, up, ["component"], "left").select("node", F.least("component", F.coalesce("up", "component")).alias("component"), "old")
        done, new_path = materialize(jumped, "labels")
        release(spark, path, near_path)
        path, labels = new_path, done.select("node", "component")
        if done.where("component < old").isEmpty():
            break
    else:
        raise RuntimeError(f"labels still change after {max_rounds} rounds")
    release(spark, edge_path)
    return labels
