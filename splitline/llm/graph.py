"""Connected components on DataFrames: minimum labels along edges, with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialize


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (src > dst) with the same components: every vertex keeps its smallest neighbour, which takes over its other neighbours.

    Vertices that share their neighbours, such as a group's copies, come down to one edge each.
    """
    e = materialize(edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src <> dst").distinct(), "edges")
    least = e.groupBy(F.col("src").alias("v")).agg(F.min("dst").alias("m"))
    over = e.join(least, e["src"] == least["v"]).where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return least.select(F.col("v").alias("src"), F.col("m").alias("dst")).unionByName(over.distinct())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id of each vertex's component. ``edges``: (src long, dst long), in either direction.

    A round takes the smallest label among a vertex and its neighbours, then the
    label of that label, so that long chains shorten by about half a round. Every
    round is written to the shared folder. Stops when no label changes.
    """
    edges = contracted(contracted(edges))
    both = materialize(edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct(), "edges")
    labels = materialize(both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("m")).select("id", F.least("id", "m").alias("component")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels, both["dst"] == labels["id"]).groupBy("src").agg(F.min("component").alias("m"))
        step = labels.join(near, labels["id"] == near["src"]).select("id", F.least("component", "m").alias("component"), F.col("component").alias("old"))
        step = materialize(step, "labels")
        up = step.select(F.col("id").alias("component"), F.col("component").alias("up"))
        # a label is itself a vertex, so its own label is at most itself
        jumped = materialize(step.join(up, "component", "left").select("id", F.least("component", "up").alias("component"), "old"), "labels")
        labels = jumped.select("id", "component")
        if not jumped.where("component <> old").limit(1).count():
            return labels
    raise RuntimeError("components did not settle")
