"""Set operations, recursion and fixed points."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .store import written


#: Rows a task sorts or makes distinct at once.
ROWS = 1_000_000


def tasks_for(spark, rows: int) -> int:
    """Partitions of at most about ROWS rows. Sizes in a shuffle don't tell: keys that compress well make few tasks with many rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))


def _both_ways(edges: DataFrame) -> DataFrame:
    """Every edge once in each direction, written."""
    e = written(edges.select("src", "dst"), "edges")
    parts = tasks_for(e.sparkSession, 2 * e.count())
    return written(e.union(e.select("dst", "src")).repartition(parts, "src", "dst").distinct(), "edges")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component), the smallest id of each vertex's component, over undirected edges (src, dst).

    Each round merges every vertex into the one of least hash among itself and its neighbours, with a new hash every
    round, so the graph shrinks by a constant factor in expectation whatever its shape; a path of n vertices takes
    about log n rounds. Raises if ``rounds`` don't settle it. Rounds are written and read back: a checkpoint keeps its plan's
    constraints, which multiply over the rounds' joins.
    """
    e = _both_ways(edges.where("src <> dst"))
    labels = e.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id"))
    for i in range(rounds):
        if e.isEmpty():
            least = labels.groupBy("label").agg(F.min("id").alias("component"))
            return labels.join(least, "label").select("id", "component")
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(i)).alias("h"), F.col(c).alias("v"))
        near = e.groupBy("src").agg(F.min(rank("dst")).alias("n"))
        to = written(near.select(F.col("src").alias("v"), F.least(rank("src"), F.col("n"))["v"].alias("to")), "component-to")
        labels = written(labels.join(to, labels["label"] == to["v"], "left").select("id", F.coalesce("to", "label").alias("label")), "component-labels")
        moved = e.join(to, e["src"] == to["v"]).select(F.col("to").alias("src"), "dst")
        e = written(moved.join(to, moved["dst"] == to["v"]).select("src", F.col("to").alias("dst")).where("src <> dst").distinct(), "component-edges")
    raise RuntimeError("components did not settle")


def propagate(edges: DataFrame, seeds: DataFrame, share: float, rounds: int) -> DataFrame:
    """(id, label): unlabelled vertices take the label that ``share`` of their labelled neighbours have (ties: none), in rounds."""
    both = _both_ways(edges)
    labels = seeds.select("id", "label")
    for _ in range(rounds):
        votes = both.join(labels, both["dst"] == labels["id"]).groupBy("src", "label").agg(F.count("*").alias("v"))
        top = votes.groupBy("src").agg(F.max_by("label", F.struct("v", "label")).alias("label"), F.max("v").alias("v"), F.sum("v").alias("n"))
        fresh = top.where(F.col("v") > share * F.col("n")).join(labels, top["src"] == labels["id"], "left_anti").select(F.col("src").alias("id"), "label")
        labels = labels.unionByName(fresh).checkpoint()
    return labels


def commit_unanimous(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``labels`` with the unlabelled vertices whose labelled neighbours all agree."""
    both = _both_ways(edges)
    heard = both.join(labels, both["dst"] == labels["id"]).groupBy("src").agg(F.min("label").alias("label"), F.max("label").alias("_other")).where("label = _other")
    fresh = heard.join(labels, heard["src"] == labels["id"], "left_anti").select(F.col("src").alias("id"), "label")
    return labels.unionByName(fresh)


def informative(df: DataFrame, group: str, cell: str, least_rows: int = 2, least_degree: int = 2, rounds: int = 100) -> DataFrame:
    """Peel rows until every group has ``least_rows`` rows and every cell ``least_degree`` groups; raises if ``rounds`` don't settle it."""
    rows = df.select(group, cell).checkpoint()
    n = rows.count()
    for _ in range(rounds):
        groups = rows.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") >= least_rows).select(group)
        cells = rows.groupBy(cell).agg(F.count_distinct(group).alias("_n")).where(F.col("_n") >= least_degree).select(cell)
        rows = rows.join(groups, group, "left_semi").join(cells, cell, "left_semi").checkpoint()
        m = rows.count()
        if m == n:
            return rows
        n = m
    raise RuntimeError("the peel did not settle")
