"""Merges of identities by votes with pairs that must stay apart, and ids that stay the same over reruns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .ranks import numbered
from .store import written


def _between(pairs: DataFrame, label: DataFrame, more: list) -> DataFrame:
    """Pairs (a, b, ...) as pairs of different classes (x < y), with the aggregates ``more``."""
    la, lb = label.select(F.col("id").alias("a"), F.col("class").alias("ca")), label.select(F.col("id").alias("b"), F.col("class").alias("cb"))
    both = pairs.join(la, "a").join(lb, "b").where("ca <> cb")
    return both.groupBy(F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y")).agg(*more)


def merge_classes(ids: DataFrame, votes: DataFrame, apart: DataFrame, least: float, most: int = 100) -> DataFrame:
    """(id, class): ids merged by ``votes`` (a, b, votes), strongest first, so that no class holds a pair of ``apart`` (a, b); a class is named by its
    smallest id.

    A round lifts votes to pairs of classes and drops pairs that are forbidden or have under ``least`` votes. Every class then names the neighbour
    with the most votes (ties to the smallest pair of names), and classes that name each other merge. As only two classes merge at a time, checking the
    pair is enough. The strongest pair always merges, so rounds end; more than ``most`` of them are an error. Ids of one place merge wherever
    they lie: nothing is gathered in one task.
    """
    label = written(ids.select("id").distinct().withColumn("class", F.col("id")), "merge-classes")
    votes = votes.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("votes").alias("votes"))
    votes, apart = written(votes, "merge-votes"), written(apart.select("a", "b"), "merge-apart")
    for _ in range(most):
        edges = _between(votes, label, [F.sum("votes").alias("votes")]).where(F.col("votes") >= least)
        allowed = written(edges.join(_between(apart, label, [F.count("*").alias("n")]), ["x", "y"], "left_anti"), "merge-allowed")
        ends = allowed.select(F.col("x").alias("me"), F.col("y").alias("other"), "votes", "x", "y").unionByName(allowed.select(F.col("y").alias("me"), F.col("x").alias("other"), "votes", "x", "y"))
        best = ends.groupBy("me").agg(F.min_by("other", F.struct(-F.col("votes"), "x", "y")).alias("other"))
        mutual = best.join(best.select(F.col("me").alias("other"), F.col("other").alias("_back")), "other").where("_back = me AND me > other")
        moved = written(mutual.select(F.col("me").alias("class"), F.col("other").alias("into")), "merge-moved")
        if moved.isEmpty():
            return label
        label = written(label.join(moved, "class", "left").select("id", F.coalesce("into", "class").alias("class")), "merge-classes")
    raise RuntimeError(f"merges did not end in {most} rounds")


def keep_ids(classes: DataFrame, before: DataFrame | None) -> DataFrame:
    """(id, stable): a stable number for each class of ``classes`` (id, class), given the mapping ``before`` (id, stable) of an earlier run.

    A class keeps the number that most of its members had, and a number goes to the class that has most of its old members (ties to the smaller
    number and class). Classes that get none are numbered on from the largest, in the order of their names. A class whose number went elsewhere
    is new, even if its members are old.
    """
    if before is None:
        before = classes.sparkSession.createDataFrame([], "id long, stable long")
    shared = classes.join(before, "id").groupBy("class", "stable").agg(F.count("*").alias("n"))
    mine = shared.withColumn("_k", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("n"), "stable"))).where("_k = 1")
    won = written(mine.withColumn("_k", F.row_number().over(Window.partitionBy("stable").orderBy(F.desc("n"), "class"))).where("_k = 1").select("class", "stable"), "stable-won")
    top = before.agg(F.coalesce(F.max("stable"), F.lit(0)).cast("long").alias("_top"))
    fresh = numbered(classes.select("class").distinct().join(won, "class", "left_anti"), [F.col("class")], "_new").crossJoin(F.broadcast(top))  # one row
    return classes.join(won.unionByName(fresh.select("class", (F.col("_top") + F.col("_new")).alias("stable"))), "class").select("id", "stable")
