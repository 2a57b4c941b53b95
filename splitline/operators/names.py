"""Fuzzy names by an inverted index of trigrams: similarity joins and searches without all pairs.

A name is lower-cased and padded, and is the set of its three-letter pieces; two names are as alike as their sets' Jaccard similarity. Pieces
are ordered by how many names hold them, rarest first. Two names of similarity t or more must share a piece among their first
n - ceil(t * n) + 1 pieces, so only those are indexed, and their numbers of pieces lie within a factor t of each other. Candidates that meet
in the index are compared exactly. Equal names are one entry, so copies cost nothing; pieces that most names hold come last and are hardly
ever indexed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import written


def trigrams(name: Column) -> Column:
    """The distinct three-letter pieces of a name with two spaces before and one behind it."""
    padded = F.concat(F.lit("  "), F.lower(name), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3))))


def trigram_sets(df: DataFrame, name: str) -> DataFrame:
    """(name, grams, n) of every different name, lower-cased; null and empty names have none and are left out."""
    names = df.select(F.lower(F.col(name)).alias("name")).where("name <> ''").distinct()
    return names.withColumn("grams", trigrams(F.col("name"))).withColumn("n", F.size("grams"))


def _prefixes(sets: DataFrame, often: DataFrame, threshold: float) -> DataFrame:
    """(name, n, gram): the index's entries."""
    one = sets.select("name", "n", F.explode("grams").alias("gram")).join(often, "gram", "left")
    ordered = one.groupBy("name", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "gram"))).alias("o"))  # a name's own pieces
    first = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9).cast("int") + 1
    return ordered.select("name", "n", F.explode(F.slice("o", F.lit(1), first)).alias("g")).select("name", "n", "g.gram")


def _compared(left: DataFrame, right: DataFrame, threshold: float, same: bool) -> DataFrame:
    """(a, b, similarity) of the pairs of ``left`` and ``right`` that reach the threshold; of one table with itself, a < b."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    left = written(left, "names")
    right = left if same else written(right, "names")
    often = right.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("often"))
    x = _prefixes(left, often, threshold).select(F.col("name").alias("a"), F.col("n").alias("na"), "gram")
    y = _prefixes(right, often, threshold).select(F.col("name").alias("b"), F.col("n").alias("nb"), "gram")
    close = (F.col("nb") >= threshold * F.col("na") - 1e-9) & (F.col("na") >= threshold * F.col("nb") - 1e-9)
    met = x.join(y, "gram").where(close & (F.col("a") < F.col("b")) if same else close).select("a", "b").distinct()
    grams = lambda t, name, g: t.select(F.col("name").alias(name), F.col("grams").alias(g))
    both = met.join(grams(left, "a", "ga"), "a").join(grams(right, "b", "gb"), "b")
    shared = F.size(F.array_intersect("ga", "gb"))
    return both.select("a", "b", (shared / (F.size("ga") + F.size("gb") - shared)).alias("similarity")).where(F.col("similarity") >= threshold)


def alike(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of all pairs of different names, a < b, whose similarity is at least ``threshold``."""
    return _compared(sets, sets, threshold, True)


def search(queries: DataFrame, sets: DataFrame, threshold: float, k: int) -> DataFrame:
    """(query, found, similarity, rank) of each query's ``k`` most alike names of at least ``threshold``, ties by name."""
    got = _compared(queries, sets, threshold, False)
    order = Window.partitionBy("a").orderBy(F.desc("similarity"), "b")
    return got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("a").alias("query"), F.col("b").alias("found"), "similarity", "rank")
