"""Boosted trees on a rank loss: pairwise order within a race, learned from listwise gradients by running sums.

The loss of a race is the Plackett-Luce likelihood of its finishing order: the winner is drawn by exp(score), then the next of the rest.
A runner's gradient is 1 - exp(s) * (sum over places down to its own of 1 / (sum of exp(s) of those still in)), which is the sum of what
every pair with it pulls, but needs two running sums a race instead of its pairs. A round fits one regression tree to the gradients.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, functions as F

from .ranks import Ordered


def gradients(laid: Ordered, rows: DataFrame, race: str, score: str) -> DataFrame:
    """``rows`` of the layout by (race, place) with ``gradient``, of the likelihood of their order by ``score``. Races run over range partitions."""
    scaled = laid.whole(rows, {"_top": (F.max, F.col(score))}).withColumn("_e", F.exp(F.greatest(F.col(score) - F.col("_top"), F.lit(-700.0)))).drop("_top")
    left = laid.running(scaled, {"_in": F.col("_e")}, reverse=True)  # those still in at each place
    pulled = laid.running(left, {"_pull": 1 / F.col("_in")})
    return pulled.withColumn("gradient", 1 - F.col("_e") * F.col("_pull")).drop("_e", "_in", "_pull")


class RankTrees:
    """A sum of trees; larger scores finish earlier."""

    def __init__(self, features: list[str], trees: list, rate: float):
        self.features, self.trees, self.rate = features, trees, rate

    def transform(self, df: DataFrame, score: str = "score") -> DataFrame:
        out = _vectors(df, self.features)
        total: Column = F.lit(0.0)
        for i, tree in enumerate(self.trees):
            out = tree.setPredictionCol(f"_t{i}").transform(out)
            total = total + F.lit(self.rate) * F.col(f"_t{i}")
        return out.withColumn(score, total).drop("_x", *[f"_t{i}" for i in range(len(self.trees))])


def _vectors(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip").transform(df)


def fit(df: DataFrame, race: str, place: list[str], features: list[str], rounds: int = 10, depth: int = 3, rate: float = 0.5, seed: int = 7) -> RankTrees:
    """Trees for rows of races in the order ``place`` (best first, ending in a unique key). Rows with a null feature take no part."""
    laid = Ordered(df.select(race, *place, *features).dropna(subset=[race, *features]).withColumn("_score", F.lit(0.0)), [race], place)
    rows, trees = laid.rows, []
    for k in range(rounds):
        pulled = laid.kept(gradients(laid, rows, race, "_score"))
        tree = DecisionTreeRegressor(featuresCol="_x", labelCol="gradient", predictionCol="_p", maxDepth=depth, seed=seed + k).fit(_vectors(pulled, features))
        trees.append(tree)
        rows = tree.transform(_vectors(pulled, features)).withColumn("_score", F.col("_score") + rate * F.col("_p")).drop("_x", "_p", "gradient")
    return RankTrees(features, trees, rate)
