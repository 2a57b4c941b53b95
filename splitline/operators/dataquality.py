"""Duplicate rules, robust neighbour outliers, whole-race shifts, impossible races, expectation checks."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import stats
from .joins import nearest_by_day


def same_day_twins(df: DataFrame, key: str, day: str, cell: str, value: str, order: str, tolerance: float) -> DataFrame:
    """Rows with an earlier-numbered row of the same key, day and cell within ``tolerance``: rows meet only in neighbouring bands of the value."""
    band = F.floor(F.col(value) / tolerance)
    keep = df.select(F.col(key).alias("_k"), F.col(day).alias("_d"), F.col(cell).alias("_c"), F.col(value).alias("_v"), F.col(order).alias("_o"), F.explode(F.array(band - 1, band, band + 1)).alias("_b"))
    mine = df.withColumn("_band", band)
    same = (mine[key] == keep["_k"]) & (mine[day] == keep["_d"]) & (mine["_band"] == keep["_b"]) & mine[cell].eqNullSafe(keep["_c"])
    return mine.join(keep, same & (F.abs(mine[value] - keep["_v"]) < tolerance) & (keep["_o"] < mine[order]), "left_semi").drop("_band")


def neighbour_z(df: DataFrame, key: str, day: str, order: str, value: str, k: int, floor: float, least: int = 3) -> DataFrame:
    """z of a row against its k nearest rows in time: (value - median) / max(1.4826 MAD, floor); null with fewer than ``least``."""
    near = nearest_by_day(df, key, day, order, value, k)
    z = lambda s: F.when(F.size(s) >= least, F.try_divide(F.col(value) - stats.median_of(s), F.greatest(stats.mad(s), F.lit(floor))))
    return near.withColumn("z", stats.let(F.array_sort("near"), z))


def fdr_cut(z: DataFrame, fit_low: float = 2.0, fit_high: float = 4.0, low: float = 5.0, high: float = 15.0, rate: float = 0.01) -> float:
    """The smallest cut on a quarter grid at which an exponential tail fitted on [fit_low, fit_high) explains at most ``rate`` of what is seen,
    or past which nothing is seen; ``high`` where there is no such cut or the tail doesn't fall."""
    middle = (fit_low + fit_high) / 2
    grid = [low + 0.25 * i for i in range(int((high - low) * 4) + 1)]
    a = F.abs(F.col("z"))
    seen = z.agg(F.count_if((a >= fit_low) & (a < middle)).alias("n1"), F.count_if((a >= middle) & (a < fit_high)).alias("n2"), *[F.count_if(a >= c).alias(f"g{i}") for i, c in enumerate(grid)]).first()
    if not seen["n1"] or not seen["n2"] or seen["n2"] >= seen["n1"]:
        return high
    slope = math.log(seen["n1"] / seen["n2"]) / (middle - fit_low)
    scale = seen["n1"] * slope / (math.exp(-slope * fit_low) - math.exp(-slope * middle))
    for i, c in enumerate(grid):
        if not seen[f"g{i}"] or scale / slope * math.exp(-slope * c) <= rate * seen[f"g{i}"]:
            return c
    return high


def race_shift(df: DataFrame, race: str, gap: str, between: float, within: float, least: int, alpha: float = 0.05, side: float = 2 / 3, cut: float | None = None) -> DataFrame:
    """Races with z of their median gap and ``shifted``: z beyond ``cut`` (by default the Bonferroni quantile at ``alpha``), and ``side`` of the runners on that side."""
    stat = df.groupBy(race).agg(F.percentile(gap, 0.5).alias("shift"), F.count("*").alias("n"), F.avg((F.col(gap) > 0).cast("double")).alias("above")).where(F.col("n") >= least)
    if cut is None:
        cut = NormalDist().inv_cdf(1 - alpha / max(1, stat.count()))
    z = F.col("shift") / F.sqrt(F.lit(between**2) + F.lit(math.pi / 2 * within**2) / F.col("n"))
    mostly = F.when(F.col("shift") > 0, F.col("above")).otherwise(1 - F.col("above")) >= side
    return stat.withColumn("z", z).withColumn("shifted", (F.abs("z") > cut) & mostly)


def impossible(df: DataFrame, race: str, value: str, ceiling: float, exempt: str) -> DataFrame:
    """Rows of races in which anyone not exempt passes ``ceiling``."""
    bad = F.max(((F.col(value) > ceiling) & ~F.col(exempt)).cast("int")).over(Window.partitionBy(race)) == 1
    return df.withColumn("_bad", bad).where("_bad").drop("_bad")


def field_check(df: DataFrame, race: str, earlier: str, later: str, value: str, least: int, floor: float, cap: float) -> DataFrame:
    """Races whose runners do better than both their earlier and their later means: median gaps over ``floor``, capped."""
    gap = lambda c: F.percentile(F.col(value) - F.col(c), 0.5)
    g = df.groupBy(race).agg(gap(earlier).alias("to_earlier"), gap(later).alias("to_later"), F.count(earlier).alias("n_e"), F.count(later).alias("n_l"))
    ok = (F.col("n_e") >= least) & (F.col("n_l") >= least) & (F.col("to_earlier") > floor) & (F.col("to_later") > floor)
    return g.withColumn("deflate", F.when(ok, F.least(F.lit(cap), F.least("to_earlier", "to_later"))).otherwise(0.0))


def census(df: DataFrame, reasons: list[tuple[str, object]]) -> DataFrame:
    """Counts by the first reason whose predicate holds, 'kept' for none."""
    label = None
    for name, predicate in reasons:
        label = F.when(predicate, name) if label is None else label.when(predicate, name)
    return df.groupBy(label.otherwise("kept").alias("reason")).agg(F.count("*").alias("n"))


def expectations(df: DataFrame, checks: dict[str, object]) -> DataFrame:
    """One row per check with its number of violating rows."""
    counts = df.agg(*[F.count_if(~F.coalesce(p, F.lit(False))).alias(n) for n, p in checks.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("violations")) for n in checks])).alias("c")).select("c.*")
