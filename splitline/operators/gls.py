"""Course difficulties by generalised least squares: a person's level wanders from day to day, and the solve weighs rows by that.

y = difficulty of the cell + level of the person that day + noise, the level a random walk with a free start. The inverse covariance of a
person's rows times a vector is the vector less its smoothed level, over the noise: so each product of the conjugate gradients runs the Kalman
smoother over every person once, on the vector instead of on the results, and no covariance is built. Ridge ``noise / prior`` holds the cells.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .store import written


def _surprise(t: np.ndarray, z: np.ndarray, k: np.ndarray, drift: float, noise: float) -> np.ndarray:
    """Day means ``z`` (of ``k`` rows) less their smoothed level, times k: tridiagonal elimination of the walk's and the rows' precision."""
    n = len(t)
    if n == 1 or drift <= 0:
        return k * (z - (k @ z) / k.sum())
    walk = 1 / (drift * np.diff(t))
    diagonal = k / noise + np.append(walk, 0) + np.append(0, walk)
    right = (k * z / noise).copy()
    for i in range(1, n):  # over one person's days, which the calendar bounds
        f = walk[i - 1] / diagonal[i - 1]
        diagonal[i] -= f * walk[i - 1]
        right[i] += f * right[i - 1]
    level = np.empty(n)
    level[-1] = right[-1] / diagonal[-1]
    for i in range(n - 2, -1, -1):
        level[i] = (right[i] + walk[i] * level[i + 1]) / diagonal[i]
    return k * (z - level)


def _whitened(days: DataFrame, drift: float, noise: float) -> DataFrame:
    """(person, day, s, k) from (person, day, z, k): the mean of a day's rows times the inverse covariance, in units of 1 / noise."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("day", ignore_index=True)
        k = rows["k"].to_numpy(dtype=float)
        s = _surprise(rows["day"].to_numpy(dtype=float), rows["z"].to_numpy(), k, drift, noise)
        return pd.DataFrame({"person": rows["person"], "day": rows["day"], "level": rows["z"].to_numpy() - s / k})

    kind = dict(days.dtypes)
    return days.groupBy("person").applyInPandas(run, f"person {kind['person']}, day {kind['day']}, level double")


def gls_cells(df: DataFrame, person: str, cell: str, day: str, y: str, drift: float, noise: float, prior: float, tol: float = 1e-8, most: int = 200) -> tuple[DataFrame, dict]:
    """(cell, difficulty), info. Rows without a person, cell, day or value take no part; ``day`` is a number. Raises where the solve doesn't settle."""
    rows = df.select(F.col(person).alias("person"), F.col(cell).alias("cell"), F.col(day).alias("day"), F.col(y).cast("double").alias("y")).dropna()
    spots = written(rows.groupBy("person", "day", "cell").agg(F.count("*").cast("double").alias("n"), F.avg("y").alias("y")), "gls-spots")  # a person's rows of one day and cell are one

    def times(v: DataFrame) -> DataFrame:
        """(cell, q) from (person, day, cell, n, v): cells' sums of the inverse covariance (times noise) applied to v."""
        v = written(v, "gls-vector")
        level = _whitened(v.groupBy("person", "day").agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("z"), F.sum("n").alias("k")), drift, noise)
        return v.join(level, ["person", "day"]).groupBy("cell").agg(F.sum(F.col("n") * (F.col("v") - F.col("level"))).alias("q"))

    ridge = noise / prior
    right = times(spots.withColumnRenamed("y", "v")).join(spots.groupBy("cell").agg(F.sum("n").alias("w")), "cell")
    state = written(right.select("cell", F.lit(0.0).alias("x"), F.col("q").alias("r"), (F.col("q") / (F.col("w") + ridge)).alias("p"), (F.col("w") + ridge).alias("diagonal")), "gls-state")
    rz = first = state.agg(F.sum(F.col("r") * F.col("p"))).first()[0] or 0.0
    used = 0
    while first and rz > tol * tol * first:
        if used == most or rz > 1e12 * first:
            raise RuntimeError(f"generalised least squares did not settle: residual {rz / first:.3g} of the first after {used} products")
        step = written(state.join(times(spots.join(state.select("cell", F.col("p").alias("v")), "cell").select("person", "day", "cell", "n", "v")), "cell").withColumn("q", F.col("q") + ridge * F.col("p")), "gls-step")
        a = rz / step.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
        moved = step.select("cell", (F.col("x") + a * F.col("p")).alias("x"), (F.col("r") - a * F.col("q")).alias("r"), "p", "diagonal")
        new = moved.agg(F.sum(F.col("r") * F.col("r") / F.col("diagonal"))).first()[0]
        state, rz, used = moved.withColumn("p", F.col("r") / F.col("diagonal") + F.lit(new / rz) * F.col("p")), new, used + 1
    return written(state.select("cell", F.col("x").alias("difficulty")), "gls-cells"), {"products": used}
