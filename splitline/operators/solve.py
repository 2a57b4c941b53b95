"""Two-way effects (ability and difficulty), shrinkage, curve fits and small regressions. Per-row work stays in Spark; only small systems reach the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .store import bucketed, written

#: Numbers of a side's table that are sent to all tasks: 32 MB of them.
SENT = 4_000_000


class Sides:
    """Rows of two keys, laid out once in buckets by one of them, for sums by either key over rows that meet a table by the other.

    No row is moved again: the table of the key with few values (times ``width`` numbers within SENT) is sent to all tasks, the other's comes to the
    buckets. Where neither is small, rows are kept in buckets by both keys and only sums are shuffled. ``sums`` are taken by pair of keys. Rows
    without a key take no part. A hot key's rows are read by one task, in a stream. Sums by the sent key come from fewer tasks than there are
    buckets, as each task gives a row for most of its values: from one a core, more where a task would hold over SENT numbers of the other table or
    over four buckets (a join's tables are held until the task ends).
    """

    def __init__(self, rows: DataFrame, home: str, away: str, width: int = 1, sums: list | None = None):
        self.keys, self.parts = (home, away), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        keyed = rows.where(F.col(home).isNotNull() & F.col(away).isNotNull()).repartition(self.parts, home)
        self.rows = self._laid(keyed.groupBy(home, away).agg(*sums) if sums else keyed, home)
        self.by = {home: self.rows}
        values = self.rows.agg(*[F.approx_count_distinct(k).alias(k) for k in self.keys]).first()
        self.sent = next((k for k in (away, home) if values[k] * width <= SENT), None)
        self.tasks = {k: max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(values[k] * width / max(SENT, 1)), math.ceil(self.parts / 4)) for k in self.keys}
        if self.sent != away:
            self.by[away] = self._laid(self.rows.repartition(self.parts, away), away)

    def _laid(self, rows: DataFrame, key: str) -> DataFrame:
        return bucketed(rows, "sides", key, self.parts)

    def _join(self, rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
        return rows.join(F.broadcast(table) if key == self.sent else table.hint("shuffle_hash"), key)  # a row a key

    def met(self, key: str, table: DataFrame) -> DataFrame:
        """The rows with ``table``, which has a row per ``key``, for sums by the other key."""
        other = self.keys[1 - self.keys.index(key)]
        rows = self._join(self.by[other if key == self.sent else key], table, key)
        return rows.coalesce(self.tasks[key]) if other == self.sent and self.tasks[key] < self.parts else rows

    def met_both(self, tables: dict[str, DataFrame]) -> DataFrame:
        """The rows with a table per key."""
        last = self.sent or self.keys[1]
        first = self.keys[1 - self.keys.index(last)]
        return self._join(self._join(self.by[first], tables[first], first), tables[last], last)


def alternate(df: DataFrame, person: str, cell: str, value: str, rounds: int) -> tuple[DataFrame, DataFrame]:
    """(abilities, difficulties) by alternating means of what the other side leaves, difficulties centred each round."""
    y = F.col(value).cast("double")
    sides = Sides(df.select(person, cell, y.alias("_y")), person, cell, 1, [F.count("*").alias("_k"), F.count("_y").alias("_n"), F.sum("_y").alias("_s")])
    left = lambda c: F.try_divide(F.sum(F.col("_s") - F.col("_n") * F.col(c)), F.sum(F.when(F.col(c).isNotNull(), F.col("_n"))))
    difficulty = sides.rows.select(cell).distinct().withColumn("difficulty", F.lit(0.0))
    ability = None
    for _ in range(rounds):
        ability = sides.met(cell, difficulty).groupBy(person).agg(left("difficulty").alias("ability"))
        raw = written(sides.met(person, ability).groupBy(cell).agg(left("ability").alias("d"), F.sum("_k").alias("n")), "two-way")
        middle = raw.agg((F.sum(F.col("d") * F.col("n")) / F.sum("n")).alias("m"))
        difficulty = raw.crossJoin(F.broadcast(middle)).select(cell, (F.col("d") - F.col("m")).alias("difficulty"))  # one row is broadcast
    return ability, difficulty


def two_way_cg(df: DataFrame, person: str, cell: str, value: str, tol: float = 1e-10, max_iter: int = 200) -> tuple[DataFrame, dict]:
    """Difficulties of y = person + cell + e by conjugate gradients on the normal equations with persons swept out.

    Each product D'MDv is two sums over (person, cell) counts, which lie in buckets (:class:`Sides`) and are not moved; the exact Jacobi
    diagonal is sum over persons of n_pc - n_pc^2 / n_p. Vectors stay DataFrames by cell; scalars come to the driver. Raises where it doesn't settle.
    """
    out = cell
    df = df.select(F.col(person).alias("_person"), F.col(cell).alias("_cell"), F.col(value).cast("double").alias("_y"))
    person, cell, value = "_person", "_cell", "_y"
    pc = Sides(df, person, cell, 1, [F.count("*").alias("n"), F.sum(value).alias("s")])

    def product(v: DataFrame) -> DataFrame:
        mean = pc.met(cell, v).groupBy(person).agg((F.sum(F.col("n") * F.col("p")) / F.sum("n")).alias("_m"))
        return pc.met(person, mean).groupBy(cell).agg(F.sum(F.col("n") * F.col("_m")).alias("_swept"))

    total = pc.rows.groupBy(person).agg(F.sum("n").alias("np"), F.sum("s").alias("sp"))
    start = pc.met(person, total).groupBy(cell).agg(F.sum("n").alias("w"), F.sum(F.col("s") - F.col("n") * F.col("sp") / F.col("np")).alias("r"), F.sum(F.col("n") - F.col("n") * F.col("n") / F.col("np")).alias("diag"))
    state = written(start.select(cell, "w", F.lit(0.0).alias("x"), "r", "diag", F.when(F.col("diag") > 0, F.col("r") / F.col("diag")).otherwise(0.0).alias("p")), "two-way")
    rz = first = state.agg(F.sum(F.col("r") * F.col("p"))).first()[0] or 0.0
    used = 0
    while rz > tol * max(first, 1e-300):
        if used == max_iter or rz > 1e12 * first:
            raise RuntimeError(f"conjugate gradients did not settle: residual {rz / first:.3g} of the first after {used} products")
        q = F.col("w") * F.col("p") - F.col("_swept")
        both = written(state.join(product(state.select(cell, "p")), cell).select(*state.columns, q.alias("q")), "two-way")
        pq = both.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
        if not pq > 0:
            raise RuntimeError("conjugate gradients met a direction without curvature")
        a = rz / pq
        z = F.when(F.col("diag") > 0, F.col("r") / F.col("diag")).otherwise(0.0)
        moved = both.select(cell, "w", (F.col("x") + a * F.col("p")).alias("x"), (F.col("r") - a * F.col("q")).alias("r"), "diag", "p").withColumn("z", z)
        new = moved.agg(F.sum(F.col("r") * F.col("z"))).first()[0]
        state = moved.withColumn("p", F.col("z") + F.lit(new / rz) * F.col("p")).drop("z")
        rz, used = new, used + 1
    gauge = state.agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("g")).first()["g"]
    return state.select(F.col(cell).alias(out), (F.col("x") - F.lit(gauge)).alias("difficulty"), "diag"), {"iterations": used, "relative": rz / first if first else 0.0}


def shrink(difficulty: DataFrame, sigma2: float, tau2: float) -> DataFrame:
    """delta * tau2 / (tau2 + v), v = sigma2 / diag."""
    v = F.lit(sigma2) / F.col("diag")
    return difficulty.withColumn("shrunk", F.when(F.col("diag") > 0, F.col("difficulty") * tau2 / (tau2 + v)).otherwise(0.0))


def edges(df: DataFrame, a: str, b: str, log_ratio: str, floor: float) -> DataFrame:
    """Median log ratio per transition and its standard error max(1.253 sd / sqrt n, floor)."""
    return df.groupBy(a, b).agg(F.percentile(log_ratio, 0.5).alias("edge"), F.greatest(1.253 * F.coalesce(F.stddev(log_ratio), F.lit(0.0)) / F.sqrt(F.count("*")), F.lit(floor)).alias("se"), F.count("*").alias("n"))


def node_potentials(edge_table: DataFrame, a: str, b: str, reference) -> dict:
    """Weighted least-squares potentials of a transition graph; the graph has few nodes (distances, layouts), its table is an aggregate."""
    rows = edge_table.select(a, b, "edge", "se").collect()
    nodes = sorted({r[0] for r in rows} | {r[1] for r in rows} | {reference})
    at = {n: i for i, n in enumerate(nodes)}
    m, y = np.zeros((len(rows) + 1, len(nodes))), np.zeros(len(rows) + 1)
    for i, r in enumerate(rows):
        m[i, at[r[1]]], m[i, at[r[0]]], y[i] = 1 / r[3], -1 / r[3], r[2] / r[3]
    m[-1, at[reference]] = 1e6
    g = np.linalg.lstsq(m, y, rcond=None)[0]
    return dict(zip(nodes, (g - g[at[reference]]).tolist()))


def within_regression(df: DataFrame, person: str, event: str, y: str, xs: list[str], rounds: int = 500, tol: float = 1e-9) -> list[float]:
    """Coefficients of y on xs after sweeping out persons and events by alternating means; the Gram matrix is one aggregate.

    Only persons' and events' effects on each column change from pass to pass; rows lie in buckets (:class:`Sides`). Stops when no person's effect
    moves by more than ``tol`` times the column's spread, which the events' then don't either; raises where ``rounds`` passes don't get there.
    """
    names = [y, *xs]
    sides = Sides(df.select(person, event, *[F.col(c).cast("double").alias(c) for c in names]), event, person, len(names))
    seen = sides.rows.agg(*[F.stddev_pop(c).alias(c) for c in names], *[F.avg(c).alias(f"_{c}") for c in names]).first()
    own = lambda c: F.col(c) - F.lit(seen[f"_{c}"])
    effect = sides.rows.select(person).distinct().select(person, *[F.lit(0.0).alias(f"_p{c}") for c in names])
    for _ in range(rounds):
        events = sides.met(person, effect).groupBy(event).agg(*[F.avg(own(c) - F.col(f"_p{c}")).alias(f"_e{c}") for c in names])
        fresh = sides.met(event, events).groupBy(person).agg(*[F.avg(own(c) - F.col(f"_e{c}")).alias(f"_n{c}") for c in names])
        step = written(effect.join(fresh, person).select(person, *[F.col(f"_n{c}").alias(f"_p{c}") for c in names], *[F.abs(F.col(f"_n{c}") - F.col(f"_p{c}")).alias(c) for c in names]), "within")
        moved = step.agg(*[F.max(c).alias(c) for c in names]).first()
        effect = step.select(person, *[f"_p{c}" for c in names])
        if all((moved[c] or 0.0) <= tol * max(seen[c] or 0.0, 1e-300) for c in names):
            break
    else:
        raise RuntimeError(f"the within regression did not settle in {rounds} passes")
    events = sides.met(person, effect).groupBy(event).agg(*[F.avg(own(c) - F.col(f"_p{c}")).alias(f"_e{c}") for c in names])
    cur = sides.met_both({person: effect, event: events}).select(*[(own(c) - F.col(f"_p{c}") - F.col(f"_e{c}")).alias(c) for c in names])
    pairs = [(a, b) for a in xs for b in names]
    got = cur.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}|{b}") for a, b in pairs]).first()
    gram = np.array([[got[f"{a}|{b}"] for b in xs] for a in xs])
    return np.linalg.lstsq(gram, np.array([got[f"{a}|{y}"] for a in xs]), rcond=None)[0].tolist()


def smooth_people(df: DataFrame, person: str, day: str, value: str, drift: float, noise: float) -> DataFrame:
    """Each row with its person's level that day by a random-walk Kalman filter and smoother.

    Observations of one day are one observation of their mean with noise / n, exactly; so a person's group holds one row
    per day, which the calendar bounds, however many results a hot person has. A row without a day or value has no level.
    """
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_d", ignore_index=True)
        t, z, r = rows["_d"].to_numpy(dtype=float), rows["_z"].to_numpy(), noise / rows["_k"].to_numpy()
        n = len(z)
        m, p, ahead = np.zeros(n), np.zeros(n), np.zeros(n)
        for i in range(n):
            ahead[i] = 1e6 if i == 0 else p[i - 1] + drift * (t[i] - t[i - 1])
            before = z[0] if i == 0 else m[i - 1]
            gain = ahead[i] / (ahead[i] + r[i])
            m[i], p[i] = before + gain * (z[i] - before), (1 - gain) * ahead[i]
        for i in range(n - 2, -1, -1):  # the random walk predicts m[i] for i + 1
            m[i] += p[i] / ahead[i + 1] * (m[i + 1] - m[i])
        return pd.DataFrame({"_p": rows["_p"], "_d": rows["_d"], "level": m})

    own = df.select(person, day, F.col(value).cast("double").alias(value)).where(F.col(day).isNotNull() & F.col(value).isNotNull())
    days = own.groupBy(F.col(person).alias("_p"), F.col(day).alias("_d")).agg(F.avg(value).alias("_z"), F.count("*").alias("_k"))
    kinds = {c: df.schema[c].dataType.simpleString() for c in (person, day)}
    level = days.groupBy("_p").applyInPandas(run, f"_p {kinds[person]}, _d {kinds[day]}, level double")
    return own.join(level, own[person].eqNullSafe(level["_p"]) & (own[day] == level["_d"])).select(person, day, value, "level")


def row_split(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """``held``: a reproducible holdout by the hash of ``key`` (a row's, a race's or a person's id)."""
    return df.withColumn("held", F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(10_000)) < int(share * 10_000))


def gbt_baseline(df: DataFrame, features: list[str], target: str, seed: int = 7) -> DataFrame:
    """Gradient-boosted trees on the rows that aren't held; predictions for all. The rows are checkpointed, partition by partition, as the fit reads
    them several times and draws its splits by a row's place."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    df = df.checkpoint()
    data = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip").transform(df)
    model = GBTRegressor(featuresCol="_x", labelCol=target, maxIter=5, maxDepth=3, seed=seed).fit(data.where("not held"))
    return model.transform(data).drop("_x")
