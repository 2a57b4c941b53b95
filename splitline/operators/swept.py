"""A joint solve in which every race lies within one course: races, courses and curve are swept out exactly, conjugate gradients find the persons' effects.

y = ability + side * loading + race + curve + noise, races varying around their courses. Given the rest, a course and its races are a star, whose
penalised means are two sums: by race and by course. Rows lie in buckets by course, so both are windows over rows that aren't moved; the persons'
vector is sent to all tasks while it is small (SENT), and only sums by person are shuffled. The curve has few unknowns: each person's part in them
is kept beside the person's sums, and its small matrix comes to the driver. Persons and stars hardly overlap, so few products are needed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .solve import SENT
from .store import bucketed, written


class Rows:
    """Rows (person, cell, race, y, s, h0, h1 ...) in buckets by cell; ``sound`` where no key is null and no race lies in two cells.

    k: the race's number within its cell; dr: its rows and ``tie`` (the ridge of race less course); dc: what is left of the course's diagonal once its
    races are swept out.
    """

    def __init__(self, df: DataFrame, person: Column, cell: Column, race: Column, y: Column, side: Column, hats: list[Column], tie: float, ridge: float):
        self.hats, self.tie, self.ridge = [f"h{i}" for i in range(len(hats))], float(tie), float(ridge)
        self.spark, self.parts = df.sparkSession, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        own = Window.partitionBy("cell", "race")
        zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
        rows = df.select(person.alias("person"), cell.alias("cell"), race.alias("race"), y.cast("double").alias("y"), zero(side).alias("s"), *[zero(h).alias(n) for h, n in zip(hats, self.hats)]).where("y IS NOT NULL")
        rows = rows.repartition(self.parts, "cell").withColumn("k", F.dense_rank().over(Window.partitionBy("cell").orderBy("race")))
        rows = rows.withColumn("dr", F.count("*").over(own) + F.lit(self.tie))
        rows = rows.withColumn("dc", F.lit(self.ridge) + self.tie * F.sum(1 / F.col("dr")).over(Window.partitionBy("cell")))
        self.rows = bucketed(rows, "joint_swept", "cell", self.parts)
        races = self.rows.groupBy("cell", "k").agg(F.first("race").alias("race"), F.count_if(F.col("person").isNull()).alias("no"))
        seen = races.groupBy("race").agg(F.count("*").alias("cells"), F.sum(F.col("no") + F.when(F.col("cell").isNull() | F.col("race").isNull(), 1).otherwise(0)).alias("no"))
        bad = seen.agg(F.max("cells").alias("cells"), F.sum("no").alias("no")).first()
        self.sound = (bad["cells"] or 1) == 1 and not bad["no"]

    def left(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        """``rows`` with each column less its race's effect, were the column y."""
        by_race, by_cell = Window.partitionBy("cell", "k"), Window.partitionBy("cell")
        rows = rows.select("*", *[F.sum(c).over(by_race).alias(f"_r{c}") for c in columns])
        rows = rows.select("*", *[F.sum(F.col(c) / F.col("dr")).over(by_cell).alias(f"_c{c}") for c in columns])
        effect = lambda c: (F.col(f"_r{c}") + self.tie * self.tie * F.col(f"_c{c}") / F.col("dc")) / F.col("dr")
        return rows.select(*[x for x in rows.columns if x not in columns and not x.startswith("_")], *[(F.col(c) - effect(c)).alias(c) for c in columns], *[F.col(c).alias(f"{c}_own") for c in columns])

    def met(self, persons: DataFrame, n: int) -> DataFrame:
        return self.rows.join(F.broadcast(persons) if 2 * n <= SENT else persons, "person")

    def by_person(self, rows: DataFrame, sums: list[Column]) -> DataFrame:
        """Sums by person from fewer tasks than there are buckets, as each gives a row for most persons."""
        tasks = max(self.spark.sparkContext.defaultParallelism, self.parts // 4)
        return (rows.coalesce(tasks) if tasks < self.parts else rows).groupBy("person").agg(*sums)


def solve(rows: Rows, side_ridge: float | None, curve_ridge: float, tol: float, most: int = 300) -> tuple[DataFrame, dict]:
    """(effects (block, key, value, diagonal), info); a race's value is less its course's. ``side_ridge``: none where there are no sides. Raises where it doesn't settle."""
    hats, b = rows.hats, 1.0 if side_ridge is None else float(side_ridge)
    y = ["y", *hats]
    swept = rows.left(rows.rows, y)
    both = lambda c: [F.sum(c).alias(f"a{c}"), F.sum(F.col("s") * F.col(c)).alias(f"b{c}")]
    persons = written(rows.by_person(swept, [F.count("*").cast("double").alias("n"), F.sum("s").alias("ns"), F.sum(F.col("s") * F.col("s")).alias("ss"), *[x for c in y for x in both(c)]]), "swept-persons")
    n = persons.count()
    if not n:
        return persons.select(F.lit("").alias("block"), F.lit("").alias("key"), F.lit(0.0).alias("value"), F.lit(0.0).alias("diagonal")), {"products": 0, "relative": 0.0}
    small, square, right = np.zeros((len(hats), len(hats))), np.zeros(len(hats)), np.zeros(len(hats))
    if hats:  # a few sums
        got = swept.agg(*[F.sum(F.col(f"{h}_own") * F.col(c)).alias(f"{h}_{c}") for h in hats for c in y], *[F.sum(F.col(f"{h}_own") ** 2).alias(f"{h}_") for h in hats]).first()
        small = np.array([[got[f"{h}_{c}"] for c in hats] for h in hats]) + curve_ridge * np.eye(len(hats))
        right, square = np.array([got[f"{h}_y"] for h in hats]), np.array([got[f"{h}_"] for h in hats])
    inner = lambda g: np.linalg.solve(small, g) if hats else g
    less = lambda side, g: sum((F.col(f"{side}{h}") * float(v) for h, v in zip(hats, g)), F.lit(0.0))
    parts = lambda v: [F.sum(F.col(f"a{h}") * F.col(f"{v}a") + F.col(f"b{h}") * F.col(f"{v}b")).alias(f"g{h}") for h in hats]
    det = F.col("n") * (F.col("ss") + b) - F.col("ns") * F.col("ns")
    za, zb = ((F.col("ss") + b) * F.col("ra") - F.col("ns") * F.col("rb")) / det, (F.col("n") * F.col("rb") - F.col("ns") * F.col("ra")) / det
    fixed = ["person", "n", "ns", "ss", *[f"{s}{h}" for h in hats for s in "ab"]]
    start = inner(right)
    state = persons.select(*fixed, F.lit(0.0).alias("xa"), F.lit(0.0).alias("xb"), (F.col("ay") - less("a", start)).alias("ra"), (F.col("by") - less("b", start)).alias("rb"))
    size = lambda d: d.agg(F.sum(F.col("ra") * za + F.col("rb") * zb)).first()[0]
    rz = first = size(state)
    state, used = state.select("*", za.alias("pa"), zb.alias("pb")), 0
    while first and rz > tol * tol * first:
        if used == most or rz > 1e12 * first:
            raise RuntimeError(f"the joint solve did not settle: residual {rz / first:.3g} of the first after {used} products")
        fit = rows.met(state.select("person", "pa", "pb"), n).select("cell", "k", "person", "s", "dr", "dc", (F.col("pa") + F.col("s") * F.col("pb")).alias("t"))
        sums = rows.by_person(rows.left(fit, ["t"]), [F.sum("t").alias("qa"), F.sum(F.col("s") * F.col("t")).alias("qb")])
        step = written(state.join(sums, "person").withColumn("qb", F.col("qb") + b * F.col("pb")), "swept-step")
        got = step.agg(F.sum(F.col("pa") * F.col("qa") + F.col("pb") * F.col("qb")).alias("pq"), *parts("p")).first()
        g = np.array([got[f"g{h}"] for h in hats])
        c = inner(g)
        pq = got["pq"] - float(g @ c)
        if not pq > 0:
            raise RuntimeError("the joint solve met a direction without curvature")
        a = rz / pq
        move = lambda s: (F.col(f"r{s}") - a * (F.col(f"q{s}") - less(s, c))).alias(f"r{s}")  # noqa: B023, E731
        moved = step.select(*fixed, *[(F.col(f"x{s}") + a * F.col(f"p{s}")).alias(f"x{s}") for s in "ab"], move("a"), move("b"), "pa", "pb")
        new = size(moved)
        turn = new / rz
        state, rz, used = moved.select(*fixed, "xa", "xb", "ra", "rb", (za + turn * F.col("pa")).alias("pa"), (zb + turn * F.col("pb")).alias("pb")), new, used + 1
    got = state.agg(F.count("*"), *parts("x")).first()
    f = inner(right - np.array([got[f"g{h}"] for h in hats]))
    rest = rows.met(state.select("person", "xa", "xb"), n).select("cell", "k", "race", "dr", "dc", (F.col("y") - F.col("xa") - F.col("s") * F.col("xb") - sum((F.col(h) * float(v) for h, v in zip(hats, f)), F.lit(0.0))).alias("t"))
    races = rest.groupBy("cell", "k").agg(F.first("race").alias("race"), F.first("dr").alias("dr"), F.first("dc").alias("dc"), F.sum("t").alias("t"))
    races = races.withColumn("d", rows.tie * F.sum(F.col("t") / F.col("dr")).over(Window.partitionBy("cell")) / F.col("dc"))
    races = written(races.withColumn("u", (F.col("t") + rows.tie * F.col("d")) / F.col("dr")), "swept-races")
    named = lambda df, block, key, value, diagonal: df.select(F.lit(block).alias("block"), F.col(key).cast("string").alias("key"), value.alias("value"), diagonal.alias("diagonal"))
    cells = races.groupBy("cell").agg(F.first("d").alias("d"), F.count("*").alias("races"))
    out = named(races, "race", "race", F.col("u") - F.col("d"), F.col("dr")).unionByName(named(cells, "cell", "cell", F.col("d"), rows.ridge + rows.tie * F.col("races")))
    out = out.unionByName(named(state, "ability", "person", F.col("xa"), F.col("n")))
    if side_ridge is not None:
        out = out.unionByName(named(state.where("ss > 0"), "side", "person", F.col("xb"), F.col("ss") + b))
    if hats:
        few = [("curve", str(i), float(v), float(q) + curve_ridge) for i, (v, q) in enumerate(zip(f, square)) if q > 0]
        out = out.unionByName(rows.spark.createDataFrame(few, "block string, key string, value double, diagonal double"))
    return out, {"products": used, "relative": (rz / first) ** 0.5 if first else 0.0}
