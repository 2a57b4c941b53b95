"""Aggregates: robust centres, votes, leave-one-out, slopes, decay, sets of groupings, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ranks import ranked_within


def weighted_median(df: DataFrame, group: list[str], value: str, weight: str, key: str) -> DataFrame:
    """Smallest value at which the running weight reaches half the group's weight."""
    w = Window.partitionBy(*group).orderBy(value, key)
    total = Window.partitionBy(*group)
    run = df.withColumn("_run", F.sum(weight).over(w)).withColumn("_all", F.sum(weight).over(total))
    return run.where(F.col("_run") * 2 >= F.col("_all")).groupBy(*group).agg(F.min(value).alias("weighted_median"))


def robust_scale(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Median and 1.4826 * median absolute deviation per group, in two passes of percentiles."""
    med = df.groupBy(*group).agg(F.percentile(value, 0.5).alias("median"))
    return df.join(med, group).groupBy(*group, "median").agg((1.4826 * F.percentile(F.abs(F.col(value) - F.col("median")), 0.5)).alias("mad"))


def majority(df: DataFrame, group: list[str], label: str, share: float, least: int) -> DataFrame:
    """The most frequent label (ties: smaller label) where it has ``share`` of at least ``least`` votes, else null."""
    votes = df.groupBy(*group, label).agg(F.count("*").alias("votes"))
    w = Window.partitionBy(*group)
    ranked = votes.withColumn("total", F.sum("votes").over(w)).withColumn("_rn", F.row_number().over(w.orderBy(F.desc("votes"), label)))
    won = (F.col("votes") >= share * F.col("total")) & (F.col("total") >= least)
    return ranked.where("_rn = 1").select(*group, F.when(won, F.col(label)).alias("winner"), "votes", "total")


def leave_one_out_slope(df: DataFrame, person: str, cell: str, value: str, least: int, shrink: float) -> DataFrame:
    """Per cell, the through-origin slope of a person's lift here on the person's mean elsewhere, shrunk by n / (n + shrink).

    The mean elsewhere is (total - here) / (n - n here): two aggregates and a join, never a self-join of rows.
    """
    here = df.groupBy(person, cell).agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    w = Window.partitionBy(person)
    both = here.withColumn("ts", F.sum("s").over(w)).withColumn("tn", F.sum("n").over(w)).where(F.col("tn") - F.col("n") >= least)
    x = (F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n"))
    lift = both.select(cell, x.alias("x"), (F.col("s") / F.col("n") - x).alias("y"))
    centred = lift.withColumn("x", F.col("x") - F.avg("x").over(Window.partitionBy(cell)))
    slope = F.try_divide(F.sum(F.col("x") * F.col("y")), F.sum(F.col("x") * F.col("x"))) * (F.count("*") / (F.count("*") + shrink))  # null where all are alike
    return centred.groupBy(cell).agg(slope.alias("slope"), F.count("*").alias("n_persons"))


def decayed_mean(df: DataFrame, group: list[str], value: str, weight: Column) -> DataFrame:
    """Weighted mean per group; null where all weights are 0."""
    return df.withColumn("_w", weight).groupBy(*group).agg(F.try_divide(F.sum(F.col("_w") * F.col(value)), F.sum("_w")).alias("decayed_mean"))


def fingerprint(df: DataFrame, group: list[str], key: str, value: str) -> DataFrame:
    """Count, largest key and rounded sum: equal fingerprints let a rebuild be skipped."""
    return df.groupBy(*group).agg(F.count("*").alias("n"), F.max(key).alias("max_key"), F.round(F.sum(value), 2).alias("total"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts by equal bands; 0 and bins + 1 hold what lies outside."""
    return df.groupBy(F.expr(f"width_bucket({value}, {low}, {high}, {bins})").alias("band")).agg(F.count("*").alias("n"), F.round(F.avg(value), 4).alias("mean"))


def step_groups(df: DataFrame, group: str, value: str, least: int) -> DataFrame:
    """Group medians; groups with fewer than ``least`` rows are pooled as 'other'."""
    sizes = df.groupBy(group).agg(F.count("*").alias("_n"))
    label = F.when(F.col("_n") < least, "other").otherwise(F.col(group))
    return df.join(sizes, group).groupBy(label.alias("grp")).agg(F.percentile(value, 0.5).alias("median"), F.count("*").alias("n"))


def capped_top(df: DataFrame, group: list[str], person: str, order: list[Column], n: int, per_person: int) -> DataFrame:
    """Top n of a group with at most ``per_person`` rows of one person: two ranked passes."""
    inner = Window.partitionBy(*group, person).orderBy(*order)
    outer = Window.partitionBy(*group).orderBy(*order)
    few = df.withColumn("_p", F.row_number().over(inner)).where(F.col("_p") <= per_person).drop("_p")
    return few.withColumn("k", F.row_number().over(outer).cast("long")).where(F.col("k") <= n)


def median_of_others(df: DataFrame, group: list[str], value: str, key: str) -> DataFrame:
    """``df`` with ``others``: the median of the group's values without the row's own, null where there are none or the own value is null.

    Taking one value out moves the middle by at most one place, so three middle values per group are enough; no row sees its group.
    """
    rows = ranked_within(df.where(F.col(value).isNotNull()), group, [F.col(value), F.col(key)], "_pos", "_n")
    half = F.floor(F.col("_n") / 2)
    middle = rows.where(F.col("_pos").between(half, half + 2)).groupBy(*group).agg(*[F.max(F.when(F.col("_pos") == half + i, F.col(value))).alias(f"_m{i}") for i in range(3)])
    keyed = middle.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_m0", "_m1", "_m2")
    both = rows.join(keyed, [F.col(f"`{g}`").eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)])

    def place(k: Column) -> Column:  # the k-th of the others
        at = F.when(k < F.col("_pos"), k).otherwise(k + 1) - half
        return F.when(at == 0, F.col("_m0")).when(at == 1, F.col("_m1")).otherwise(F.col("_m2"))

    others = F.when(F.col("_n") > 1, (place(half) + place(F.floor((F.col("_n") + 1) / 2))) / 2)
    return both.select(*[F.col(f"`{c}`") for c in df.columns], others.alias("others"))
