"""Running records, gaps, islands, before-and-after means, season positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def running_record(df: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """Rows that beat every earlier row of their group, with the record they broke."""
    before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    marked = df.withColumn("previous", F.max(value).over(before))
    return marked.where(F.col("previous").isNull() | (F.col(value) > F.col("previous")))


def islands(df: DataFrame, key: str, day: str, order: str, gap: int) -> DataFrame:
    """Stints of a key: a new one starts after more than ``gap`` days. One row per stint."""
    w = Window.partitionBy(key).orderBy(day, order)
    start = F.when(F.col(day) - F.lag(day).over(w) > gap, 1).otherwise(0)
    numbered = df.withColumn("_s", start).withColumn("stint", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "stint").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("n"))


def before_after(df: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """Mean of the earlier rows, mean of the later rows and best later value."""
    w = Window.partitionBy(*group).orderBy(*order)
    past, future = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    return df.withColumn("earlier_mean", F.avg(value).over(past)).withColumn("later_mean", F.avg(value).over(future)).withColumn("later_best", F.max(value).over(future))


def season_position(df: DataFrame, person: str, season: str, day: str) -> DataFrame:
    first = F.min(day).over(Window.partitionBy(person, season))
    return df.withColumn("days_in", F.col(day) - first).withColumn("opener", F.col(day) == first)


def breakouts(df: DataFrame, group: list[str], day: str, value: str, least: int) -> DataFrame:
    """Value minus the median of strictly earlier days' values, where at least ``least`` precede."""
    before = Window.partitionBy(*group).orderBy(day).rangeBetween(Window.unboundedPreceding, -1)
    median = F.percentile(value, 0.5).over(before)
    return df.withColumn("n_prior", F.count(value).over(before)).withColumn("jump", F.col(value) - median).where(F.col("n_prior") >= least)
