"""Registration of catalogue queries, and the mapping of the test tables onto results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the decorated function under its name, with its DuckDB oracle if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def results(spark: SparkSession, sf: str) -> DataFrame:
    """events as results: id, person, cell, ts, day, dayno (days since 2024-01-01), mark."""
    e = table(spark, sf, "events")
    day = F.to_date("ts")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("person"), F.col("event_type").alias("cell"), "ts", day.alias("day"), F.datediff(day, F.lit("2024-01-01")).cast("long").alias("dayno"), F.col("value").alias("mark"))


#: The same mapping for the oracles.
R = "r AS (SELECT event_id AS id, user_id AS person, event_type AS cell, ts, CAST(ts AS DATE) AS day, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS dayno, value AS mark FROM events)"


def races(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem with orders as races: race (part), team (the supplier's nation), person (customer), mark, day."""
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    s = table(spark, sf, "supplier")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(s, li["l_suppkey"] == s["s_suppkey"]).select(
        F.col("l_partkey").alias("race"), F.col("s_nationkey").cast("long").alias("team"), F.col("o_custkey").alias("person"), F.col("l_extendedprice").alias("mark"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.to_date("l_shipdate").alias("day"), F.col("l_suppkey").alias("cell"),
    )


L = "l AS (SELECT l_partkey AS race, CAST(s_nationkey AS BIGINT) AS team, o_custkey AS person, l_extendedprice AS mark, l_orderkey * 10 + l_linenumber AS id, CAST(l_shipdate AS DATE) AS day, l_suppkey AS cell FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey)"
