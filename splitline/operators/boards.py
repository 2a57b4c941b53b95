"""Ranked boards: deduplicated performances, best per person, season ability, scoped ranks, paging."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import stats
from .ranks import ranked_within


@dataclass(frozen=True)
class Filters:
    """Whitelisted filters; one that is absent adds no predicate."""

    cells: tuple[str, ...] = ()
    persons: tuple[int, ...] = ()
    since: str | None = None
    until: str | None = None
    low: float | None = None
    high: float | None = None

    def predicate(self) -> Column:
        out = F.lit(True)
        if self.cells:
            out &= F.col("cell").isin(*self.cells)
        if self.persons:
            out &= F.col("person").isin(*self.persons)
        if self.since:
            out &= F.col("day") >= F.lit(self.since).cast("date")
        if self.until:
            out &= F.col("day") <= F.lit(self.until).cast("date")
        if self.low is not None:
            out &= F.col("mark") >= self.low
        if self.high is not None:
            out &= F.col("mark") <= self.high
        return out


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order`` (DISTINCT ON)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def performance_board(results: DataFrame, limit: int, filters: Filters = Filters(), offset: int = 0) -> DataFrame:
    """Best marks (largest first), one per person, cell and mark, ties to the smaller id, with ranks."""
    kept = first_per(results.where(filters.predicate()), ["person", "cell", "mark"], [F.col("id")])
    top = kept.orderBy(F.col("mark").desc_nulls_last(), "id").limit(limit + offset)
    rank = Window.orderBy(F.col("mark").desc_nulls_last(), "id")  # over the page's rows only
    return top.withColumn("rank", F.row_number().over(rank).cast("long")).where(F.col("rank") > offset)


def capped(df: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(at most ``limit`` rows, a one-row frame that says whether more exist)."""
    probe = df.limit(limit + 1)
    return df.limit(limit), probe.agg((F.count("*") > limit).alias("truncated"))


def best_per_person(results: DataFrame) -> DataFrame:
    return first_per(results, ["person", "cell"], [F.col("mark").desc_nulls_last(), F.col("id")])


def ability(results: DataFrame, q: float = 0.8, band: float = 20.0, floor: int = 3) -> DataFrame:
    """Season ability: type-8 quantile of the marks no more than ``band`` under the season's median, at least ``floor`` results."""
    grouped = results.groupBy("person", "season").agg(F.array_sort(F.collect_list("mark")).alias("marks"))  # one person's season
    kept = grouped.withColumn("kept", F.filter("marks", lambda m: m >= stats.median_of(F.col("marks")) - band))
    return kept.where(F.size("marks") >= floor).select("person", "season", F.size("marks").cast("long").alias("n_results"), stats.type8(F.col("kept"), q).alias("ability"))


def scoped_ranks(df: DataFrame, scopes: dict[str, list[str]], value: str, key: str, eligible: Column | None = None) -> DataFrame:
    """One dense position per scope (name -> grouping columns) plus the scope's size; rows that aren't eligible get null."""
    ok = F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False))
    got = df.withColumn("_ok", ok)
    out = got.where("_ok").drop("_ok")
    for name, columns in scopes.items():  # a scope may hold every row: positions come from range sorts
        out = ranked_within(out, columns, [F.col(value).desc_nulls_last(), F.col(key)], f"rank_{name}", f"n_{name}")
    return out.unionByName(got.where("not _ok").drop("_ok"), allowMissingColumns=True)


def rank_of(board: DataFrame, value: str, key: str, wanted: int) -> DataFrame:
    """Rank of one key: rows that beat it, plus one."""
    mine = board.where(F.col(key) == wanted).select(F.col(value).alias("_v"), F.col(key).alias("_k"))
    better = board.join(F.broadcast(mine), (F.col(value) > F.col("_v")) | ((F.col(value) == F.col("_v")) & (F.col(key) < F.col("_k"))))  # one row
    return better.agg((F.count("*") + 1).alias("rank"))


def seek_positions(board: DataFrame, group: list[str], value: str, key: str, every: int) -> DataFrame:
    """Every n-th row of each board in its order, for keyset paging, with the board's length."""
    numbered = ranked_within(board, group, [F.col(value).desc_nulls_last(), F.col(key)], "position", "length")  # a board may be most rows
    return numbered.where(F.col("position") % every == 1).select(*group, "position", "length", value, key)


def page_after(board: DataFrame, value: str, key: str, after: tuple, limit: int) -> DataFrame:
    """The rows that follow (value, key) in descending order."""
    v, k = after
    return board.where((F.col(value) < v) | ((F.col(value) == v) & (F.col(key) > k))).orderBy(F.col(value).desc(), key).limit(limit)
