"""Positions over whole tables and hot groups without a one-task window: a range sort, then offsets of its partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import bucketed, written

_ROW_BITS = 33  # the layout of monotonically_increasing_id: partition above, row within it below


def numbered(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """``df`` with a long column ``name``: 1, 2, ... in ``order``, which should end in a unique key.

    Rows are range-partitioned and sorted by the order, so that a hot value or group is split as well; what meets
    in one place is a count per partition. The sorted rows are checkpointed: both uses see the same partitions.
    """
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_at", _ROW_BITS)
    sizes = {r["p"]: r["n"] for r in laid.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # one number per partition
    before, at = 0, []
    for p in sorted(sizes):
        at.append((p, before))
        before += sizes[p]
    offsets = df.sparkSession.createDataFrame(at, "_p long, _before long")
    got = laid.join(F.broadcast(offsets), part == F.col("_p"))  # as many rows as partitions
    return got.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1) + 1).alias(name))


def ranked_within(df: DataFrame, group: list[str], order: list[Column], rank: str, size: str | None = None) -> DataFrame:
    """``df`` with each row's position in its group (and the group's size): positions over the whole table less the group's first one."""
    rows = numbered(df, [*[F.col(g) for g in group], *order], "_number")
    if not group:
        total = rows.agg(F.count("*").alias("_size"))
        both = rows.crossJoin(F.broadcast(total)).withColumn("_first", F.lit(1))  # one row
    else:
        first = rows.groupBy(*group).agg(F.min("_number").alias("_first"), F.count("*").alias("_size"))
        keyed = first.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_first", "_size")
        same = [F.col(f"`{g}`").eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
        both = rows.join(keyed, same)
    own = [F.col(f"`{c}`") for c in df.columns]
    return both.select(*own, (F.col("_number") - F.col("_first") + 1).alias(rank), *([F.col("_size").alias(size)] if size else []))


class Ordered:
    """Rows laid out once by (group, order) in range partitions, for sums and neighbours within groups that may hold most of all rows.

    ``rows`` has the columns of ``df`` and the partition ``_part``. They lie in buckets by ``_part``, so that no later step moves a row: sums run within
    (group, partition), and what other partitions of a group add is sent to all tasks, as only the first and the last group of a partition
    can lie in others too. ``order`` should end in a unique key.
    """

    def __init__(self, df: DataFrame, group: list[str], order: list[str]):
        self.group, self.order = group, order
        self.parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        laid = df.repartitionByRange(2 * self.parts, *[F.col(c) for c in (*group, *order)])  # a few to a bucket, so that buckets are alike
        self.rows = self.kept(laid.withColumn("_part", F.spark_partition_id()))
        shared = self.rows.groupBy(*group, "_part").agg(F.lit(1).alias("_c")).groupBy(*group).agg(F.count("*").alias("_c")).where("_c > 1")
        self.split = written(shared.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]), "ordered-split")

    def kept(self, rows: DataFrame) -> DataFrame:
        """``rows`` of the layout written once and read back, in the same buckets."""
        return bucketed(rows, "ordered", "_part", self.parts)

    def _same(self) -> list[Column]:
        return [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(self.group)]

    def _joined(self, rows: DataFrame, given: DataFrame) -> DataFrame:
        """``rows`` with what ``given`` (_g0 ..., _p, more) has for their (group, partition): a few rows a partition, made once."""
        return rows.join(F.broadcast(written(given, "ordered-given")), [*self._same(), F.col("_part") == F.col("_p")], "left")

    def _split(self, rows: DataFrame) -> DataFrame:
        """The rows of groups that lie in several partitions; a partition has two such groups at most."""
        return rows.join(F.broadcast(self.split), self._same(), "left_semi")

    def _named(self) -> list[Column]:
        return [*[F.col(g).alias(f"_g{i}") for i, g in enumerate(self.group)], F.col("_part").alias("_p")]

    def running(self, rows: DataFrame, sums: dict[str, Column], reverse: bool = False) -> DataFrame:
        """``rows`` (those of the layout, more columns allowed) with running sums, from the first row, or from the last where ``reverse``."""
        way = (lambda c: F.desc(c)) if reverse else (lambda c: F.asc(c))
        within = Window.partitionBy(*self.group, "_part").orderBy(*map(way, self.order)).rowsBetween(Window.unboundedPreceding, 0)
        own = rows.withColumns({f"_{k}": v for k, v in sums.items()})
        totals = self._split(own).groupBy(*self.group, "_part").agg(*[F.sum(f"_{k}").alias(f"_t{k}") for k in sums])
        before = Window.partitionBy(*self.group).orderBy(way("_part")).rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
        offsets = totals.select(*self._named(), *[F.coalesce(F.sum(f"_t{k}").over(before), F.lit(0)).alias(f"_b{k}") for k in sums])
        run = own.withColumns({k: F.sum(f"_{k}").over(within) for k in sums})
        return self._joined(run, offsets).select(*rows.columns, *[(F.coalesce(k, F.lit(0)) + F.coalesce(f"_b{k}", F.lit(0))).alias(k) for k in sums])

    def whole(self, rows: DataFrame, found: dict[str, tuple], more: str | None = None) -> DataFrame:
        """``rows`` with a sum, minimum or maximum of their group, or of its rows with the same ``more``: name -> (F.sum, F.min or F.max, column)."""
        keys = [*self.group, *([more] if more else [])]
        own = rows.withColumns({f"_{k}": v for k, (_, v) in found.items()})
        parts = self._split(own).groupBy(*keys, "_part").agg(*[how(f"_{k}").alias(f"_t{k}") for k, (how, _) in found.items()])
        given = parts.select(*self._named(), *([F.col(more).alias("_more")] if more else []), *[how(f"_t{k}").over(Window.partitionBy(*keys)).alias(f"_b{k}") for k, (how, _) in found.items()])
        run = own.withColumns({k: how(f"_{k}").over(Window.partitionBy(*keys, "_part")) for k, (how, _) in found.items()})
        if more:  # may be many in a hot group, so Spark sends them or not by their size
            both = run.join(written(given, "ordered-given"), [*self._same(), F.col("_part") == F.col("_p"), F.col(more).eqNullSafe(F.col("_more"))], "left")
        else:
            both = self._joined(run, given)
        return both.select(*rows.columns, *[F.coalesce(f"_b{k}", k).alias(k) for k in found])

    def around(self, rows: DataFrame, item: Column, k: int) -> DataFrame:
        """``rows`` with ``_before`` and ``_after``: the items of the group's k rows before and after each, nearest last and nearest first. What lies in
        other partitions comes from their first and last k rows."""
        w = Window.partitionBy(*self.group, "_part").orderBy(*self.order)
        own = rows.withColumn("_item", item)
        ends = self._split(own).withColumn("_up", F.row_number().over(w)).withColumn("_down", F.row_number().over(Window.partitionBy(*self.group, "_part").orderBy(*[F.desc(c) for c in self.order])))
        place = lambda c, cut: F.transform(F.array_sort(F.collect_list(F.when(F.col(cut) <= k, F.struct(F.col("_up").alias("u"), F.col("_item").alias("i"))))), lambda s: s["i"])
        parts = ends.where((F.col("_up") <= k) | (F.col("_down") <= k)).groupBy(*self.group, "_part").agg(place("_up", "_up").alias("_first"), place("_up", "_down").alias("_last"))
        order = Window.partitionBy(*self.group).orderBy("_part")  # one row a partition, each of one row at least
        earlier, later = F.flatten(F.collect_list("_last").over(order.rowsBetween(-k, -1))), F.flatten(F.collect_list("_first").over(order.rowsBetween(1, k)))
        given = parts.select(*self._named(), earlier.alias("_e"), later.alias("_l")).where("size(_e) + size(_l) > 0")
        near = own.withColumn("_b", F.collect_list("_item").over(w.rowsBetween(-k, -1))).withColumn("_a", F.collect_list("_item").over(w.rowsBetween(1, k)))
        both = self._joined(near, given)
        before = F.when(F.col("_e").isNull(), F.col("_b")).otherwise(F.concat("_e", "_b"))
        after = F.when(F.col("_l").isNull(), F.col("_a")).otherwise(F.concat("_a", "_l"))
        return both.select(*rows.columns, F.slice(before, F.greatest(F.size(before) - k + 1, F.lit(1)), F.lit(k)).alias("_before"), F.slice(after, 1, k).alias("_after"))
