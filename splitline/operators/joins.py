"""Join forms: interval sums, nearest in time, as-of, bands, grids, offsets, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ranks import Ordered


def interval_bracket(df: DataFrame, group: list[str], cell: str, day: str, value: str, days: int) -> DataFrame:
    """``bracket``: value minus the mean of the group's rows within ``days`` at another cell; ``n_other``; null if there are none.

    Both sums are range windows; the row's own cell is taken away, so no pair is built. A group is cut into spans of days
    with the ``days`` around them as context, so a hot group is spread over its spans.
    """
    width = 16 * max(1, days)
    span = F.floor(F.col(day) / width)
    inside = F.col(day) - span * width
    copies = F.array_compact(F.array(span, F.when(inside < days, span - 1), F.when(inside >= width - days, span + 1)))
    spread = df.withColumn("_span", F.explode(F.when(F.col(day).isNull(), F.array(F.lit(None).cast("long"))).otherwise(copies)))
    near = Window.partitionBy(*group, "_span").orderBy(day).rangeBetween(-days, days)
    own = Window.partitionBy(*group, "_span", cell).orderBy(day).rangeBetween(-days, days)
    n = F.count(value).over(near) - F.count(value).over(own)
    s = F.sum(value).over(near) - F.sum(value).over(own)
    got = spread.withColumn("n_other", n).withColumn("bracket", F.when(n > 0, F.col(value) - s / n))
    return got.where(F.col("_span").eqNullSafe(span)).drop("_span")


def nearest_by_day(df: DataFrame, key: str, day: str, order: str, value: str, k: int) -> DataFrame:
    """``near``: values of the key's k nearest other rows by day, sought within k places
    either side in (day, order); equal gaps go to the earlier day, then the smaller ``order``."""
    here = F.struct(F.col(day).alias("d"), F.col(order).alias("o"), F.col(value).alias("v"))
    laid = Ordered(df, [key], [day, order])  # a hot key spans several partitions
    around = laid.around(laid.rows, here, k).withColumn("_around", F.concat("_before", "_after"))
    ranked = F.array_sort(F.transform("_around", lambda s: F.struct(F.abs(s["d"] - F.col(day)).alias("gap"), s["d"].alias("d"), s["o"].alias("o"), s["v"].alias("v"))))
    return around.withColumn("near", F.transform(F.slice(ranked, 1, k), lambda s: s["v"])).select(*df.columns, "near")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, out: str) -> DataFrame:
    """``left`` with the value of the latest right row at or before ``at``: one union in range partitions of (keys, at), no pairs.

    A hot key spans several partitions. Within one, the latest value is a window; what earlier partitions of the key leave
    behind is carried over by one row per key and partition.
    """
    kind = right.schema[value].dataType
    marked = left.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(kind).alias("_v"))
    given = right.where(F.col(value).isNotNull()).select(*keys, F.col(at).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(marked.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"))
    # both uses below must see the same partitions
    laid = marked.unionByName(given).repartitionByRange(*keys, "_at", "_side").withColumn("_part", F.spark_partition_id()).checkpoint()
    w = Window.partitionBy("_part", *keys).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    near = laid.withColumn("_v", F.last("_v", True).over(w)).where("_side = 1")
    heads = laid.groupBy("_part", *keys).agg(F.max_by(F.col("_v"), F.when(F.col("_side") == 0, F.col("_at"))).alias("_head"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as the key has partitions
    carried = heads.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.last("_head", True).over(before).alias("_earlier")).where("_earlier IS NOT NULL")
    same = [F.col("_part") == F.col("_p"), *[near[k].eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]]
    got = near.join(carried, same, "left")
    return got.select("_row.*", F.coalesce("_v", "_earlier").alias(out))


def band_join(df: DataFrame, bands: DataFrame, value: str) -> DataFrame:
    """Rows with the bands (label, low, high) that hold their value; the band list is small and Spark broadcasts it by size."""
    return df.join(bands, (F.col(value) >= F.col("low")) & (F.col(value) <= F.col("high")))


def grid_pairs(points: DataFrame, key: str, x: str, y: str, cell: float, reach: float, steps: int = 1) -> DataFrame:
    """Pairs (a < b) within ``reach``: each point is put into its neighbouring cells, then an equi-join on the cell."""
    home = points.select(F.col(key).alias("a"), F.col(x).alias("ax"), F.col(y).alias("ay"), F.floor(F.col(x) / cell).alias("cx"), F.floor(F.col(y) / cell).alias("cy"))
    offsets = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in range(-steps, steps + 1) for j in range(-steps, steps + 1)])
    spread = home.withColumn("o", F.explode(offsets)).select(F.col("a").alias("b"), F.col("ax").alias("bx"), F.col("ay").alias("by"), (F.col("cx") + F.col("o.dx")).alias("cx"), (F.col("cy") + F.col("o.dy")).alias("cy"))
    d = F.sqrt(F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2))
    return home.join(spread, ["cx", "cy"]).where((F.col("a") < F.col("b")) & (d <= reach)).select("a", "b", d.alias("distance"))


def closest_pairs(df: DataFrame, key: str, order: str, day: str, cell: str, value: str, days: int) -> DataFrame:
    """Per key and ordered cell pair: the closest two rows within ``days``, the later one second; ``ratio`` is null where the earlier value is 0 or null.

    Days are cut into spans just longer than ``days``, so a row meets only its own span and the next one, never a key's whole history. Rows of a span
    and cell are one list, with a day's two smallest ``order`` (the second for where the first is the other cell's too), so that a hot key's lists
    are bounded by the calendar; lists meet, and each pair of lists gives one row. No pair of rows is sorted or moved: the closest days of two lists are
    next to each other in the days of both, unless a row of one has the ``order`` of a row of the other, where all pairs of the two lists are compared.
    """
    named = df.select(F.col(key).alias("k"), F.col(cell).alias("c"), F.floor(F.col(day) / (days + 1)).alias("_span"), F.col(day).alias("d"), F.col(order).alias("o"), F.col(value).alias("v"))
    laid = named.where("k IS NOT NULL AND c IS NOT NULL AND _span IS NOT NULL AND o IS NOT NULL").repartition("k", "c", "_span")
    first = laid.withColumn("_r", F.dense_rank().over(Window.partitionBy("k", "c", "_span", "d").orderBy("o"))).where("_r <= 2")
    entries = first.groupBy("k", "c", "_span", "d", "o", "_r").agg(F.min("v").alias("v"))
    entry = lambda r: F.collect_list(F.when(F.col("_r") == r, F.struct("d", "o", "v")))
    lists = entries.groupBy("k", "c", "_span").agg(entry(1).alias("s"), entry(2).alias("more"))
    marked = lambda t: F.transform("s", lambda x: F.struct(x["d"].alias("d"), F.lit(t).alias("t"), x["o"].alias("o"), x["v"].alias("v")))
    side = lambda i: [F.col("c").alias(f"c{i}"), marked(i).alias(f"m{i}"), F.transform(F.concat("s", "more"), lambda x: x["o"]).alias(f"o{i}"), "s", "more"]
    a = lists.select("k", *side(1), F.explode(F.array(F.col("_span"), F.col("_span") + 1)).alias("_span")).withColumnsRenamed({"s": "s1", "more": "more1"})
    b = lists.select("k", *side(2), "_span").withColumnsRenamed({"s": "s2", "more": "more2"})
    met = a.join(b, ["k", "_span"]).where("c1 != c2").withColumn("_all", F.sort_array(F.concat("m1", "m2")))
    pair = lambda x, y: F.struct((y["d"] - x["d"]).alias("gap"), x["o"].alias("o1"), y["o"].alias("o2"), x["v"].alias("v1"), y["v"].alias("v2"))
    close = lambda x, y: (x["d"] <= y["d"]) & (y["d"] - x["d"] <= days)
    beside = F.zip_with("_all", F.slice("_all", 2, F.size("_all")), lambda x, y: F.when((x["t"] == 1) & (y["t"] == 2) & close(x, y), pair(x, y)))
    every = F.flatten(F.transform(F.concat("s2", "more2"), lambda y: F.transform(F.concat("s1", "more1"), lambda x: F.when(close(x, y) & (x["o"] != y["o"]), pair(x, y)))))
    near = F.when(F.arrays_overlap("o1", "o2"), F.array_min(every)).otherwise(F.array_min(beside))
    best = met.select("k", "c1", "c2", near.alias("_near")).where("_near IS NOT NULL").groupBy("k", "c1", "c2").agg(F.min("_near").alias("_near"))
    return best.select(F.col("k").alias(key), "c1", "c2", "_near.o1", "_near.o2", "_near.gap", F.try_divide("_near.v2", "_near.v1").alias("ratio"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, rank: str) -> DataFrame:
    """Full outer comparison of two ranked snapshots."""
    a, b = old.select(key, F.col(rank).alias("old_rank")), new.select(key, F.col(rank).alias("new_rank"))
    change = F.when(F.col("old_rank").isNull(), "new").when(F.col("new_rank").isNull(), "gone").when(F.col("new_rank") < F.col("old_rank"), "up").when(F.col("new_rank") > F.col("old_rank"), "down").otherwise("same")
    return a.join(b, key, "full").withColumn("change", change)


def season_offset(df: DataFrame, key: str, season: str, value: str, offset: int = 1) -> DataFrame:
    """Each season with the same key's value ``offset`` seasons later, if any."""
    later = df.select(key, (F.col(season) - offset).alias(season), F.col(value).alias("later"))
    return df.join(later, [key, season], "left")


def top_k_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("k", F.row_number().over(w).cast("long")).where(F.col("k") <= k)


def head_to_head(results: DataFrame, a: int, b: int, race: str, person: str, place: str) -> DataFrame:
    """Races both ran, and who was ahead."""
    x = results.where(F.col(person) == a).select(race, F.col(place).alias("place_a"))
    y = results.where(F.col(person) == b).select(race, F.col(place).alias("place_b"))
    return x.join(y, race).withColumn("ahead", F.when(F.col("place_a") < F.col("place_b"), "a").when(F.col("place_a") > F.col("place_b"), "b").otherwise("tie"))


def within_radius(df: DataFrame, keys: list[str], key: str, value: str, radius: str, widest: float) -> DataFrame:
    """(a, b, gap): rows of the same ``keys`` whose value is within the radius of a's own; ``widest`` bounds the radii and is the width of the value bands that meet."""
    band = F.floor(F.col(value) / widest)
    a = df.select(*keys, F.col(key).alias("a"), F.col(value).alias("_x"), F.col(radius).alias("_r"), F.explode(F.array(band - 1, band, band + 1)).alias("_b"))
    b = df.select(*keys, F.col(key).alias("b"), F.col(value).alias("_y"), band.alias("_b"))
    gap = F.abs(F.col("_x") - F.col("_y"))
    return a.join(b, [*keys, "_b"]).where((F.col("a") != F.col("b")) & (gap <= F.col("_r"))).select("a", "b", gap.alias("gap"))


def alike_trends(pairs: DataFrame, trends: DataFrame, key: str, trend: str, most: float, k: int) -> DataFrame:
    """(a, b, gap, turn): of the pairs (a, b, gap), those whose trends differ by ``most`` or less, and of these each ``a``'s ``k`` nearest by gap, then b."""
    ta, tb = trends.select(F.col(key).alias("a"), F.col(trend).alias("_ta")), trends.select(F.col(key).alias("b"), F.col(trend).alias("_tb"))
    both = pairs.join(ta, "a").join(tb, "b").withColumn("turn", F.abs(F.col("_ta") - F.col("_tb"))).where(F.col("turn") <= most)
    return top_k_per_key(both, ["a"], [F.col("gap"), F.col("b")], k).select("a", "b", "gap", "turn")
