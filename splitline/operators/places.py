"""Places: rounded coordinates, grid cells, weather cells and tiles, fallback lookups, entity links, identity clusters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import curves, text
from .setops import components
from .store import written


def rounded_join(left: DataFrame, right: DataFrame, coordinates: list[str], digits: int, how: str = "left") -> DataFrame:
    """Join on coordinates rounded to ``digits`` places, as whole numbers, so that no float is compared."""
    key = lambda df: [F.round(df[c] * 10**digits).cast("long").alias(f"_{c}") for c in coordinates]
    names = [f"_{c}" for c in coordinates]
    return left.select("*", *key(left)).join(right.select("*", *key(right)).drop(*coordinates), names, how).drop(*names)


def snap(value: Column, step: float) -> Column:
    """The number of the grid cell of width ``step`` whose centre is nearest."""
    return F.floor(value / step + 0.5).cast("long")


def weather_at(races: DataFrame, weather: DataFrame, step: float, hours: tuple[int, int]) -> DataFrame:
    """Each race's mean weather over its local hours in its own cell and day. races: id, lat, lon, day; weather: cell_lat, cell_lon, day, hour (UTC), temp.

    The local hour is UTC plus a fifteenth of the cell's longitude.
    """
    local = F.pmod(F.col("hour") + F.round(F.col("cell_lon") * step / 15), F.lit(24))
    day = weather.where(local.between(*hours)).groupBy("cell_lat", "cell_lon", "day").agg(F.avg("temp").alias("temp"), F.count("*").alias("n_hours"))
    at = races.withColumn("cell_lat", snap(F.col("lat"), step)).withColumn("cell_lon", snap(F.col("lon"), step))
    return at.join(day, ["cell_lat", "cell_lon", "day"], "left")


def tiles(cells: DataFrame, size: int) -> DataFrame:
    """Tiles of ``size`` by ``size`` cells with the cells wanted in each: one fetch a tile."""
    return cells.groupBy(F.floor(F.col("cell_lat") / size).alias("tile_lat"), F.floor(F.col("cell_lon") / size).alias("tile_lon")).agg(F.count_distinct("cell_lat", "cell_lon").alias("cells"), F.min("cell_lat").alias("south"), F.max("cell_lat").alias("north"))


def _spots(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spots, members): the different (name, lat, lon) of ``places``, numbered, and each place's spot (id, spot)."""
    at = places.select("id", "name", "lat", "lon").dropna(subset=["name", "lat", "lon"])
    spots = written(at.select("name", "lat", "lon").distinct().withColumn("spot", F.monotonically_increasing_id()), "spots")
    return spots, at.join(spots, ["name", "lat", "lon"]).select("id", "spot").distinct()


def _near_spots(spots: DataFrame, metres: float, similarity: float) -> DataFrame:
    """(s, t, metres, similarity) of spots in either order, each with itself too.

    Cells are ``metres`` high and, by the latitude's cosine, at least as wide; a spot meets its own and the neighbouring cells.
    """
    step = metres / 111_000.0
    row = F.floor(F.col("lat") / step)
    # within a band of rows the width is set by the latitude nearest a pole, so neighbours suffice
    wide = lambda r: F.lit(step) / F.greatest(F.cos(F.radians((F.abs(r) + 2) * step)), F.lit(0.01))
    home = spots.select(F.col("spot").alias("s"), F.col("name").alias("n1"), F.col("lat").alias("la"), F.col("lon").alias("lo"), row.alias("r")).withColumn("c", F.floor(F.col("lo") / wide(F.col("r"))))
    shift = F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)]))
    other = spots.select(F.col("spot").alias("t"), F.col("name").alias("n2"), F.col("lat").alias("lb"), F.col("lon").alias("lp"), row.alias("r0")).withColumn("dr", shift).withColumn("r", F.col("r0") + F.col("dr"))
    other = other.withColumn("c0", F.floor(F.col("lp") / wide(F.col("r")))).withColumn("dc", shift).withColumn("c", F.col("c0") + F.col("dc")).drop("r0", "dr", "c0", "dc")
    d = curves.haversine_m(F.col("la"), F.col("lo"), F.col("lb"), F.col("lp"))
    pair = home.join(other, ["r", "c"]).withColumn("metres", d).where(F.col("metres") <= metres)
    return pair.withColumn("similarity", text.similarity(F.col("n1"), F.col("n2"))).where(F.col("similarity") >= similarity).select("s", "t", "metres", "similarity")


def near_places(places: DataFrame, metres: float, similarity: float) -> DataFrame:
    """Pairs (a < b) of places within ``metres`` whose names have at least ``similarity``. places: id, name, lat, lon.

    Places of one name and position are one spot: distances and names are compared once a pair of spots, and every pair of their places is given.
    """
    spots, members = _spots(places)
    near, members = written(_near_spots(spots, metres, similarity), "near-spots"), written(members, "spot-members")
    parts = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few pairs of spots may be many pairs of places
    first = near.repartition(parts, "s", "t").join(members.select(F.col("id").alias("a"), F.col("spot").alias("s")), "s")
    return first.join(members.select(F.col("id").alias("b"), F.col("spot").alias("t")), "t").where("a < b").select("a", "b", "metres", "similarity")


def near_links(places: DataFrame, metres: float, similarity: float) -> DataFrame:
    """Pairs (a, b) with the clusters of :func:`near_places`, without expanding copies: a place with the smallest id of its spot, and of two
    spots the smallest id of the first with the largest of the second, where any of the first is below any of the second."""
    spots, members = _spots(places)
    near, members = written(_near_spots(spots, metres, similarity), "near-spots"), written(members, "spot-members")
    ends = written(members.groupBy("spot").agg(F.min("id").alias("low"), F.max("id").alias("high")), "spot-ends")
    own = near.where("s = t").select(F.col("s").alias("spot")).join(members, "spot").join(ends, "spot").where("id > low").select(F.col("low").alias("a"), F.col("id").alias("b"))
    low, high = ends.select(F.col("spot").alias("s"), F.col("low").alias("a")), ends.select(F.col("spot").alias("t"), F.col("high").alias("b"))
    return near.where("s <> t").join(low, "s").join(high, "t").where("a < b").select("a", "b").unionByName(own)


def canonical_places(places: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, canonical): every place with the smallest id of its cluster of pairs, its own if it has none."""
    c = components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return places.select("id").join(c, "id", "left").select("id", F.coalesce("component", "id").alias("canonical"))


def fallback(rows: DataFrame, tables: list[tuple[DataFrame, list[str]]], value: str) -> DataFrame:
    """``rows`` with ``value`` from the first table that has their keys; ``level`` tells which, null if none. Spark sends small tables by their size."""
    columns = rows.columns
    for i, (t, keys) in enumerate(tables):
        one = t.select(*[F.col(k).alias(f"_k{k}") for k in keys], F.col(value).alias(f"_v{i}"))
        rows = rows.join(one, [rows[k] == one[f"_k{k}"] for k in keys], "left").drop(*[f"_k{k}" for k in keys]) if keys else rows.crossJoin(one)  # a table without keys has one row
    got = [F.col(f"_v{i}") for i in range(len(tables))]
    level = F.coalesce(*[F.when(v.isNotNull(), i) for i, v in enumerate(got)])
    return rows.select(*columns, F.coalesce(*got).alias(value), level.alias("level"))


def link_votes(left: DataFrame, right: DataFrame, keys: list[str], close: float) -> DataFrame:
    """(left_team, right_team, votes): athletes of two feeds that agree on ``keys`` and, by their names, nearly. Both: team, name and the keys."""
    a = left.select(*keys, F.col("team").alias("left_team"), F.col("name").alias("_a"))
    b = right.select(*keys, F.col("team").alias("right_team"), F.col("name").alias("_b"))
    return a.join(b, keys).where(text.similarity(F.col("_a"), F.col("_b")) >= close).groupBy("left_team", "right_team").agg(F.count("*").alias("votes"))


def decide_links(votes: DataFrame, least: int, share: float, margin: int) -> DataFrame:
    """Each left team's best right team with ``least`` votes, ``share`` of its votes and ``margin`` more than its second; ties go to none."""
    w = Window.partitionBy("left_team")
    ranked = votes.withColumn("_k", F.row_number().over(w.orderBy(F.desc("votes"), "right_team"))).withColumn("_all", F.sum("votes").over(w))
    second = F.coalesce(F.max(F.when(F.col("_k") == 2, F.col("votes"))).over(w), F.lit(0))
    return ranked.withColumn("_second", second).where((F.col("_k") == 1) & (F.col("votes") >= least) & (F.col("votes") >= share * F.col("_all")) & (F.col("votes") - F.col("_second") >= margin)).select("left_team", "right_team", "votes")


def majority_gender(rows: DataFrame, person: str, gender: str, share: float) -> DataFrame:
    """(person, gender, n_m, n_f, split): the gender that ``share`` of a person's labelled rows have; a person without such a majority is split."""
    g = rows.groupBy(person).agg(F.count_if(F.col(gender) == "M").alias("n_m"), F.count_if(F.col(gender) == "F").alias("n_f"))
    n = F.col("n_m") + F.col("n_f")
    picked = F.when(F.col("n_m") >= share * n, "M").when(F.col("n_f") >= share * n, "F")
    return g.where(n > 0).select(person, picked.alias("gender"), "n_m", "n_f", picked.isNull().alias("split"))


def person_splits(seasons: DataFrame, person: str, season: str, grade: str, gap: int, drift: int) -> DataFrame:
    """Seasons with the part of their person they belong to: a new part starts after ``gap`` seasons without one, or where the class year
    (season less grade) moves by more than ``drift``."""
    w = Window.partitionBy(person).orderBy(season)
    start = F.col(season) - F.col(grade)
    moved = (F.col(season) - F.lag(season).over(w) > gap) | (F.abs(start - F.lag(start).over(w)) > drift)
    cut = seasons.withColumn("_s", F.coalesce(moved, F.lit(False)).cast("int"))
    return cut.withColumn("part", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def trusted_grades(rows: DataFrame, person: str, season: str, grade: str, least: int) -> DataFrame:
    """Per person: whether its grades, one a season, rise as the seasons do (a grade a season, with one grade repeated at most), over ``least`` seasons."""
    per = rows.groupBy(person, season).agg(F.max(grade).alias("_g"))
    w = Window.partitionBy(person).orderBy(season)
    step = per.withColumn("_off", (F.col("_g") - F.lag("_g").over(w)) - (F.col(season) - F.lag(season).over(w)))
    return step.groupBy(person).agg(F.count("*").alias("seasons"), F.count_if(F.col("_off") == -1).alias("repeats"), F.count_if((F.col("_off") != 0) & (F.col("_off") != -1)).alias("breaks")).withColumn(
        "trusted", (F.col("seasons") >= least) & (F.col("breaks") == 0) & (F.col("repeats") <= 1)
    )


def binomial_tail(votes: Column, voters: Column, chance: float) -> Column:
    """The probability of ``votes`` or more of ``voters`` where each has ``chance``. Terms follow from each other in logs, so many voters don't underflow."""
    odds, first = math.log(chance / (1 - chance)), math.log(1 - chance)
    begin = F.struct((voters * F.lit(first)).alias("term"), F.lit(0.0).alias("sum"))

    def step(at: Column, k: Column) -> Column:
        more = F.when(k >= votes, F.exp(at["term"])).otherwise(0.0)
        return F.struct((at["term"] + F.log((voters - k) / (k + 1.0)) + F.lit(odds)).alias("term"), (at["sum"] + more).alias("sum"))

    below = F.aggregate(F.sequence(F.lit(0).cast("long"), voters.cast("long") - 1), begin, step)  # all but the last term
    return F.when(voters <= 0, 1.0).otherwise(F.least(F.lit(1.0), below["sum"] + F.when(votes <= voters, F.exp(voters * F.lit(math.log(chance)))).otherwise(0.0)))


def wrong_years(meets: DataFrame, rows: DataFrame, least: int, share: float, chance: float = 0.25, alpha: float = 1.0) -> DataFrame:
    """(meet, shift, votes, voters, chance): meets whose date should move by whole years. A voter is an athlete of the meet with seasons elsewhere; it votes
    for the shift, of -1, 0 and 1 years, that lands nearest its other seasons. The votes must be more than wrong votes of probability ``chance``
    each explain: their binomial tail is at most ``alpha``. rows: meet, person, year; meets: meet, year."""
    entry = rows.select("meet", "person").distinct().join(meets, "meet")
    elsewhere = rows.select("person", F.col("meet").alias("_m"), F.col("year").alias("_y")).distinct()
    seen = entry.join(elsewhere, "person").where("_m <> meet").groupBy("meet", "person", "year").agg(F.collect_set("_y").alias("ys"))  # a person's years
    miss = lambda s: F.array_min(F.transform("ys", lambda y: F.abs(y - F.col("year") - s)))
    vote = F.when((miss(0) <= miss(1)) & (miss(0) <= miss(-1)), 0).when(miss(-1) < miss(1), -1).when(miss(1) < miss(-1), 1)
    counted = seen.withColumn("shift", vote).groupBy("meet").agg(F.count("*").alias("voters"), *[F.count_if(F.col("shift") == s).alias(f"v{s + 1}") for s in (-1, 0, 1)])
    best = F.greatest("v0", "v2")
    return counted.where((F.col("voters") >= least) & (best >= share * F.col("voters"))).select("meet", F.when(F.col("v0") >= F.col("v2"), -1).otherwise(1).alias("shift"), best.alias("votes"), "voters", binomial_tail(best, F.col("voters"), chance).alias("chance")).where(F.col("chance") <= alpha)


def distance_verdicts(gaps: DataFrame, race: str, gap: str, listed: str, candidates: list[float], least: int, within: float) -> DataFrame:
    """(race, listed, suggested, median): races whose median log gap to the runners' own level fits another distance of ``candidates`` within ``within``
    and not the listed one. A gap of ln(d / listed) is a race run over d."""
    stat = gaps.groupBy(race, listed).agg(F.percentile(gap, 0.5).alias("median"), F.count("*").alias("n")).where(F.col("n") >= least)
    fits = F.array(*[F.struct(F.abs(F.col("median") - F.log(F.lit(d) / F.col(listed))).alias("off"), F.lit(d).alias("d")) for d in candidates])
    best = F.array_min(fits)
    return stat.where((F.abs("median") > within) & (best["off"] <= within)).select(race, listed, best["d"].alias("suggested"), "median", "n")


def mixture_split(rows: DataFrame, race: str, order: str, gap: str, least: int, share: float, apart: float) -> DataFrame:
    """(race, n, n_low, low, high, mixed) of every race of four rows or more: the cut of its sorted gaps with the least squares within both sides
    (the lower of equal cuts), the medians of the sides, and whether they are two races: each side of at least ``least`` rows and ``share`` of
    all, medians ``apart`` or more, and twice as far apart as the wider side's quartiles.

    Sums run over range partitions (:class:`.ranks.Ordered`), so a race may hold most of all rows.
    """
    from .ranks import Ordered

    known = rows.where(F.col(gap).isNotNull() & F.col(race).isNotNull()).select(F.col(race).alias("_r"), F.col(order).alias("_o"), F.col(gap).cast("double").alias("_g"))
    laid = Ordered(known, ["_r"], ["_g", "_o"])
    rows = laid.whole(laid.rows, {"n": (F.sum, F.lit(1)), "_m": (F.sum, F.col("_g"))}).where("n >= 4")
    # about the mean, so that squares don't cancel
    rows = rows.withColumn("_c", F.col("_g") - F.col("_m") / F.col("n"))
    run = laid.running(rows, {"i": F.lit(1), "s": F.col("_c"), "q": F.col("_c") * F.col("_c")})
    both = laid.whole(run, {"_s": (F.sum, F.col("_c")), "_q": (F.sum, F.col("_c") * F.col("_c"))})
    inside = F.col("_q") - F.col("s") ** 2 / F.col("i") - (F.col("_s") - F.col("s")) ** 2 / (F.col("n") - F.col("i"))
    sides = laid.whole(both, {"_cut": (F.min, F.when(F.col("i") < F.col("n"), F.struct(F.round(inside, 9).alias("w"), F.col("i").alias("n_low"))))}).withColumn("n_low", F.col("_cut.n_low"))

    def q(low: bool, p: float) -> Column:  # a side's rows are in order, so its quantile is one of them or lies between two
        at, size = (F.col("i") - 1, F.col("n_low")) if low else (F.col("i") - 1 - F.col("n_low"), F.col("n") - F.col("n_low"))
        away = F.abs(at - p * (size - 1))
        return F.sum(F.when(((F.col("i") <= F.col("n_low")) == F.lit(low)) & (away < 1), (1 - away) * F.col("_g")))

    got = sides.groupBy("_r", "n", "n_low").agg(q(True, 0.5).alias("low"), q(False, 0.5).alias("high"), (q(True, 0.75) - q(True, 0.25)).alias("_l"), (q(False, 0.75) - q(False, 0.25)).alias("_h"))
    small = F.least("n_low", F.col("n") - F.col("n_low"))
    far = F.col("high") - F.col("low")
    return got.select(F.col("_r").alias(race), "n", "n_low", "low", "high", ((small >= F.greatest(F.lit(least), F.lit(share) * F.col("n"))) & (far >= apart) & (far >= 2 * F.greatest("_l", "_h"))).alias("mixed"))


def resolve_grades(rows: DataFrame, pins: DataFrame, least: int, share: float, low: int = 1, high: int = 16) -> DataFrame:
    """(person, season, grade, method, trusted) of every person's season, by the first rule that gives a grade:

    pinned: it is stated in ``pins`` (person, season, grade). corroborated: at least ``least`` rows name it, and more than name any other.
    neighbours: the nearest seasons settled so far, before and after, put it at the same grade by a year a season (one side may be missing).
    field: at least ``share`` of the graded rows of the season's races by others name it, more than any other. unknown: none.

    A grade is trusted if it is pinned, or if the person's other settled seasons, two or more of all, mostly put it there. ``rows``: person, season,
    race, grade (null where none is given); grades beyond ``low`` and ``high`` are no evidence. Counts are made per grade, so a hot race is a few rows.
    """
    own = rows.select("person", "season", "race", F.when(F.col("grade").between(low, high), F.col("grade")).alias("grade"))
    seasons = own.select("person", "season").distinct()

    def leading(counts: DataFrame, keys: list[str], n: str) -> DataFrame:
        """The commonest grade per key with its count, the runner-up's count and the sum."""
        top = F.sort_array(F.collect_list(F.struct(F.col(n).alias("n"), "grade")), False)  # a few grades
        got = counts.groupBy(*keys).agg(top.alias("t"), F.sum(n).alias("all"))
        return got.select(*keys, F.col("t")[0]["grade"].alias("grade"), F.col("t")[0]["n"].alias("n"), F.coalesce(F.get("t", F.lit(1))["n"], F.lit(0)).alias("second"), "all")

    said = own.where("grade IS NOT NULL").groupBy("person", "season", "grade").agg(F.count("*").alias("n"))
    agreed = leading(said, ["person", "season"], "n").where(f"n >= {least} AND n > second").select("person", "season", F.col("grade").alias("agreed"))
    by_race = own.where("grade IS NOT NULL").groupBy("race", "grade").agg(F.count("*").alias("n"))
    mine = own.where("grade IS NOT NULL").groupBy("race", "person", "season", "grade").agg(F.count("*").alias("m"))
    went = own.select("race", "person", "season").distinct()
    others = went.join(by_race, "race").join(mine, ["race", "person", "season", "grade"], "left").groupBy("person", "season", "grade").agg(F.sum(F.col("n") - F.coalesce("m", F.lit(0))).alias("n")).where("n > 0")
    field = leading(others, ["person", "season"], "n").where(F.col("n") >= share * F.col("all")).where("n > second").select("person", "season", F.col("grade").alias("fielded"))
    pinned = pins.select("person", "season", F.col("grade").alias("pinned"))
    laid = seasons.join(pinned, ["person", "season"], "left").join(agreed, ["person", "season"], "left").join(field, ["person", "season"], "left")
    laid = laid.withColumn("_offset", F.coalesce("pinned", "agreed") - F.col("season"))
    w = Window.partitionBy("person").orderBy("season")  # one row a season
    before, after = F.last("_offset", True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.first("_offset", True).over(w.rowsBetween(1, Window.unboundedFollowing))
    near = F.when(F.coalesce(before, after) == F.coalesce(after, before), F.coalesce(before, after)) + F.col("season")
    got = laid.withColumn("_near", near).withColumn("_near", F.when(F.col("_near").between(low, high), F.col("_near")))
    rules = [("pinned", "pinned"), ("agreed", "corroborated"), ("_near", "neighbours"), ("fielded", "field")]
    method = F.coalesce(*[F.when(F.col(c).isNotNull(), name) for c, name in rules], F.lit("unknown"))
    got = got.select("person", "season", F.coalesce(*[F.col(c) for c, _ in rules]).alias("grade"), method.alias("method")).withColumn("_o", F.col("grade") - F.col("season"))
    same = F.count("_o").over(Window.partitionBy("person", "_o"))
    settled = F.count("_o").over(Window.partitionBy("person"))
    trusted = (F.col("method") == "pinned") | (F.col("grade").isNotNull() & (settled >= 2) & (2 * (same - 1) > settled - 1))
    return got.withColumn("trusted", F.coalesce(trusted, F.lit(False))).drop("_o")
