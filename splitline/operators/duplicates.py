"""Duplicate listings: ordered rules whose first reason wins, flags kept in a side table, readers by anti-join.

A listing has id, person, feed, meet, canon (the meet shared by feeds), event, dayno, place and tenths (time in tenths of a
second); some rules also read sport, gender, school and level. Each rule returns the ids it flags. Rows are never deleted. Joins have equality keys; a group of equal rows comes
down to its survivor by an aggregate, so no pairs of copies are built.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F


def later_copies(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Ids of rows that agree with a row of smaller id on ``keys``, nulls being equal."""
    first = rows.groupBy(*keys).agg(F.min("id").alias("_first"))
    same = [rows[k].eqNullSafe(first[k]) for k in keys]
    return rows.join(first, same).where(F.col("id") > F.col("_first")).select("id")


def other_feed(rows: DataFrame, keys: list[str], kept: str = "a") -> DataFrame:
    """Ids of rows of other feeds with a row of the ``kept`` feed under the same ``keys``."""
    there = rows.where(F.col("feed") == kept).select(*keys).distinct()
    return rows.where(F.col("feed") != kept).join(there, keys, "left_semi").select("id")


def near_time_other_feed(rows: DataFrame, keys: list[str], tolerance: int, kept: str = "a") -> DataFrame:
    """As :func:`other_feed`, times less than ``tolerance`` tenths apart: buckets of that width, each with its neighbours."""
    at = F.floor(F.col("tenths") / tolerance)
    near = rows.where(F.col("feed") == kept).select(*keys, F.col("tenths").alias("_t"), F.explode(F.array(at - 1, at, at + 1)).alias("_b")).distinct()
    mine = rows.where(F.col("feed") != kept).withColumn("_b", at)
    return mine.join(near, [*keys, "_b"]).where(F.abs(F.col("tenths") - F.col("_t")) < tolerance).select("id").distinct()


def rest_of_race(rows: DataFrame, flagged: DataFrame, race: list[str], share: float) -> DataFrame:
    """Ids of the rows, not flagged yet, of races of which at least ``share`` is flagged."""
    marked = rows.join(flagged.select("id").distinct().withColumn("_f", F.lit(1)), "id", "left")
    whole = marked.groupBy(*race).agg(F.count("_f").alias("_n"), F.count("*").alias("_all")).where(F.col("_n") >= share * F.col("_all"))
    return marked.where("_f IS NULL").join(whole, race, "left_semi").select("id")


def smaller_entry(rows: DataFrame, keys: list[str], days: tuple[int, int], tolerance: int = 0) -> DataFrame:
    """Ids of rows with a copy, by ``keys`` and a time within ``tolerance``, in another meet ``days`` (from, to) apart, that survives: the one in the
    bigger meet, then of smaller id."""
    size = rows.groupBy("meet").agg(F.count("*").alias("size"))
    all_rows = rows.join(size, "meet")
    low, high = days
    span = F.floor(F.col("dayno") / (high + 1))
    mine = all_rows.select("id", "meet", "dayno", "tenths", "size", *keys, F.explode(F.array(span - 1, span, span + 1)).alias("_s"))
    copy = all_rows.select(F.col("id").alias("_id"), F.col("meet").alias("_meet"), F.col("dayno").alias("_day"), F.col("tenths").alias("_t"), F.col("size").alias("_size"), *keys, span.alias("_s"))
    gap = F.abs(F.col("dayno") - F.col("_day"))
    survives = (F.col("_size") > F.col("size")) | ((F.col("_size") == F.col("size")) & (F.col("_id") < F.col("id")))
    apart = (F.col("meet") != F.col("_meet")) & gap.between(low, high) & (F.abs(F.col("tenths") - F.col("_t")) <= tolerance)
    return mine.join(copy, [*keys, "_s"]).where(apart & survives).select("id").distinct()


def race_copies(rows: DataFrame, least: int, share: float) -> DataFrame:
    """Ids of all rows of a race (meet, event) that shares ``least`` (person, time) entries, and ``share`` of its own, with a bigger race of the
    event, or an equal one of smaller number."""
    entry = rows.select("meet", "event", "person", "tenths").distinct()
    size = entry.groupBy("meet", "event").agg(F.count("*").alias("size"))
    e = entry.join(size, ["meet", "event"])
    a, b = e.select("event", "person", "tenths", F.col("meet").alias("small"), F.col("size").alias("n")), e.select("event", "person", "tenths", F.col("meet").alias("big"), F.col("size").alias("m"))
    common = a.join(b, ["event", "person", "tenths"]).where("m > n or (m = n and big < small)").groupBy("event", "small", "big", "n").agg(F.count("*").alias("c"))
    bad = common.where((F.col("c") >= least) & (F.col("c") >= share * F.col("n"))).select(F.col("small").alias("meet"), "event").distinct()
    return rows.join(bad, ["meet", "event"], "left_semi").select("id")


def shifted_races(rows: DataFrame, least: int, share: float, kept: str = "a") -> DataFrame:
    """Ids of the races of other feeds whose times are a kept race's of the same day and event plus one constant: ``least`` places agree on the
    shift, and ``share`` of the race's places do."""
    a = rows.where(F.col("feed") == kept).groupBy("meet", "event", "dayno", "place").agg(F.min("tenths").alias("t"))
    b = rows.where(F.col("feed") != kept).groupBy("meet", "event", "dayno", "place").agg(F.min("tenths").alias("u"))
    n = b.groupBy("meet", "event", "dayno").agg(F.count("*").alias("n"))
    pair = b.join(a.withColumnRenamed("meet", "_kept"), ["event", "dayno", "place"]).groupBy("meet", "event", "dayno", "_kept", (F.col("u") - F.col("t")).alias("shift")).agg(F.count("*").alias("c"))
    bad = pair.join(n, ["meet", "event", "dayno"]).where((F.col("c") >= least) & (F.col("c") >= share * F.col("n"))).select("meet", "event", "dayno").distinct()
    return rows.where(F.col("feed") != kept).join(bad, ["meet", "event", "dayno"], "left_semi").select("id")


def placeholders(rows: DataFrame, race: list[str], least: int, share: float) -> DataFrame:
    """Ids of rows with a time that at least ``least`` rows and ``share`` of their race have: not times but placeholders."""
    n = rows.groupBy(*race).agg(F.count("*").alias("_all"))
    same = rows.groupBy(*race, "tenths").agg(F.count("*").alias("_n")).join(n, race).where((F.col("_n") >= least) & (F.col("_n") >= share * F.col("_all")))
    return rows.join(same, [*race, "tenths"], "left_semi").select("id")


def converted(rows: DataFrame, keys: list[str], factor: float, tolerance: int) -> DataFrame:
    """Ids of rows whose time is ``factor`` times a row's of the same ``keys`` and another event: one run listed at two distances."""
    short = rows.select(*keys, F.col("event").alias("_event"), F.round(F.col("tenths") * factor).cast("long").alias("_t"))
    at = lambda c: F.floor(F.col(c) / (tolerance + 1))
    spread = short.select("*", F.explode(F.array(at("_t") - 1, at("_t"), at("_t") + 1)).alias("_b"))
    return rows.withColumn("_b", at("tenths")).join(spread, [*keys, "_b"]).where((F.col("event") != F.col("_event")) & (F.abs(F.col("tenths") - F.col("_t")) <= tolerance)).select("id").distinct()


def uploads(rows: DataFrame, keys: list[str], feed: str = "u") -> DataFrame:
    """Ids of uploaded rows that any other feed has under the same ``keys``."""
    there = rows.where(F.col("feed") != feed).select(*keys).distinct()
    return rows.where(F.col("feed") == feed).join(there, keys, "left_semi").select("id")


def sport_copies(rows: DataFrame, keys: list[str], copy: str = "xc", kept: str = "tf") -> DataFrame:
    """Ids of rows of one sport that the other sport has under the same ``keys``: a track race listed as cross country."""
    there = rows.where(F.col("sport") == kept).select(*keys).distinct()
    return rows.where(F.col("sport") == copy).join(there, keys, "left_semi").select("id")


def other_gender(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Ids of rows under the gender that a person has less often, where the same ``keys`` also stand under the other; ties are left alone."""
    n = rows.groupBy("person").agg(F.count_if(F.col("gender") == "M").alias("_m"), F.count_if(F.col("gender") == "F").alias("_f"))
    own = n.select("person", F.when(F.col("_m") > F.col("_f"), "M").when(F.col("_f") > F.col("_m"), "F").alias("_own"))
    marked = rows.join(own, "person").where("_own IS NOT NULL")
    there = marked.where("gender = _own").select(*keys).distinct()
    return marked.where("gender <> _own").join(there, keys, "left_semi").select("id")


def level_conflicts(rows: DataFrame, directory: DataFrame, level: str) -> DataFrame:
    """Ids of rows listed at ``level`` under a school that the directory, (school), has at another one."""
    return rows.where(F.col("level") == level).join(directory, "school", "left_semi").select("id")


def first_reasons(rows: DataFrame, rules: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """(id, reason): the first rule, in order, that flags each row."""
    found = None
    for i, (name, rule) in enumerate(rules):
        one = rule(rows).select("id", F.lit(i).alias("_i"), F.lit(name).alias("reason"))
        found = one if found is None else found.unionByName(one)
    return found.groupBy("id").agg(F.min_by("reason", "_i").alias("reason"))


def unflagged(rows: DataFrame, flags: DataFrame) -> DataFrame:
    return rows.join(flags, "id", "left_anti")


def pair_landed(landed: DataFrame, known: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """(id, match, strength) of landed rows against known ones: same ``keys``, seconds within ``tolerance``; 'strong' with the same name, 'weak' with
    the same school where the pair is one to one.

    ``landed`` and ``known``: id, name, school, seconds and the keys.
    """
    at = F.floor(F.col("seconds") / tolerance)
    k = known.select(*keys, F.col("id").alias("match"), F.col("name").alias("_name"), F.col("school").alias("_school"), F.col("seconds").alias("_seconds"), F.explode(F.array(at - 1, at, at + 1)).alias("_b"))
    pair = landed.withColumn("_b", at).join(k, [*keys, "_b"]).where(F.abs(F.col("seconds") - F.col("_seconds")) <= tolerance)
    strong = pair.where(F.col("name") == F.col("_name")).groupBy("id").agg(F.min("match").alias("match"))
    weak = pair.where((F.col("name") != F.col("_name")) & (F.col("school") == F.col("_school"))).select("id", "match")
    one = weak.groupBy("id").agg(F.count("*").alias("n"), F.min("match").alias("match")).where("n = 1")
    alone = weak.groupBy("match").agg(F.count("*").alias("m")).where("m = 1")
    weak = one.join(alone, "match").join(strong, "id", "left_anti").select("id", "match")
    return strong.withColumn("strength", F.lit("strong")).unionByName(weak.withColumn("strength", F.lit("weak")))


def race_verdicts(landed: DataFrame, pairs: DataFrame, race: list[str], share: float) -> DataFrame:
    """Per race: rows, matched rows, and 'copy', 'partial' or 'new' by the share matched."""
    got = landed.join(pairs.select("id", "strength"), "id", "left").groupBy(*race).agg(F.count("*").alias("n"), F.count("strength").alias("matched"))
    return got.withColumn("verdict", F.when(F.col("matched") >= share * F.col("n"), "copy").when(F.col("matched") > 0, "partial").otherwise("new"))
