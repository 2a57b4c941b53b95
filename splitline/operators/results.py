"""Results and boards: personal records in a distance band, floors, masks, ceilings, marks to qualify, training paces, course ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import stats


def band_records(results: DataFrame, standards: DataFrame, person: str, day: str, distance: str, value: str, tolerance: float) -> DataFrame:
    """Results with their standard distance (``std``), the person's best value before that day in its band (``previous``), how many there were, and ``pr``.

    A small list of standards is joined by its band; the best before is a window over whole days, so results of one day don't precede each other.
    """
    banded = results.join(standards, F.col(distance).between(F.col("std") * (1 - tolerance), F.col("std") * (1 + tolerance)))  # Spark sends the list by its size
    before = Window.partitionBy(person, "std").orderBy(day).rangeBetween(Window.unboundedPreceding, -1)
    got = banded.withColumn("previous", F.min(value).over(before)).withColumn("n_before", F.count(value).over(before))
    return got.withColumn("pr", F.col("previous").isNotNull() & (F.col(value) < F.col("previous")))


def season_bests(results: DataFrame, keys: list[str], season: str, value: str, order: list[str]) -> DataFrame:
    """Each row with ``season_best`` (it is the season's best so far) and ``personal_best`` (of all seasons so far); firsts count as bests."""
    w = lambda *k: Window.partitionBy(*k).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    better = lambda before: before.isNull() | (F.col(value) < before)
    return results.withColumn("season_best", better(F.min(value).over(w(*keys, season)))).withColumn("personal_best", better(F.min(value).over(w(*keys))))


def race_floor(n_races: Column, season: Column, open_from: int, floor: int = 3, explicit: int | None = None) -> Column:
    """Enough races to be ranked: the reader's own minimum for every season, else ``floor`` for seasons before ``open_from``."""
    return n_races >= explicit if explicit is not None else (n_races >= floor) | (season >= open_from)


def with_units(meets: DataFrame, units: DataFrame, meet: str, wanted: dict[str, str]) -> DataFrame:
    """Meets that are a championship of every wanted (kind: unit): one semi-join per kind. ``units``: (meet, kind, unit)."""
    for kind, unit in wanted.items():
        meets = meets.join(units.where((F.col("kind") == kind) & (F.col("unit") == unit)).select(meet), meet, "left_semi")
    return meets


def with_levels(meets: DataFrame, mask: str, levels: int) -> DataFrame:
    """Meets whose level mask shares a bit with ``levels``."""
    return meets.where(F.col(mask).bitwiseAND(levels) != 0)


def ceiling_census(rows: DataFrame, ceilings: DataFrame, pool: str, value: str) -> DataFrame:
    """Rows with ``above``: over their pool's ceiling. They are marked, not dropped; a pool without a ceiling marks none."""
    return rows.join(ceilings, pool, "left").withColumn("above", F.coalesce(F.col(value) > F.col("ceiling"), F.lit(False))).drop("ceiling")


def marks_to_qualify(places: DataFrame, group: list[str], season: str, place: str, value: str, last: int) -> DataFrame:
    """Per group: the mark of the ``last`` qualifying place by season, as median and quartiles over the seasons, its trend a season, and their number.

    ``thin`` where fewer than three seasons count.
    """
    cut = places.where(F.col(place) <= last).groupBy(*group, season).agg(F.max(value).alias("_v"), F.count("*").alias("_n")).where(F.col("_n") >= last)
    return cut.groupBy(*group).agg(
        F.percentile("_v", 0.5).alias("mark"), F.percentile("_v", 0.25).alias("low"), F.percentile("_v", 0.75).alias("high"), F.regr_slope("_v", season).alias("trend"), F.count("*").alias("seasons")
    ).withColumn("thin", F.col("seasons") < 3)


def first_after_last(rows: DataFrame, person: str, season: str, level: str, value: str, low: str, high: str) -> DataFrame:
    """Per person with seasons at both levels: the last season at ``low`` before the first at ``high``, that first one, and the change of value."""
    first = rows.where(F.col(level) == high).groupBy(person).agg(F.min_by(F.struct(season, value), season).alias("h"))
    before = rows.where(F.col(level) == low).join(first, person).where(F.col(season) < F.col("h")[season])
    last = before.groupBy(person).agg(F.max_by(F.struct(season, value), season).alias("l"), F.first("h").alias("h"))
    return last.select(person, F.col("l")[season].alias("from_season"), F.col("h")[season].alias("to_season"), (F.col("h")[value] - F.col("l")[value]).alias("change"))


def transfers(rows: DataFrame, person: str, season: str, school: str) -> DataFrame:
    """Seasons in which a person is at another school than in the person's season before."""
    w = Window.partitionBy(person).orderBy(season)
    return rows.withColumn("from_school", F.lag(school).over(w)).where(F.col("from_school") != F.col(school))


def course_ranks(results: DataFrame, course: str, gap: str, least: int) -> DataFrame:
    """Courses by their median gap, largest first, with number of results; ``least`` results to be ranked; ties by course."""
    from .ranks import numbered

    per = results.groupBy(course).agg(F.percentile(gap, 0.5).alias("median_gap"), F.count("*").alias("n")).where(F.col("n") >= least)
    return numbered(per, [F.desc("median_gap"), F.col(course)], "rank")


def critical_speed(results: DataFrame, person: str, distance: str, seconds: str, least: int) -> DataFrame:
    """Per person with ``least`` distances: critical speed (slope of distance on time over the bests per distance) and reserve (its intercept)."""
    best = results.groupBy(person, distance).agg(F.min(seconds).alias("_t"))
    fit = best.groupBy(person).agg(F.regr_slope(F.col(distance), F.col("_t")).alias("speed"), F.regr_intercept(F.col(distance), F.col("_t")).alias("reserve"), F.count("*").alias("n"))
    return fit.where((F.col("n") >= least) & F.col("speed").isNotNull())


def above_level(rows: DataFrame, person: str, day: str, value: str, days: int, q: float, least: int) -> DataFrame:
    """Rows above the ``q`` quantile of the person's results of the ``days`` days before, with that level and their number."""
    span = F.floor(F.col(day) / days)
    now = rows.select("*", F.explode(F.array(span - 1, span)).alias("_s"))
    before = rows.select(F.col(person).alias("_p"), F.col(day).alias("_d"), F.col(value).alias("_v"), span.alias("_s"))
    near = (F.col("_d") < F.col(day)) & (F.col("_d") >= F.col(day) - days)
    pair = now.join(before, (now[person] == before["_p"]) & (now["_s"] == before["_s"])).where(near)
    # a row's own values of the window, in order; whether a mark equal to its level passes hangs on the level's last bit
    sorted_ = pair.groupBy("id").agg(F.sort_array(F.collect_list("_v")).alias("_v"), F.count("*").alias("n_before")).where(F.col("n_before") >= least)
    level = sorted_.select("id", stats.quantile(F.col("_v"), q).alias("level"), "n_before")
    return rows.join(level, "id").where(F.col(value) > F.col("level"))


def common_opponents(matrix: DataFrame) -> DataFrame:
    """(team, opponent, better, worse): over the third teams both met, how often the first has the higher winning share, and the lower. ``matrix``: (team, opponent, wins, meetings)."""
    share = matrix.select("team", "opponent", F.try_divide(F.col("wins"), F.col("meetings")).alias("s"))
    a, b = share.select(F.col("team").alias("a"), F.col("opponent").alias("third"), F.col("s").alias("x")), share.select(F.col("team").alias("b"), F.col("opponent").alias("third"), F.col("s").alias("y"))
    both = a.join(b, "third").where("a <> b and third <> a and third <> b")
    return both.groupBy(F.col("a").alias("team"), F.col("b").alias("opponent")).agg(F.count_if(F.col("x") > F.col("y")).alias("better"), F.count_if(F.col("x") < F.col("y")).alias("worse"))


def best_lineups(options: DataFrame, team: str, person: str, event: str, points: str, per_person: int, per_event: int, events: int | None = None) -> DataFrame:
    """A team's entries by greedy choice: highest points first, at most ``per_person`` events a person and ``per_event`` entries an event.

    The choice is sequential, on a group that the number of ``events`` bounds (counted where not given; not less than a team's), not the roster. Of a
    person's options in one event only the first ``per_person`` can be taken. At most ``per_event`` * ``events`` entries are taken at all, so no more
    options of an event than that fall to persons who have enough: its best ``per_event`` * (``events`` + 1) hold ``per_event`` that are taken, unless
    the event was full before, and none behind them can be.
    """
    import pandas as pd

    if events is None:
        events = options.agg(F.count_distinct(F.coalesce(F.col(event).cast("string"), F.lit("\0")))).first()[0]
    best = F.nanvl(F.col(points).cast("double"), F.lit(None)).desc_nulls_last()
    own = options.select(team, person, event, points).withColumn("_k", F.row_number().over(Window.partitionBy(team, person, event).orderBy(best))).where(F.col("_k") <= per_person)
    near = own.withColumn("_k", F.row_number().over(Window.partitionBy(team, event).orderBy(best, person))).where(F.col("_k") <= per_event * (events + 1))

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([points, person, event], ascending=[False, True, True])
        by_person: dict = {}
        by_event: dict = {}
        keep = []
        for p, e in zip(rows[person], rows[event]):
            ok = by_person.get(p, 0) < per_person and by_event.get(e, 0) < per_event
            keep.append(ok)
            if ok:
                by_person[p], by_event[e] = by_person.get(p, 0) + 1, by_event.get(e, 0) + 1
        return rows[keep]

    schema = ", ".join(f"{c} {options.schema[c].dataType.simpleString()}" for c in (team, person, event, points))
    return near.drop("_k").groupBy(team).applyInPandas(pick, schema)


def training_paces(speeds: DataFrame, speed: str, zones: list[tuple[str, float]]) -> DataFrame:
    """(..., zone, pace): seconds a kilometre of each training zone, a share of the critical speed in metres a second. Speeds that aren't positive
    have no paces."""
    zone = F.explode(F.array(*[F.struct(F.lit(n).alias("zone"), F.lit(s).alias("share")) for n, s in zones]))
    got = speeds.where(F.col(speed) > 0).withColumn("_z", zone)
    return got.select(*speeds.columns, F.col("_z.zone").alias("zone"), (1000.0 / (F.col(speed) * F.col("_z.share"))).alias("pace"))
