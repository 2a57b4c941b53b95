"""Team and points scoring, hypothetical meets, unit boards, head-to-head matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .ranks import numbered, ranked_within


def team_scores(df: DataFrame, race: list[str], team: str, order: list[Column], scoring: int = 5, displacing: int = 7) -> DataFrame:
    """Cross-country scores: the first ``displacing`` of complete teams are renumbered, the first ``scoring`` places sum; ties to the next runner.

    Incomplete teams neither score nor displace; a missing sixth runner counts as 1,000,000.
    """
    mine = Window.partitionBy(*race, team)
    placed = df.withColumn("_t", F.row_number().over(mine.orderBy(*order))).withColumn("_n", F.count("*").over(mine))
    kept = placed.where((F.col("_n") >= scoring) & (F.col("_t") <= displacing))
    place = ranked_within(kept, race, order, "_p")  # one race may hold every team
    scored = place.groupBy(*race, team).agg(
        F.sum(F.when(F.col("_t") <= scoring, F.col("_p"))).alias("score"), F.coalesce(F.max(F.when(F.col("_t") == scoring + 1, F.col("_p"))), F.lit(1_000_000)).cast("long").alias("sixth")
    )
    return ranked_within(scored, race, [F.col("score"), F.col("sixth"), F.col(team)], "team_place")


POINTS = (10, 8, 6, 5, 4, 3, 2, 1)


def points(df: DataFrame, event: list[str], value: Column, points: tuple[int, ...] = POINTS) -> DataFrame:
    """Track points with split ties: tied entries share the mean of the points their places cover."""
    rank = F.rank().over(Window.partitionBy(*event).orderBy(value))
    ranked = df.withColumn("place", rank.cast("long")).withColumn("_tied", F.count("*").over(Window.partitionBy(*event, "place")))
    table = F.array(*[F.lit(float(p)) for p in points])
    covered = F.transform(F.sequence(F.col("place"), F.col("place") + F.col("_tied") - 1), lambda i: F.when(i <= len(points), F.get(table, (i - 1).cast("int"))).otherwise(0.0))
    return ranked.withColumn("points", F.when(F.col("place") > len(points), 0.0).otherwise(F.aggregate(covered, F.lit(0.0), lambda a, x: a + x) / F.col("_tied"))).drop("_tied")


def best_n_average(df: DataFrame, unit: list[str], value: str, key: str, n: int) -> DataFrame:
    w = Window.partitionBy(*unit).orderBy(F.desc(value), key)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).groupBy(*unit).agg(F.avg(value).alias("average"), F.count("*").alias("n_used"))


def win_matrix(df: DataFrame, race: str, team: str, score: str) -> DataFrame:
    """(team, opponent, wins, meetings) over shared races."""
    a, b = df.select(race, F.col(team).alias("team"), F.col(score).alias("s")), df.select(race, F.col(team).alias("opponent"), F.col(score).alias("t"))
    met = a.join(b, race).where("team <> opponent")
    return met.groupBy("team", "opponent").agg(F.count_if(F.col("s") < F.col("t")).alias("wins"), F.count("*").alias("meetings"))


def at_large(matrix: DataFrame, order: DataFrame, pool: str, seats: int) -> DataFrame:
    """Sequential at-large selection per pool: the next team in order, unless the team behind it holds a winning record over it.

    One pool's teams (a few hundred) are a group; the pick is sequential by nature.
    """
    import pandas as pd

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        teams = rows.sort_values(["position", "team"]).drop_duplicates("team")["team"].tolist()
        beat = {(r.team, r.opponent) for r in rows.itertuples() if r.opponent is not None and r.wins * 2 > r.meetings}
        out = []
        while teams and len(out) < seats:
            i = 1 if len(teams) > 1 and (teams[1], teams[0]) in beat else 0
            out.append(teams.pop(i))
        return pd.DataFrame({pool: rows[pool].iloc[0], "team": out, "seat": range(1, len(out) + 1)})

    kind = order.schema[pool].dataType.simpleString()
    team = order.schema["team"].dataType.simpleString()
    return order.join(matrix, "team", "left").groupBy(pool).applyInPandas(pick, f"{pool} {kind}, team {team}, seat long")


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the parts' text by MD5: the same on every machine, retry and engine."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def normal(*parts: Column) -> Column:
    """A standard normal number (Box-Muller) from the parts' text."""
    return F.sqrt(-2 * F.log(uniform(*parts, F.lit("a")))) * F.cos(2 * F.pi() * uniform(*parts, F.lit("b")))


def draws(field: DataFrame, race: str, person: str, team: str, mu: str, sigma: str, n: int, rho: float, seed: int) -> DataFrame:
    """(race, draw, person, team, _time): the time is exp(mu + sigma e), e = sqrt(rho) team + sqrt(1 - rho) own; a row per runner and draw, dealt by Spark."""
    rows = field.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n))))
    e = np.sqrt(rho) * normal(F.lit(seed), F.col(race), F.col("draw"), F.lit("team"), F.col(team)) + np.sqrt(1 - rho) * normal(F.lit(seed), F.col(race), F.col("draw"), F.lit("own"), F.col(person))
    return rows.select(race, "draw", person, team, F.exp(F.col(mu) + F.col(sigma) * e).alias("_time"))


def simulate(field: DataFrame, race: str, person: str, team: str, mu: str, sigma: str, n: int, rho: float, seed: int) -> DataFrame:
    """Win probability of each runner over ``n`` draws; the best time's ties split the win. Two aggregates and a join: no field is gathered."""
    t = draws(field, race, person, team, mu, sigma, n, rho, seed)
    best = t.groupBy(race, "draw").agg(F.min("_time").alias("_time"))
    first = t.join(best, [race, "draw", "_time"])
    ties = first.groupBy(race, "draw").agg(F.count("*").alias("_ties"))
    wins = first.join(ties, [race, "draw"]).groupBy(race, person).agg((F.sum(1 / F.col("_ties")) / n).alias("win"))
    return field.select(race, person).join(wins, [race, person], "left").select(race, person, F.coalesce("win", F.lit(0.0)).alias("win"))


def simulate_teams(field: DataFrame, race: str, person: str, team: str, mu: str, sigma: str, n: int, rho: float, seed: int) -> DataFrame:
    """(race, team, win): how often a team wins the scored race over ``n`` draws; places within a draw, five score, seven displace."""
    t = draws(field, race, person, team, mu, sigma, n, rho, seed)
    scored = team_scores(t, [race, "draw"], team, [F.col("_time"), F.col(person)])
    return scored.groupBy(race, team).agg((F.count_if(F.col("team_place") == 1) / n).alias("win"))
