"""Cross-country lineups scored by simulation: which runners of a team win most often against a fixed field.

Every runner's time is drawn for every simulation from the hash of (seed, runner, draw), so all lineups meet the same draws and a task that is
run again draws the same. Draws are dealt to blocks; a block holds the field's times of its draws (a meet's entries, bounded by nature) and
scores every lineup in turn of its draws with NumPy, and Spark adds the blocks' wins up. Few lineups are all looked at; many are searched by
single swaps from the fastest, each round of swaps being one job.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .gibbs import normal
from .store import written

SCORING, DISPLACING = 5, 7


def drawn_times(field: DataFrame, draws: int, seed: int, per_block: int = 50) -> DataFrame:
    """(block, draw, person, team, t) from (person, team, mean, sd): log-normal times, sd in log time."""
    many = field.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    t = F.col("mean") * F.exp(F.col("sd") * normal(seed, "run", F.col("person"), F.col("draw")))
    return written(many.select(F.floor(F.col("draw") / per_block).alias("block"), "draw", "person", "team", t.alias("t")), "lineup-times")


def score_draw(ours: np.ndarray, t: np.ndarray, team: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(points won, score) of every lineup in one race. ``ours``: a line of sorted times per lineup; ``t``, ``team``: the others in order of time.

    The first five of a team score their places, the sixth and seventh displace, others and teams under five don't count. The lowest score wins; of
    equal ones the better sixth runner, where both have one, else they share.
    """
    place_in_team = pd.Series(team).groupby(team).cumcount().to_numpy() if len(team) else np.zeros(0, int)
    size = {k: int((team == k).sum()) for k in np.unique(team)}
    count = np.array([size[k] >= SCORING for k in team], dtype=bool) & (place_in_team < DISPLACING)
    t, team, place_in_team = t[count], team[count], place_in_team[count]
    own_places = np.searchsorted(t, ours, side="right") + np.arange(1, ours.shape[1] + 1)
    score = own_places[:, :SCORING].sum(axis=1)
    ahead = (ours[:, None, :] < t[None, :, None]).sum(axis=2)  # ours before each other runner
    places = ahead + np.arange(1, len(t) + 1)
    won = np.ones(len(ours))
    for k in np.unique(team):
        mine = np.flatnonzero(team == k)
        other = places[:, mine[:SCORING]].sum(axis=1)
        sixth = own_places[:, SCORING] if ours.shape[1] > SCORING else None
        tie = 0.5 if sixth is None or len(mine) <= SCORING else (sixth < places[:, mine[SCORING]]).astype(float)
        won = np.minimum(won, np.where(score < other, 1.0, np.where(score == other, tie, 0.0)))
    return won, score


def evaluate(times: DataFrame, team, lineups: list[tuple]) -> dict[tuple, tuple[float, float]]:
    """{lineup: (share of races won, mean score)} of lineups of five runners or more; shorter ones never win."""
    found = {x: (0.0, math.inf) for x in lineups if len(x) < SCORING}
    wanted = [x for x in lineups if len(x) >= SCORING]
    if not wanted:
        return found

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        won, total, n = np.zeros(len(wanted)), np.zeros(len(wanted)), 0
        for _, race in rows.groupby("draw"):
            mine = race[race["team"] == team]
            by = dict(zip(mine["person"], mine["t"]))
            others = race[race["team"] != team].sort_values(["t", "person"])
            for k in sorted({len(x) for x in wanted}):
                at = [i for i, x in enumerate(wanted) if len(x) == k]
                w, s = score_draw(np.sort([[by[p] for p in wanted[i]] for i in at], axis=1), others["t"].to_numpy(), others["team"].to_numpy())
                won[at] += w
                total[at] += s
            n += 1
        return pd.DataFrame({"lineup": np.arange(len(wanted)), "won": won, "total": total, "n": n})

    got = times.groupBy("block").applyInPandas(run, "lineup long, won double, total double, n long").groupBy("lineup").agg(*[F.sum(c).alias(c) for c in ("won", "total", "n")])
    return found | {wanted[r["lineup"]]: (r["won"] / r["n"], r["total"] / r["n"]) for r in got.collect()}  # a row a lineup asked for


def best_lineup(field: DataFrame, team, k: int = DISPLACING, draws: int = 2000, seed: int = 0, enumerate_up_to: int = 500) -> dict:
    """The ``k`` runners of ``team`` that win most often (of equals, with the lowest mean score, then the smallest ids) against the rest of
    ``field`` (person, team, mean, sd), with the share of wins, the mean score, how many lineups were looked at and how."""
    field = written(field, "lineup-field")
    own = [r["person"] for r in field.where(F.col("team") == team).orderBy("mean", "person").collect()]  # one team's roster
    times = drawn_times(field, draws, seed)
    rank = lambda x: (-seen[x][0], seen[x][1], x)
    if len(own) <= k or math.comb(len(own), k) <= enumerate_up_to:
        seen = evaluate(times, team, [tuple(sorted(c)) for c in itertools.combinations(own, min(k, len(own)))])
        best, method = min(seen, key=rank), "all"
    else:
        best, method = tuple(sorted(own[:k])), "swaps"
        seen = evaluate(times, team, [best])
        while True:
            swaps = [tuple(sorted({*best, b} - {a})) for a in best for b in own if b not in best]
            seen |= evaluate(times, team, [x for x in swaps if x not in seen])
            better = min([best, *swaps], key=rank)
            if better == best:
                break
            best = better
    return {"lineup": list(best), "p_win": seen[best][0], "score": seen[best][1], "looked_at": len(seen), "method": method}
