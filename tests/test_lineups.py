"""Lineups by simulation against a plain Python race, and in fields with a known answer."""

import itertools
import random
from collections import defaultdict

import pytest

from splitline.operators import lineups

FIELD = "person long, team string, mean double, sd double"


def plain_race(times):
    """times: (t, person, team). {team: (score, sixth place or None)}."""
    by = defaultdict(list)
    for t, p, team in sorted(times):
        by[team].append(p)
    runs = {p for ps in by.values() if len(ps) >= 5 for p in ps[:7]}
    place = {p: i + 1 for i, (_, p, _) in enumerate(x for x in sorted(times) if x[1] in runs)}
    return {team: (sum(place[p] for p in ps[:5]), place[ps[5]] if len(ps) > 5 else None) for team, ps in by.items() if len(ps) >= 5}


def field_of(r, sizes):
    rows = []
    for team, n in sizes.items():
        rows += [(len(rows) + i, team, 900 + r.gauss(0, 30), 0.03) for i in range(n)]
    return rows


def test_every_lineup_against_a_plain_simulation(spark):
    r = random.Random(1)
    rows = field_of(r, {"a": 8, "b": 7, "c": 6, "d": 4, "e": 9})
    times = lineups.drawn_times(spark.createDataFrame(rows, FIELD), 40, 3, per_block=7)
    drawn = defaultdict(list)
    for x in times.collect():
        drawn[x.draw].append((x.t, x.person, x.team))
    wanted = [tuple(c) for k in (5, 7) for c in list(itertools.combinations([q[0] for q in rows if q[1] == "a"], k))[:9]]
    got = lineups.evaluate(times, "a", [*wanted, (0, 1)])
    assert got[0, 1][0] == 0
    for line in wanted:
        won = score = 0
        for race in drawn.values():
            out = plain_race([x for x in race if x[2] != "a" or x[1] in line])
            mine, sixth = out.pop("a")
            score += mine
            share = 1.0
            for s, six in out.values():
                share = min(share, 1.0 if mine < s else 0.0 if mine > s else 0.5 if sixth is None or six is None else float(sixth < six))
            won += share
        assert got[line] == (pytest.approx(won / 40), pytest.approx(score / 40))


def test_the_best_of_all_and_swaps_agree_with_the_fastest(spark):
    r = random.Random(2)
    rows = field_of(r, {"b": 7, "c": 7}) + [(100 + i, "a", 880.0 + 8 * i, 0.005) for i in range(10)]
    df = spark.createDataFrame(rows, FIELD)
    whole = lineups.best_lineup(df, "a", draws=30, enumerate_up_to=200)
    swaps = lineups.best_lineup(df, "a", draws=30, enumerate_up_to=10)
    assert whole["method"] == "all" and whole["looked_at"] == 120 and swaps["method"] == "swaps" and swaps["looked_at"] < 60
    assert set(range(100, 105)) <= set(whole["lineup"]) and (swaps["p_win"], swaps["score"]) == (whole["p_win"], whole["score"])
    few = lineups.best_lineup(spark.createDataFrame(rows[:18], FIELD), "a", draws=5)
    assert few["p_win"] == 0 and few["lineup"] == [100, 101, 102, 103]
