"""Planted worlds and hand cases of the estimates, duplicate rules, places, sinks and parsers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from splitline.functions import curves, events, text
from splitline.operators import dataquality, duplicates, estimate, places, results, solve
from splitline.sources import sinks


def test_cg_matches_dense_least_squares(spark):
    r = random.Random(3)
    rows = [(p, c, 50.0 + 3 * p - 5 * c + r.gauss(0, 1)) for p in range(15) for c in range(6) if r.random() < 0.6]
    got, _ = solve.two_way_cg(spark.createDataFrame(rows, "p int, c int, y double"), "p", "c", "y")
    d = {x.c: x.difficulty for x in got.collect()}
    a = np.zeros((len(rows), 21))
    for i, (p, c, _) in enumerate(rows):
        a[i, p], a[i, 15 + c] = 1, 1
    fit = np.linalg.lstsq(a, np.array([y for _, _, y in rows]), rcond=None)[0][15:]
    assert [d[c] - d[0] for c in range(6)] == pytest.approx((fit - fit[0]).tolist(), abs=1e-4)


def test_within_regression_matches_dense_least_squares(spark):
    r = random.Random(4)
    rows = [(r.randrange(8), r.randrange(9), r.random(), r.random()) for _ in range(120)]
    rows = [(p, e, x, z, 2 * x - 3 * z + p - e + r.gauss(0, 0.1)) for p, e, x, z in rows]
    got = solve.within_regression(spark.createDataFrame(rows, "p int, e int, x double, z double, y double"), "p", "e", "y", ["x", "z"], rounds=200)
    a = np.zeros((len(rows), 19))
    for i, (p, e, x, z, _) in enumerate(rows):
        a[i, p], a[i, 8 + e], a[i, 17], a[i, 18] = 1, 1, x, z
    assert got == pytest.approx(np.linalg.lstsq(a, np.array([x[4] for x in rows]), rcond=None)[0][17:].tolist(), abs=1e-6)


def test_variance_components_are_found(spark):
    r = random.Random(5)
    cells = [r.gauss(0, 3) for _ in range(60)]
    rows = [(p, c, p + cells[c] + r.gauss(0, 2)) for p in range(80) for c in r.sample(range(60), 20)]
    df = spark.createDataFrame(rows, "p int, c int, y double")
    d, _ = solve.two_way_cg(df, "p", "c", "y")
    sigma2, tau2 = estimate.variance_components(df, "p", "c", "y", d.checkpoint())
    assert sigma2 == pytest.approx(4, rel=0.15) and tau2 == pytest.approx(9, rel=0.5)


def test_potentials_of_a_transition_graph(spark):
    rows = [("a", "b", 1.0, 0.1), ("b", "c", 2.0, 0.1), ("a", "c", 3.3, 0.2)]
    got = solve.node_potentials(spark.createDataFrame(rows, "x string, y string, edge double, se double"), "x", "y", "a")
    # weights 100, 100, 25: the loop's 0.3 is shared by the variances 1 : 1 : 4
    assert [got[k] for k in "abc"] == pytest.approx([0, 1.05, 3.1], abs=1e-6)


def test_robust_shape_ignores_outliers(spark):
    g = lambda d: 1.1 * math.log(d) - 0.02 * math.log(d) ** 2
    ds = [800.0, 1600.0, 3000.0, 5000.0, 8000.0, 10000.0]
    rows = [(a, b, g(b) - g(a) + (5.0 if (a, b) == (800.0, 1600.0) else 0.0), 0.01) for i, a in enumerate(ds) for b in ds[i + 1 :]]
    got = estimate.robust_shape(spark.createDataFrame(rows, "a double, b double, edge double, se double"), "a", "b", 2)
    assert got == pytest.approx([1.1, -0.02], abs=1e-6)


def test_era_curve(spark):
    rows = [(2000, 2001, -0.01, 10.0), (2001, 2002, -0.03, 10.0), (2000, 2002, -0.04, 5.0)]
    got = estimate.era_curve(spark.createDataFrame(rows, "a int, b int, s double, w double"), "a", "b", "s", "w", 0.0, 2002)
    assert got == pytest.approx({2000: 0.04, 2001: 0.03, 2002: 0.0}, abs=1e-6)


def test_spline_is_linear_beyond_its_ends(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 50, 51, 52)], "x double")
    rows = df.select(*[b.alias(f"b{i}") for i, b in enumerate(estimate.spline_basis("x", [5.0, 15.0, 30.0, 45.0]))]).collect()
    assert rows[0][1] == rows[1][1] == 0 and rows[4][1] - rows[3][1] == pytest.approx(rows[3][1] - rows[2][1])


def test_fdr_cut_of_a_planted_tail(spark):
    r = random.Random(6)
    rows = [(r.expovariate(1.5) * r.choice([-1, 1]),) for _ in range(20_000)] + [(12.0,)] * 100
    cut = dataquality.fdr_cut(spark.createDataFrame(rows, "z double"))
    assert 5.0 <= cut <= 12.0


def test_trees_beat_the_mean_on_held_out_rows(spark):
    r = random.Random(7)
    rows = [(i, x := r.random(), z := r.random(), 10 * (x > 0.5) + 5 * z + r.gauss(0, 0.3)) for i in range(2_000)]
    df = estimate.holdout(spark.createDataFrame(rows, "id int, x double, z double, y double"), "id", 0.3, 1)
    got = solve.gbt_baseline(df, ["x", "z"], "y").where("held").agg(F.avg(F.pow(F.col("y") - F.col("prediction"), 2)).alias("m"), F.var_pop("y").alias("v")).first()
    assert got["m"] < 0.2 * got["v"]


def test_first_reason_wins(spark):
    rows = [(1, 1, "a", 1, 1, "e", 0, 1, 100), (2, 1, "b", 2, 1, "e", 0, 1, 100), (3, 1, "a", 1, 1, "e", 0, 1, 100)]
    df = spark.createDataFrame(rows, "id int, person int, feed string, meet int, canon int, event string, dayno int, place int, tenths int")
    rules = [("twin", lambda e: duplicates.other_feed(e, ["canon", "event", "place", "tenths"])), ("same", lambda e: duplicates.later_copies(e, ["person", "tenths"]))]
    assert {r.id: r.reason for r in duplicates.first_reasons(df, rules).collect()} == {2: "twin", 3: "same"}
    # equal as bags: what stays and what is flagged is the whole listing
    flags = duplicates.first_reasons(df, rules)
    kept = duplicates.unflagged(df, flags).unionByName(df.join(flags, "id", "left_semi"))
    assert kept.exceptAll(df).isEmpty() and df.exceptAll(kept).isEmpty()


def test_prelim_and_final_are_kept(spark):
    rows = [(1, 1, "a", 1, 1, "prelim", 0, 1, 100), (2, 1, "a", 1, 1, "final", 0, 1, 100)]
    df = spark.createDataFrame(rows, "id int, person int, feed string, meet int, canon int, event string, dayno int, place int, tenths int")
    assert duplicates.later_copies(df, ["feed", "person", "dayno", "event", "tenths"]).count() == 0
    assert duplicates.smaller_entry(df, ["person", "feed", "place", "tenths"], (0, 0)).count() == 0


def test_the_bigger_meet_survives(spark):
    rows = [(1, 1, "a", 10, 1, "e", 0, 1, 100), (2, 1, "a", 20, 1, "e", 10, 1, 100), (3, 2, "a", 20, 1, "e", 10, 2, 101)]
    df = spark.createDataFrame(rows, "id int, person int, feed string, meet int, canon int, event string, dayno int, place int, tenths int")
    assert [r.id for r in duplicates.smaller_entry(df, ["person", "feed", "event", "place", "tenths"], (0, 21)).collect()] == [1]
    assert duplicates.smaller_entry(df, ["person", "feed", "event", "place", "tenths"], (0, 9)).count() == 0


def test_near_places_against_every_pair(spark):
    r = random.Random(8)
    rows = [(i, "Old Mill Park" if i % 2 else "Old Mills", r.uniform(-70, 70), r.uniform(-1, 1)) for i in range(150)]
    rows = [(i, n, lat * (0.01 if i < 75 else 1), lon) for i, n, lat, lon in rows]
    got = {(x.a, x.b) for x in places.near_places(spark.createDataFrame(rows, "id int, name string, lat double, lon double"), 20_000.0, 0.6).collect()}

    def metres(p, q):
        a = math.sin(math.radians(q[2] - p[2]) / 2) ** 2 + math.cos(math.radians(p[2])) * math.cos(math.radians(q[2])) * math.sin(math.radians(q[3] - p[3]) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(a))

    assert got == {(p[0], q[0]) for p in rows for q in rows if p[0] < q[0] and metres(p, q) <= 20_000}


def test_greedy_lineup(spark):
    rows = [("t", p, e, pts) for p, e, pts in [("a", "x", 9.0), ("a", "y", 8.0), ("a", "z", 7.0), ("b", "x", 6.0), ("c", "x", 5.0), ("b", "y", 4.0)]]
    got = results.best_lineups(spark.createDataFrame(rows, "team string, p string, e string, pts double"), "team", "p", "e", "pts", 2, 2)
    assert sorted((r.p, r.e) for r in got.collect()) == [("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")]


def test_curves_and_their_inverses(spark):
    row = spark.range(1).select(
        curves.riegel(F.lit(100.0), F.lit(0.0), 5.0).alias("r"), curves.race_rating(F.lit(0.0), F.lit(0.1), F.lit(1.0)).alias("z"), curves.tilted(F.lit(100.0), F.lit(-1.0)).alias("t"),
        curves.weather_factor(F.lit(99.0), 10.0, [(0.0, 0.0), (1.0, 1.0)]).alias("w"), curves.power_map(F.lit(75.0), [(50.0, 60.0), (100.0, 110.0)]).alias("p"), events.metres_of(F.lit("4x800m Relay")).alias("m"), text.person_key(F.lit("Lee, Ann Jr.")).alias("k"),
    ).first()
    assert (row.r, row.z, row.t, row.w, row.m, row.k) == (None, None, None, 1.0, None, "ann lee")
    assert row.p == pytest.approx(60 * (75 / 50) ** (math.log(110 / 60) / math.log(2)))


def test_spreadsheet_cells_and_empty_columns(spark):
    df = spark.createDataFrame([("=1+1", None, "-3"), ("plain", None, "@x"), (None, "", "\tq")], "a string, b string, c string")
    kept = sinks.without_empty_columns(df)
    assert kept.columns == ["a", "c"]
    assert [tuple(r) for r in kept.select(*[sinks.safe_cell(F.col(c)).alias(c) for c in kept.columns]).collect()] == [("'=1+1", "-3"), ("plain", "'@x"), (None, "'\tq")]


def test_class_year_drift_splits_a_person(spark):
    rows = [(1, 2000, 9), (1, 2001, 10), (1, 2002, 11), (1, 2003, 9), (2, 2000, 9), (2, 2004, 13)]
    got = {(r.p, r.s): r.part for r in places.person_splits(spark.createDataFrame(rows, "p int, s int, g int"), "p", "s", "g", 2, 1).collect()}
    assert got == {(1, 2000): 0, (1, 2001): 0, (1, 2002): 0, (1, 2003): 1, (2, 2000): 0, (2, 2004): 1}


def test_wrong_year_is_voted_out(spark):
    meets = spark.createDataFrame([(1, 2011), (2, 2010), (3, 2010), (4, 2009)], "meet int, year int")
    rows = spark.createDataFrame([(m, p, y) for m, y in [(1, 2011), (2, 2010), (3, 2010)] for p in range(5)] + [(4, 99, 2009)], "meet int, person int, year int")
    got = [(r.meet, r.shift, r.votes) for r in places.wrong_years(meets, rows, 3, 0.6).collect()]
    assert got == [(1, -1, 5)]


def test_columns_by_vote_of_their_rows():
    from splitline.sources import reports

    rows = [["1", "Ann Lee", "Oak", "11", "17:01.2"], ["2.", "Bo Ray", "Oak", "SR", "17:20.9"], ["2", "Cy Fox", "Elm", "9", "DNF"], ["4", "Di Orr", "Elm", "", "18:00.0"]]
    assert reports.voted_columns(rows) == {0: "place", 1: "name", 2: "team", 3: "grade", 4: "mark"}
    assert reports.voted_columns(rows[:2]) == {}
    assert list(reports.html_tables("<table>" + "".join(f"<tr><td>{i}</td><td>page {i}</td></tr>" for i in range(5)) + "</table>")) == []  # no mark, no results
    page = "<table><tr><td>menu</td></tr>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"
    got = [dict(zip(reports.FIELDS, r[1:])) for r in reports.html_tables(page)]
    assert [(r["place"], r["name"], r["grade"], r["mark"]) for r in got] == [("1", "Ann Lee", "11", "17:01.2"), ("2.", "Bo Ray", "SR", "17:20.9"), ("2", "Cy Fox", "9", "DNF"), ("4", "Di Orr", None, "18:00.0")]


@pytest.mark.parametrize("sent", [4_000_000, 40, 0])  # the cells' side, the persons' side, none
def test_solvers_keep_rows_in_their_buckets(spark, monkeypatch, sent):
    monkeypatch.setattr(solve, "SENT", sent)
    r = np.random.default_rng(12)
    rows = [(int(p), int(c), float(x), float(1e6 + 3 * x + p - 0.1 * c + e)) for p, c, x, e in zip(r.integers(0, 30, 900), r.integers(0, 80, 900), r.normal(size=900), r.normal(size=900))]
    df = spark.createDataFrame(rows, "p int, c int, x double, y double")
    sides = solve.Sides(df, "c", "p") if sent == 40 else solve.Sides(df, "p", "c", 1, [F.count("*").alias("n")])
    assert sides.sent == {4_000_000: "c", 40: "p", 0: None}[sent]
    for key in ("p", "c"):
        plan = sides.met(key, sides.by.get(key, sides.rows).groupBy(key).agg(F.count("*").alias("m")))._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan.lower() or sides.sent == key
    m = np.zeros((len(rows), 111))
    for i, (p, c, x, _) in enumerate(rows):
        m[i, p], m[i, 30 + c], m[i, 110] = 1, 1, x
    y = np.array([q[3] for q in rows])
    slope = np.linalg.lstsq(m, y, rcond=None)[0][110]
    assert solve.within_regression(df, "p", "c", "y", ["x"], tol=1e-12)[0] == pytest.approx(slope, abs=1e-7)
    d = np.linalg.lstsq(m[:, :110], y, rcond=None)[0][30:]
    cells = np.array([q[1] for q in rows])
    d -= d[cells].mean()
    got = {q.c: q.difficulty for q in solve.two_way_cg(df, "p", "c", "y", tol=1e-18)[0].collect()}
    assert max(abs(got[c] - d[c]) for c in got) < 1e-6 and len(got) == len(set(cells))
    means = {q.c: q.difficulty for q in solve.alternate(df, "p", "c", "y", 30)[1].collect()}
    assert max(abs(means[c] - d[c]) for c in means) < 1e-5


@pytest.mark.parametrize("sent, tasks", [(4_000_000, 8), (40, 16)])  # four of 32 buckets a task, then at most 40 numbers a task
def test_sums_by_the_sent_key_come_from_few_tasks(spark, monkeypatch, sent, tasks):
    monkeypatch.setattr(solve, "SENT", sent)
    monkeypatch.setattr(solve.F, "approx_count_distinct", solve.F.count_distinct)
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        df = spark.range(12_800).select((F.col("id") % 640).alias("p"), (F.col("id") * 7 % 30).alias("c"), (F.col("id") % 11).cast("double").alias("y"))
        sides = solve.Sides(df, "p", "c")
        assert sides.sent == "c" and sides.parts == 32
        for key, other, few in (("p", "c", True), ("c", "p", False)):
            table = sides.rows.groupBy(key).agg(F.sum("y").alias("t"))
            met = sides.met(key, table)
            assert not few or met.rdd.getNumPartitions() == tasks
            plain = df.join(df.groupBy(key).agg(F.sum("y").alias("t")), key).groupBy(other).agg(F.sum("t").alias("s"))
            assert {tuple(r) for r in met.groupBy(other).agg(F.sum("t").alias("s")).collect()} == {tuple(r) for r in plain.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
