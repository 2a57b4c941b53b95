"""Hand cases of the operators: ties, nulls, planted worlds, parsers."""

import pytest
from pyspark.sql import functions as F

from splitline.functions import curves, stats, text, times
from splitline.operators import aggregates, dataquality, joins, ranks, scoring, setops, solve, windows
from splitline.sources import files, html, reports


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("values, want", [([5.0], 5.0), ([1.0, 2.0, 3.0], 3.0), ([1.0, 2.0, 3.0, 4.0, 5.0], 4.6), ([], None)])
def test_type8_quantile(spark, values, want):
    got = one(spark, stats.type8(F.array(*map(F.lit, values)).cast("array<double>"), 0.8))
    assert got == want or abs(got - want) < 1e-9


@pytest.mark.parametrize("raw, want", [("4:05.2", 245.2), ("1:02:03", 3723.0), ("59.9", 59.9), ("DNF", None), ("", None)])
def test_parse_time(spark, raw, want):
    assert one(spark, times.parse_time(F.lit(raw))) == want


def test_week_key_is_a_friday(spark):
    assert str(one(spark, times.week_key(F.lit("2024-01-04").cast("date")))) == "2023-12-29"
    assert str(one(spark, times.week_key(F.lit("2024-01-05").cast("date")))) == "2024-01-05"


def test_name_similarity(spark):
    assert one(spark, text.similarity(F.lit("Van Cortlandt Park"), F.lit("van cortland"))) == 1.0
    assert one(spark, text.similarity(F.lit(""), F.lit("x"))) == 0.0


def test_piecewise_extrapolates(spark):
    knots = [(0.0, 0.0), (1.0, 1.0), (2.0, 4.0)]
    assert [one(spark, curves.piecewise(F.lit(x), knots)) for x in (-1.0, 0.5, 1.5, 3.0)] == [-1.0, 0.5, 2.5, 7.0]


def test_tied_points_are_shared(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 10.0), (3, 11.0)], "id int, t double").withColumn("e", F.lit(1))
    got = {r.id: r.points for r in scoring.points(df, ["e"], F.col("t")).collect()}
    assert got == {1: 9.0, 2: 9.0, 3: 6.0}


def test_incomplete_teams_do_not_displace(spark):
    rows = [("a", i) for i in (1, 3, 5, 7, 9)] + [("b", i) for i in (2, 4, 6)] + [("c", i) for i in (8, 10, 11, 12, 13, 14)]
    df = spark.createDataFrame(rows, "team string, t int").withColumn("race", F.lit(1))
    got = {r.team: (r.score, r.sixth, r.team_place) for r in scoring.team_scores(df, ["race"], "team", [F.col("t")]).collect()}
    assert got == {"a": (1 + 2 + 3 + 4 + 6, 1_000_000, 1), "c": (5 + 7 + 8 + 9 + 10, 11, 2)}


def test_bracket_leaves_out_own_cell_and_far_days(spark):
    df = spark.createDataFrame([(1, "x", 0, 10.0), (1, "y", 1, 4.0), (1, "y", 9, 100.0)], "p int, c string, d long, v double")
    got = {(r.c, r.d): (r.n_other, r.bracket) for r in joins.interval_bracket(df, ["p"], "c", "d", "v", 2).collect()}
    assert got == {("x", 0): (1, 6.0), ("y", 1): (1, -6.0), ("y", 9): (0, None)}


def test_as_of_takes_the_latest_at_or_before(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 5)], "k int, at int")
    right = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (1, 6, "c")], "k int, at int, v string")
    assert sorted((r.k, r.at, r.v) for r in joins.as_of(left, right, ["k"], "at", "v", "v").collect()) == [(1, 1, None), (1, 5, "b"), (2, 5, None)]


def test_components_of_a_long_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(150)] + [(1000, 1001), (7, 7)], "src long, dst long")
    got = {r.id: r.component for r in setops.components(df).collect()}
    assert got == {**{i: 0 for i in range(151)}, 1000: 1000, 1001: 1000}
    assert setops.components(df.limit(0)).count() == 0
    with pytest.raises(RuntimeError):
        setops.components(df, rounds=2)


def test_positions_over_partitions_and_hot_groups(spark):
    df = spark.createDataFrame([(i % 3 if i % 2 else None, i % 7, i) for i in range(500)], "g int, v int, id int").repartition(7)
    got = {r.id: (r.k, r.n) for r in ranks.ranked_within(df, ["g"], [F.desc("v"), F.col("id")], "k", "n").collect()}
    for g in (None, 0, 1, 2):
        own = sorted((-(i % 7), i) for i in range(500) if (i % 3 if i % 2 else None) == g)
        assert [got[i] for _, i in own] == [(k + 1, len(own)) for k in range(len(own))]
    assert ranks.numbered(df.limit(0), [F.col("id")]).count() == 0


def test_closest_pairs_with_zero_marks(spark):
    df = spark.createDataFrame([(1, "a", 0, 0.0, 1), (1, "b", 21, 3.0, 2), (1, "b", 22, 4.0, 3), (1, "a", 2, 2.0, 4)], "p int, c string, d long, v double, id int")
    got = sorted((r.c1, r.c2, r.o1, r.o2, r.gap, r.ratio) for r in joins.closest_pairs(df, "p", "id", "d", "c", "v", 21).collect())
    assert got == [("a", "b", 4, 2, 19, 1.5)]
    zero = joins.closest_pairs(df.where("id < 3"), "p", "id", "d", "c", "v", 21).collect()
    assert [(r.gap, r.ratio) for r in zero] == [(21, None)]


def test_medians_of_others(spark):
    df = spark.createDataFrame([("x", i, float(v)) for i, v in enumerate([5, 1, 9, 9, 2])] + [("y", 9, 1.0), ("z", 7, None)], "g string, id int, v double")
    got = {r.id: r.others for r in aggregates.median_of_others(df, ["g"], "v", "id").collect()}
    assert got == {0: 5.5, 1: 7.0, 2: 3.5, 3: 3.5, 4: 7.0, 9: None}


def test_smoothing_counts_a_day_once_and_matches_dense_least_squares(spark):
    import numpy as np

    rows = [(1, 0, 1.0), (1, 0, 3.0), (1, 4, 5.0), (1, 9, 2.0), (2, 3, 7.0)]
    got = {(r.p, r.d): r.level for r in solve.smooth_people(spark.createDataFrame(rows, "p int, d int, v double"), "p", "d", "v", 0.5, 2.0).collect()}
    # levels minimise the squared residuals over noise plus the squared steps over drift
    a = np.array([[2 / 2, 0, 0], [0, 1 / 2, 0], [0, 0, 1 / 2]]) + np.array([[1 / 2, -1 / 2, 0], [-1 / 2, 1 / 2 + 1 / 2.5, -1 / 2.5], [0, -1 / 2.5, 1 / 2.5]])
    want = np.linalg.solve(a, np.array([4 / 2, 5 / 2, 2 / 2]))
    assert [got[1, 0], got[1, 4], got[1, 9]] == pytest.approx(want.tolist(), abs=1e-4) and got[2, 3] == 7.0




def test_islands_and_records_on_empty(spark):
    df = spark.createDataFrame([], "k int, d long, o int, v double")
    assert windows.islands(df, "k", "d", "o", 3).count() == 0
    assert windows.running_record(df, ["k"], ["d", "o"], "v").count() == 0


def test_cg_recovers_planted_difficulties(spark):
    rows = [(p, c, 100.0 + 3 * p + 10 * c) for p in range(12) for c in range(5) if (p + c) % 3]
    got, info = solve.two_way_cg(spark.createDataFrame(rows, "p int, c int, y double"), "p", "c", "y")
    d = {r.c: r.difficulty for r in got.collect()}
    assert all(abs(d[c] - d[0] - 10 * c) < 1e-6 for c in range(5)) and info["iterations"] <= 10


def test_within_regression_recovers_slope(spark):
    rows = [(p, e, float((p * 7 + e * 3) % 11), 2.5 * ((p * 7 + e * 3) % 11) + p - 4 * e) for p in range(9) for e in range(8)]
    assert abs(solve.within_regression(spark.createDataFrame(rows, "p int, e int, x double, y double"), "p", "e", "y", ["x"])[0] - 2.5) < 1e-6


def test_neighbour_z_flags_the_odd_one(spark):
    rows = [(1, d, d, 50.0 + d % 2) for d in range(8)] + [(1, 9, 9, 90.0)]
    got = {r.o: r.z for r in dataquality.neighbour_z(spark.createDataFrame(rows, "k int, d int, o int, v double"), "k", "d", "o", "v", 4, 1.0).collect()}
    assert got[9] > 20 and all(abs(got[i]) < 3 for i in range(8))


def test_monte_carlo_splits_wins(spark):
    df = spark.createDataFrame([(1, 1, "a", 0.0, 0.1), (1, 2, "b", 0.0, 0.1)], "race int, p int, t string, mu double, s double")
    got = {r.p: r.win for r in scoring.simulate(df, "race", "p", "t", "mu", "s", 2000, 0.3, 1).collect()}
    assert abs(sum(got.values()) - 1) < 1e-9 and abs(got[1] - 0.5) < 0.05


REPORT = """County meet
    Name                    Year School               Finals  Points
=====================================================================
  1 Ann Lee                   12 Northside High      18:04.5       1
  2 Cy de la Cruz             JR West               1:18:05.1       2
 12 Bo Ek                        Westfield               DNF
"""


def test_report_columns_come_from_the_header(spark):
    df = spark.createDataFrame([(7, REPORT), (8, None), (9, "no header\n 1 x y z"), (10, "")], "id int, text string")
    got = [(r.id, r.place, r.name, r.grade, r.team, r.mark, r.points) for r in reports.rows_of(df, "id", "text").orderBy("line").collect()]
    assert got == [(7, "1", "Ann Lee", "12", "Northside High", "18:04.5", "1"), (7, "2", "Cy de la Cruz", "JR", "West", "1:18:05.1", "2"), (7, "12", "Bo Ek", None, "Westfield", "DNF", None)]
    assert one(spark, html.page_text(F.lit("<p>a &amp; b<script>x</script></p><!-- c -->d"))) == "a & b d"


def test_formats_are_sniffed():
    assert [reports.sniff(t) for t in ("<table>", "Name\tTime\na\t1", "Name,Time\nx,1", REPORT, "")] == ["html", "tab", "csv", "text", "text"]


def test_upsert_and_missing_columns(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, files.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert old.select(files.col_or_null(old, "w", "double")).dtypes == [("w", "double")]
