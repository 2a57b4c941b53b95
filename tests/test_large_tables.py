"""Faults that showed on larger tables only."""

import random

import duckdb
from pyspark.sql import functions as F

from splitline.operators import results
from splitline.sources import reports


def test_level_of_equal_marks_to_the_last_bit(spark):
    r = random.Random(3)
    rows = []
    for p in range(600):
        base = r.uniform(0, 500)
        rows += [(p * 10 + k, p, k, round(base + r.choice([0, 0.01, 0.02, 0.05, 0.1]), 2)) for k in range(9)]
    df = spark.createDataFrame(rows, "id long, person long, dayno long, mark double")
    got = {(x.id, x.level, x.n_before) for x in results.above_level(df, "person", "dayno", "mark", 7, 0.8, 3).collect()}
    c = duckdb.connect()
    c.register("r", df.toArrow())
    sql = "SELECT a.id, quantile_cont(b.mark, 0.8) AS level, count(*) AS n FROM r a JOIN r b ON a.person = b.person AND b.dayno < a.dayno AND b.dayno >= a.dayno - 7 GROUP BY a.id, a.mark HAVING count(*) >= 3 AND a.mark > quantile_cont(b.mark, 0.8)"
    assert got == set(c.execute(sql).fetchall())


def test_tied_rows_of_one_id_have_one_order(spark):
    rows = [(1, 7, 400.0, 5, 0, t) for t in (97.0, 28.0, 55.0)]
    flags = []
    for order in (rows, rows[::-1], [rows[1], rows[2], rows[0]]):
        df = spark.createDataFrame(order, "id long, person long, distance double, dayno long, season long, seconds double").coalesce(1)
        got = results.season_bests(df, ["person", "distance"], "season", "seconds", ["dayno", "id", "seconds"])
        flags.append({x.seconds: (x.season_best, x.personal_best) for x in got.collect()})
    assert flags[0] == flags[1] == flags[2] == {28.0: (True, True), 55.0: (False, False), 97.0: (False, False)}


def test_season_best_query_orders_tied_ids(spark, tmp_path):
    from datetime import datetime

    from splitline import catalog

    def flags(marks):
        base = tmp_path / "-".join(map(str, marks))
        at = datetime(1997, 1, 1)
        for name, data, schema in (
            ("lineitem", [(1, 1, 1, m, at) for m in marks], "l_orderkey long, l_linenumber int, l_partkey long, l_extendedprice double, l_shipdate timestamp_ntz"),
            ("orders", [(1, 9)], "o_orderkey long, o_custkey long"),
            ("part", [(1, 4)], "p_partkey long, p_size int"),
        ):
            spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{base}/{name}.parquet")
        return sorted((x.season_best, x.personal_best) for x in catalog.queries()["season_best_flags"](spark, str(base)).collect())

    assert flags((9.0, 5.0)) == flags((5.0, 9.0)) == [(False, False), (True, True)]


def test_places_beyond_four_digits_are_voted():
    rows = [[str(i + 1), f"Runner {i}", f"Club {i % 7}", f"17:{i % 60:02d}.00"] for i in range(30_000)]
    assert reports.voted_columns(rows) == {0: "place", 1: "name", 2: "team", 3: "mark"}
    assert reports.voted_columns(rows[-50:]) == {0: "place", 1: "name", 2: "team", 3: "mark"}  # a later page of the same list


def test_keyed_lists_of_many_places_are_built_in_proportion(spark, tmp_path):
    import time

    from splitline import catalog

    keys = [3, 9, 10, *range(20, 400_000, 5)]
    spark.createDataFrame([(k, 1, float(k)) for k in keys], "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    start = time.monotonic()
    got = {x.c_custkey: float(x.name) for x in catalog.queries()["json_keyed_pages"](spark, str(tmp_path)).collect()}
    assert got == {k: float(k) for k in keys if k % 7}
    assert time.monotonic() - start < 60  # a look through the known keys at every place takes many minutes


def test_copies_of_places_cost_no_comparisons_and_lose_no_pair(spark):
    from itertools import combinations

    from splitline.operators import places

    spots = [("Old Mill Park", 40.0, -100.0), ("Old Mills", 40.01, -100.0), ("Lake", 40.0, -100.0), ("", 40.0, -100.0), ("Old Mill Park", 50.0, -100.0)]
    rows = [(k * 5 + s, *spot) for k in range(12) for s, spot in enumerate(spots)]
    df = spark.createDataFrame(rows, "id long, name string, lat double, lon double")
    mill = {0, 1}
    want = {(p[0], q[0]) for p, q in combinations(sorted(rows), 2) if p[1] and (p[1:] == q[1:] or {p[0] % 5, q[0] % 5} <= mill)}
    assert sorted((x.a, x.b) for x in places.near_places(df, 9000.0, 0.6).collect()) == sorted(want)
    links = places.near_links(df, 9000.0, 0.6)
    assert links.count() < 60  # not the hundreds of pairs
    got = {x.id: x.canonical for x in places.canonical_places(df, links).collect()}
    assert got == {r[0]: 0 if r[0] % 5 in mill else r[0] if r[0] % 5 == 3 else r[0] % 5 for r in rows}


def test_components_that_take_many_rounds(spark):
    import time

    from splitline.operators import setops

    n = 20_000
    start = time.monotonic()
    got = setops.components(spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))
    assert got.groupBy("component").count().collect() == [(0, n)]
    assert time.monotonic() - start < 90  # constraints kept by checkpoints doubled the planning of each round


def test_decoys_of_every_band_come_from_every_text():
    import numpy as np

    from splitline.llm import secrets

    r = random.Random(5)
    texts = ["".join(r.choice("abcdefXYZ0189 +-_/é.") for _ in range(n)).encode() for n in (1, 15, 16, 41, 300, 1_300, 5_000)] + [b"a" * 400]
    want = np.zeros(secrets.CELLS, dtype=np.int64)
    for text in texts:
        for name in secrets.ALPHABETS:
            codes = secrets.CODES[name][np.frombuffer(text, dtype=np.uint8)]
            codes = codes[codes < 255]
            for band, length in enumerate(secrets.BANDS):
                rows = codes[: len(codes) // length * length].reshape(-1, length)
                if len(rows):
                    want += np.bincount(secrets.cells(rows, name, band), minlength=secrets.CELLS)
    assert (secrets._decoys(texts) == want).all()


def test_many_cells_are_not_sent_and_draw_the_same(spark, monkeypatch):
    from splitline.operators import gibbs

    df = spark.createDataFrame([(p, p * k % 5, float(p % 7 + k)) for p in range(20) for k in range(4)], "p int, c int, y double")
    draw = lambda: {(x.chain, x["round"], x.cell): round(x.d, 9) for x in gibbs.draws(df, "p", "c", "y", chains=2, rounds=2, burn=1, seed=5)[0].collect()}
    sent = draw()
    monkeypatch.setattr(gibbs, "SENT", 0)
    assert draw() == sent and len(sent) == 10


def test_edges_come_in_tasks_of_bounded_rows(spark, monkeypatch):
    from splitline.operators import setops

    monkeypatch.setattr(setops, "ROWS", 1_000)
    assert setops.tasks_for(spark, 10) == 4 and setops.tasks_for(spark, 9_001) == 10
    edges = spark.range(6_000).select((F.col("id") % 3_000).alias("src"), (F.col("id") % 3_000 + 10_000).alias("dst"))  # each edge twice
    both = setops._both_ways(edges)
    assert both.count() == both.distinct().count() == 6_000 and both.select(F.input_file_name()).distinct().count() == 12


def test_closest_pairs_of_a_hot_key_sort_no_pairs(spark):
    from splitline.operators import joins

    r = random.Random(8)
    rows = [(r.choice([0, 0, 0, 1, 2]), r.choice("abc"), r.randrange(80), r.choice([0.0, 1.0, 2.5, None]), r.randrange(300)) for _ in range(900)]  # ids repeat, also across cells
    df = spark.createDataFrame(rows, "p int, c string, d long, v double, id long").union(spark.createDataFrame([(None, "a", 1, 1.0, 1), (0, None, 1, 1.0, 2), (0, "b", None, 1.0, 3)], "p int, c string, d long, v double, id long"))
    want = {}
    for p, c, d, _, i in rows:
        for q, e, f, _, j in rows:
            if p == q and c != e and i != j and 0 <= f - d <= 21:
                want[p, c, e] = min(want.get((p, c, e), (99, 0, 0)), (f - d, i, j))
    got = joins.closest_pairs(df, "p", "id", "d", "c", "v", 21)
    assert {(x.p, x.c1, x.c2): (x.gap, x.o1, x.o2) for x in got.collect()} == want
    sparse = df.where("id < 12")
    want = {}
    few = [x for x in rows if x[4] < 12]
    for p, c, d, _, i in few:
        for q, e, f, _, j in few:
            if p == q and c != e and i != j and 0 <= f - d <= 21:
                want[p, c, e] = min(want.get((p, c, e), (99, 0, 0)), (f - d, i, j))
    assert {(x.p, x.c1, x.c2): (x.gap, x.o1, x.o2) for x in joins.closest_pairs(sparse, "p", "id", "d", "c", "v", 21).collect()} == want
    hot = spark.range(20_000).select(F.lit(1).alias("p"), (F.col("id") % 3).alias("c"), (F.col("id") % 20).alias("d"), F.lit(1.0).alias("v"), "id")
    out = joins.closest_pairs(hot, "p", "id", "d", "c", "v", 21)
    assert {(x.c1, x.c2, x.gap) for x in out.collect()} == {(a, b, 0) for a in range(3) for b in range(3) if a != b}  # more than a hundred million pairs of rows
    assert "Window" in (plan := out._jdf.queryExecution().executedPlan().toString()) and plan.count("row_number") == 0


def test_lineups_take_few_options_of_a_large_roster(spark):
    from splitline.operators import results as res

    r = random.Random(9)
    rows = [(t, p, e, float(r.randrange(40))) for t in range(2) for p in range(400) for e in range(4) if r.random() < 0.8]
    rows += [(0, 5, 1, 39.0)] * 3 + [(1, 7, 2, None), (0, 9, 9, None)]

    def greedy(team):
        kept, people, events = [], {}, {}
        for _, p, e, x in sorted((o for o in rows if o[0] == team), key=lambda o: (o[3] is None, -(o[3] or 0), o[1], o[2])):
            if people.get(p, 0) < 2 and events.get(e, 0) < 3:
                people[p], events[e] = people.get(p, 0) + 1, events.get(e, 0) + 1
                kept.append((team, p, e, x))
        return kept

    df = spark.createDataFrame(rows, "team long, person long, event long, points double")
    frame = res.best_lineups(df, "team", "person", "event", "points", 2, 3)
    got = sorted((x.team, x.person, x.event, x.points) for x in frame.collect())
    assert str(got) == str(sorted(greedy(0) + greedy(1)))
    assert "WindowGroupLimit" in frame._jdf.queryExecution().executedPlan().toString()  # tasks keep a bounded number of options before any are moved


def test_fields_are_written_once(spark, monkeypatch):
    from splitline.operators import estimate

    names, written = [], estimate.written
    monkeypatch.setattr(estimate, "written", lambda df, what: names.append(what) or written(df, what))
    rows = [(k, k % 5, float(k % 7), float(k % 3)) for k in range(60)]
    df = spark.createDataFrame(rows, "race long, cell long, y double, s double")
    read = lambda: {(x.race, x.cell): (x.effect, round(x.adjusted, 9)) for x in estimate.field_adjusted(df, "race", "cell", "y", "s").collect()}
    sent = read()
    monkeypatch.setattr(estimate, "SENT", 0)
    assert read() == sent and len(sent) == 60
    assert names == ["fields", "field-means"] * 2


def test_boosted_trees_make_their_rows_once(spark):
    from splitline.operators import solve

    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def y(k):
        made.add(1)
        return float(k % 7)

    df = spark.range(60).select("id", y("id").alias("y"), (F.col("id") % 3).cast("double").alias("s"), (F.col("id") % 4 == 0).alias("held"))
    assert solve.gbt_baseline(df, ["s"], "y").count() == 60
    assert made.value <= 120  # not once for each pass of the fit


def test_decoys_of_plain_texts_are_counted_once(monkeypatch):
    import numpy as np

    from splitline.llm import secrets

    r = random.Random(6)
    texts = ["".join(r.choice("abcdefghijkXYZ0189 .") for _ in range(n)).encode() for n in (40, 700, 3_000, 200_000, 1_100_000)]
    want, counted = np.zeros(secrets.CELLS, dtype=np.int64), []
    for text in texts:
        for at in range(0, len(text), secrets.SLICE):
            for name in secrets.ALPHABETS:
                codes = secrets.CODES[name][np.frombuffer(text[at : at + secrets.SLICE], dtype=np.uint8)]
                codes = codes[codes < 255]
                for band, length in enumerate(secrets.BANDS):
                    rows = codes[: len(codes) // length * length].reshape(-1, length)
                    if len(rows):
                        want += np.bincount(secrets.cells(rows, name, band), minlength=secrets.CELLS)
    battery = secrets._battery
    monkeypatch.setattr(secrets, "_battery", lambda *a: counted.append(a[-2]) or battery(*a))
    assert (secrets._decoys(texts) == want).all()
    assert counted.count(64) == counted.count(62) > 0  # base64url has base64's
