"""Merges with forbidden pairs and stable ids, rank trees, running sums of hot groups, and generalised least squares."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from splitline.operators import gls, merging, places, rank_trees, ranks


def plain_merge(ids, votes, apart, least):
    cls = {i: i for i in ids}
    while True:
        edge, bad = defaultdict(float), {tuple(sorted((cls[a], cls[b]))) for a, b in apart}
        for a, b, v in votes:
            if cls[a] != cls[b]:
                edge[tuple(sorted((cls[a], cls[b])))] += v
        edge = {e: v for e, v in edge.items() if v >= least and e not in bad}
        best = {}
        for (x, y), v in sorted(edge.items(), key=lambda q: (-q[1], q[0])):
            best.setdefault(x, y), best.setdefault(y, x)
        moved = {max(x, y): min(x, y) for x, y in best.items() if best[y] == x}
        if not moved:
            return cls
        cls = {i: moved.get(c, c) for i, c in cls.items()}


def test_merges_hold_no_forbidden_pair(spark):
    r = random.Random(4)
    votes = [(*r.sample(range(60), 2), float(r.randrange(1, 9))) for _ in range(150)]
    apart = [tuple(r.sample(range(60), 2)) for _ in range(25)]
    got = {x.id: x["class"] for x in merging.merge_classes(spark.range(60), spark.createDataFrame(votes, "a long, b long, votes double"), spark.createDataFrame(apart, "a long, b long"), 3).collect()}
    assert got == plain_merge(range(60), votes, apart, 3)
    assert all(got[a] != got[b] for a, b in apart) and len(set(got.values())) < 40


def test_ids_survive_a_rerun_with_new_rows(spark):
    first = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (5, 5)], "id long, class long")
    one = merging.keep_ids(first, None).checkpoint()
    ids = lambda df: {r.id: r.stable for r in df.collect()}
    assert ids(one) == {1: 1, 2: 1, 3: 2, 4: 2, 5: 3}
    # 0 joins the first class and so renames it; 3 and 4 part; 9 is new
    second = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 3), (4, 4), (5, 5), (9, 9)], "id long, class long")
    assert ids(merging.keep_ids(second, one)) == {0: 1, 1: 1, 2: 1, 3: 2, 4: 4, 5: 3, 9: 5}


def test_running_sums_of_a_group_with_most_rows(spark):
    r = np.random.default_rng(1)
    rows = [(None if i % 9 == 8 else int(i % 9 > 5), i, float(v)) for i, v in enumerate(r.normal(size=3_000))]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one partition
    try:
        laid = ranks.Ordered(spark.createDataFrame(rows, "g int, i long, v double"), ["g"], ["v", "i"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [x["count"] for x in laid.rows.groupBy("_part").count().collect()]
    assert max(sizes) < 0.5 * len(rows)  # the hot group holds two thirds
    got = laid.running(laid.running(laid.rows, {"k": F.lit(1), "s": F.col("v")}), {"back": F.lit(1)}, reverse=True).collect()
    want = {}
    for g in (None, 0, 1):
        mine = sorted((v, i) for q, i, v in rows if q == g)
        for k, ((v, i), s) in enumerate(zip(mine, np.cumsum([v for v, _ in mine])), 1):
            want[i] = (k, pytest.approx(s, abs=1e-9), len(mine) - k + 1)
    assert {x.i: (x.k, x.s, x.back) for x in got} == want


def test_a_race_of_two_distances_is_split(spark):
    r = random.Random(6)
    rows = [("two", i, r.gauss(0.0 if i % 3 else 0.45, 0.03)) for i in range(60)] + [("one", 100 + i, r.gauss(0, 0.08)) for i in range(60)] + [("few", 200, 0.1)]
    got = {x.race: x for x in places.mixture_split(spark.createDataFrame(rows, "race string, id long, gap double"), "race", "id", "gap", 5, 0.1, 0.2).collect()}
    assert set(got) == {"one", "two"} and got["two"].mixed and got["two"].n_low == 40 and not got["one"].mixed
    assert got["two"].high - got["two"].low == pytest.approx(0.45, abs=0.03)


def test_wrong_votes_by_chance(spark):
    from math import comb

    rows = [(v, n) for n in (1, 5, 30, 400) for v in {0, 1, n // 3, n, n + 1}]
    got = spark.createDataFrame(rows, "v long, n long").select("v", "n", places.binomial_tail(F.col("v"), F.col("n"), 0.3).alias("p")).collect()
    for x in got:
        assert x.p == pytest.approx(sum(comb(x.n, k) * 0.3**k * 0.7 ** (x.n - k) for k in range(x.v, x.n + 1)), abs=1e-12)


def test_rank_trees_order_better_than_squares(spark):
    """The order depends on one feature; marks have a race's own level and a heavy tail, which squares chase."""
    from pyspark.ml.regression import GBTRegressor

    r = np.random.default_rng(3)
    rows = []
    for race in range(60):
        level = r.normal(0, 5)
        for _ in range(8):
            x, w = r.normal(), r.normal()
            rows.append((len(rows), race, float(x), float(w), float(level + x + 0.3 * r.normal() + (r.exponential(30) if r.random() < 0.1 else 0))))
    df = spark.createDataFrame(rows, "id long, race long, x double, w double, mark double")
    model = rank_trees.fit(df.where("race < 40"), "race", ["mark", "id"], ["x", "w"], rounds=5, depth=3)
    ranked = model.transform(df.where("race >= 40")).withColumn("p", -F.col("score"))
    squares = GBTRegressor(featuresCol="_x", labelCol="mark", maxIter=5, maxDepth=3, seed=7).fit(rank_trees._vectors(df.where("race < 40"), ["x", "w"])).transform(rank_trees._vectors(df.where("race >= 40"), ["x", "w"])).withColumnRenamed("prediction", "p")

    def right(got):
        by = defaultdict(list)
        for q in got.collect():
            by[q.race].append((q.mark, q.p))
        pairs = [((a[1] < b[1]) + 0.5 * (a[1] == b[1])) for m in by.values() for a in m for b in m if a[0] < b[0]]
        return np.mean(pairs)

    assert right(ranked) > right(squares) + 0.02 and right(ranked) > 0.75


def test_gradients_are_the_pairs_pull(spark):
    r = np.random.default_rng(5)
    rows = [(i // 7, i, float(s)) for i, s in enumerate(r.normal(size=21))]
    laid = ranks.Ordered(spark.createDataFrame(rows, "race long, place long, s double"), ["race"], ["place"])
    got = {x.place: x.gradient for x in rank_trees.gradients(laid, laid.rows, "race", "s").collect()}
    for race in range(3):
        s = np.array([q[2] for q in rows if q[0] == race])
        for i in range(7):
            h = 1e-6
            like = lambda t: sum(t[k] - np.log(np.exp(t[k:]).sum()) for k in range(7))
            assert got[race * 7 + i] == pytest.approx((like(s + h * np.eye(7)[i]) - like(s - h * np.eye(7)[i])) / (2 * h), abs=1e-5)


def test_gls_matches_dense(spark):
    r = np.random.default_rng(7)
    rows, d = [], r.normal(0, 1, 6)
    for p in range(15):
        days = np.sort(r.choice(60, 6, replace=False))
        level = np.cumsum(r.normal(0, 0.2, 6)) + r.normal(0, 2)
        for t, m in zip(days, level):
            for _ in range(1 + (p + t) % 2):
                c = int(r.integers(0, 6))
                rows.append((p, c, int(t), float(d[c] + m + r.normal(0, 0.3))))
    got, info = gls.gls_cells(spark.createDataFrame(rows, "p int, c int, t int, y double"), "p", "c", "t", "y", 0.02, 0.09, 1.0)
    a, right = np.diag(np.full(6, 1.0)), np.zeros(6)
    for p in range(15):
        mine = [q for q in rows if q[0] == p]
        t = np.array([q[2] for q in mine], dtype=float)
        x = np.eye(6)[[q[1] for q in mine]]
        v = 0.09 * np.eye(len(t)) + 0.02 * np.minimum.outer(t - t.min(), t - t.min()) + 1e7  # a free start
        inverse = np.linalg.inv(v)
        a += x.T @ inverse @ x
        right += x.T @ inverse @ np.array([q[3] for q in mine])
    want = np.linalg.solve(a, right)
    assert {q.cell: q.difficulty for q in got.collect()} == pytest.approx(dict(enumerate(want)), abs=1e-4) and info["products"] <= 10
    assert np.corrcoef(want, d)[0, 1] > 0.95


def test_merged_suppliers_against_a_plain_version(spark, sf):
    from splitline.plans.place_queries import merge_inputs

    ids, votes, apart = (x.collect() for x in merge_inputs(spark, sf))
    got = {x.id: x["class"] for x in merging.merge_classes(*merge_inputs(spark, sf), 8).collect()}
    assert got == plain_merge([x.id for x in ids], [tuple(x) for x in votes], [tuple(x) for x in apart], 8)


def test_a_box_opens_only_its_tiles(spark, tmp_path):
    from splitline.sources import tiles

    r = np.random.default_rng(8)
    cells = [(int(a), int(o), int(t), float(r.normal(15, 5))) for t in (3, 4) for a in range(-7, 20) for o in range(30) if r.random() < 0.8]
    path = f"file://{tmp_path}/tiles"
    names = tiles.write_tiles(spark.createDataFrame(cells, "lat long, lon long, day long, value double"), path, 10, 0.01, 273.15)
    assert names == sorted(f"{a}_{o}" for a in (-1, 0, 1) for o in (0, 1, 2))
    df = tiles.read_tiles(spark, path, 10)
    whole = {(x.lat, x.lon, x.day): x.value for x in df.collect()}
    assert whole == {(a, o, t): pytest.approx(v, abs=1e-9) for a, o, t, v in cells}
    box = df.where("lat >= -3 AND lat < 10 AND lon > 20")
    assert {(x.lat, x.lon, x.day) for x in box.collect()} == {(a, o, t) for a, o, t, _ in cells if -3 <= a < 10 and o > 20}
    reader = tiles.TileReader(path, 10)
    list(reader.pushFilters([tiles.GreaterThanOrEqual(("lat",), -3), tiles.LessThan(("lat",), 10), tiles.GreaterThan(("lon",), 20)]))
    assert [p.name for p in reader.partitions()] == ["-1_2", "0_2", "1_2"]  # 10 itself is ruled out by the cells
    import os
    os.remove(f"{tmp_path}/tiles/1_0.npz")
    os.truncate(f"{tmp_path}/tiles/0_0.npz", 3)
    assert box.count() == sum(-3 <= a < 10 and o > 20 for a, o, _, _ in cells)  # a broken tile outside the box is never opened


def test_neighbours_of_a_hot_person_come_over_partitions(spark):
    from splitline.operators import joins

    r = random.Random(9)
    rows = [(0 if i % 3 else i % 20, i, r.randrange(200), float(i)) for i in range(700)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")  # so that partitions hold fewer rows than k
    try:
        df = spark.createDataFrame(rows, "p long, id long, day long, v double")
        got = {x.id: list(x.near) for x in joins.nearest_by_day(df, "p", "day", "id", "v", 15).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    by = defaultdict(list)
    for p, i, day, v in rows:
        by[p].append((day, i, v))
    for mine in by.values():
        mine.sort()
        for at, (day, i, _) in enumerate(mine):
            around = mine[max(0, at - 15) : at] + mine[at + 1 : at + 16]
            assert got[i] == [v for _, _, _, v in sorted((abs(d - day), d, o, v) for d, o, v in around)[:15]]


def test_concordance_counts_every_pair(spark):
    from splitline.operators import estimate

    r = random.Random(10)
    rows = [(i % 3, r.randrange(30), r.randrange(25)) for i in range(300)] + [(7, 1, 1), (8, 2, 3), (8, 2, 4)]
    got = {x.race: (x["right"], x.pairs) for x in estimate.concordance(spark.createDataFrame(rows, "race long, a long, p long"), "race", "a", "p").collect()}
    want = {}
    for g in range(3):
        mine = [q[1:] for q in rows if q[0] == g]
        pairs = [(x, y) for x in mine for y in mine if x[0] < y[0] and x[1] != y[1]]
        want[g] = (sum(x[1] < y[1] for x, y in pairs), len(pairs))
    assert got == want


def test_a_layout_gives_whole_groups_and_moves_no_rows(spark):
    r = np.random.default_rng(8)
    rows = [(None if i % 9 == 8 else int(i % 9 > 5), i, int(i % 4), float(v)) for i, v in enumerate(r.normal(size=3_000))]
    laid = ranks.Ordered(spark.createDataFrame(rows, "g int, i long, t int, v double"), ["g"], ["v", "i"])
    assert laid.rows.select("_part").distinct().count() > 3 and laid.split.count() > 0
    own = laid.running(laid.whole(laid.rows, {"n": (F.sum, F.lit(1)), "top": (F.max, F.col("v"))}), {"k": F.lit(1)})
    moved = laid.whole(own, {"mates": (F.sum, F.lit(1))}, "t")
    plan = moved._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan.lower()  # windows of all rows use the buckets
    groups = {g: [q for q in rows if q[0] == g] for g in (None, 0, 1)}
    want = {i: (len(groups[g]), max(q[3] for q in groups[g]), sum(q[2] == t for q in groups[g])) for g, i, t, _ in rows}
    assert {x.i: (x.n, x.top, x.mates) for x in moved.collect()} == want
