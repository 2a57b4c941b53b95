"""The joint solve against dense least squares, and in planted worlds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from splitline import catalog
from splitline.operators import joint


def world(people=80, cells=12, per_cell=3, each=7, cell_sd=0.15, day_sd=0.03, noise=0.02, seed=0, tilt=0.0):
    """Rows (id, person, cell, race, y) and the planted difficulties, abilities and race days."""
    r = np.random.default_rng(seed)
    d = r.normal(0, cell_sd, cells)
    d -= d.mean()
    a, u = r.normal(0, 0.2, people), r.normal(0, day_sd, cells * per_cell)
    h = 1 + tilt * (100 * np.exp(a.mean() - a) - 100) / 10
    rows = []
    for p in range(people):
        for j in r.integers(0, cells * per_cell, each).tolist():
            rows.append((len(rows), p, j // per_cell, j, float(a[p] + h[p] * (d[j // per_cell] + u[j]) + r.normal(0, noise))))
    return rows, d, a, u


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, person long, cell long, race long, y double")


def of(effects, block):
    return {int(x.key): x.centred for x in effects.where(F.col("block") == block).collect()}


def off(got, want):
    return float(np.sqrt(np.mean([(got[k] - want[k]) ** 2 for k in got])))


def dense(blocks, y, w=None):
    """Least squares of y on (keys, loadings, ridge) blocks; a list of {key: value}."""
    w = np.ones(len(y)) if w is None else w
    columns, names, ridge = [], [], []
    for i, (keys, loads, lam) in enumerate(blocks):
        for k in sorted(set(keys)):
            columns.append(np.where(np.array(keys) == k, loads, 0.0))
            names.append((i, k))
            ridge.append(lam)
    x = np.array(columns).T
    t = np.linalg.solve(x.T @ (w[:, None] * x) + np.diag(ridge), x.T @ (w * y))
    out = [{} for _ in blocks]
    for (i, k), v in zip(names, t):
        out[i][k] = v
    return out


def test_coupled_blocks_match_dense_least_squares(spark):
    r = np.random.default_rng(2)
    n = 400
    person, cell, race, day, side, pool = r.integers(0, 25, n), r.integers(0, 8, n), r.integers(0, 24, n), r.uniform(0, 100, n), r.choice([-0.5, 0.5], n), r.integers(0, 3, n)
    y, w = r.normal(size=n), r.uniform(0.2, 1.0, n)
    rows = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(zip(person, cell, race, day, side, pool, y, w))], "id long, person double, cell double, race double, day double, side double, pool double, y double, w double")
    c = lambda x: F.col(x).cast("int")
    knots = [10.0, 40.0, 90.0]
    blocks = [joint.term("a", c("person"), ridge=0.1, group=c("person")), joint.term("d", c("cell"), ridge=2.0), joint.term("u", c("race"), ridge=5.0), joint.term("s", c("person"), F.col("side"), 1.5, c("person")), joint.curve("f", F.col("day"), knots, ridge=0.3), joint.term("o", F.when(F.col("pool") > 0, c("pool")), F.col("day") / 100, 0.2)]
    d = joint.design(rows, "id", F.col("y"), blocks, F.col("w"))
    got, info = joint.solve(d, tol=1e-9)
    x = np.clip(day, 10, 90)
    hats = [np.interp(x, knots, np.eye(3)[k]) for k in range(3)]
    want = dense([(person, 1.0, 0.1), (cell, 1.0, 2.0), (race, 1.0, 5.0), (person, side, 1.5), (np.zeros(n), hats[0], 0.3), (np.zeros(n), hats[1], 0.3), (np.zeros(n), hats[2], 0.3), (np.where(pool > 0, pool, -1), np.where(pool > 0, day / 100, 0), 0.2)], y, w)
    for block, k in zip("aduso", (0, 1, 2, 3, 7)):
        mine = {int(q.key): q.value for q in got.where(F.col("block") == block).collect()}
        assert mine == pytest.approx({int(k): v for k, v in want[k].items() if k >= 0}, abs=1e-6)
    assert [q.value for q in got.where("block = 'f'").orderBy("key").collect()] == pytest.approx([want[4 + k][0.0] for k in range(3)], abs=1e-6)
    again, more = joint.solve(d, got.select("block", "key", "value"), tol=1e-8)
    assert more["products"] <= 1 < info["products"]
    seen = {q.id: q.fit for q in joint.fitted(d, got).collect()}
    assert seen[0] == pytest.approx(want[0][person[0]] + want[1][cell[0]] + want[2][race[0]] + side[0] * want[3][person[0]] + sum(hats[k][0] * want[4 + k][0.0] for k in range(3)) + (day[0] / 100 * want[7][pool[0]] if pool[0] else 0))


def test_known_difficulties_are_recovered(spark):
    rows, d, _, _ = world(people=120, cells=15)
    effects, _ = joint.joint_solve(frame(spark, rows), "id", "y", joint.Terms(), tol=1e-3)
    got = of(effects, "cell")
    assert np.corrcoef([got[k] for k in range(15)], d)[0, 1] > 0.97 and off(got, d) < 0.03


def test_race_days_protect_the_venue(spark):
    rows, d, _, _ = world(day_sd=0.10, seed=3, people=120)
    with_days, _ = joint.joint_solve(frame(spark, rows), "id", "y", joint.Terms(variances={"cell": 0.0225, "race": 0.01}), tol=1e-3)
    without, _ = joint.joint_solve(frame(spark, rows), "id", "y", joint.Terms(race=None), tol=1e-3)
    assert off(of(with_days, "cell"), d) < off(of(without, "cell"), d)


def test_robust_rounds_weigh_down_and_keep(spark):
    rows, d, _, _ = world(seed=5)
    r = np.random.default_rng(11)
    bad = set(r.choice(len(rows), len(rows) // 50, replace=False).tolist())
    rows = [(*x[:4], x[4] + 0.6 * (x[0] in bad)) for x in rows]
    plain, _ = joint.joint_solve(frame(spark, rows), "id", "y", joint.Terms(), tol=1e-3)
    robust, _ = joint.joint_solve(frame(spark, rows), "id", "y", joint.Terms(), outer=3, robust=1.5, tol=1e-3)
    assert off(of(robust, "cell"), d) < 0.8 * off(of(plain, "cell"), d)


def test_tilted_courses_and_estimated_variances(spark):
    rows, d, a, _ = world(seed=6, tilt=-0.2, noise=0.005, day_sd=0.01, cell_sd=0.2)
    flat, _ = joint.joint_solve(frame(spark, rows), "id", "y", joint.Terms(), tol=1e-3)
    tilted, info = joint.joint_solve(frame(spark, rows), "id", "y", joint.Terms(), outer=3, tilt=-0.2, estimate=True, tol=1e-4)
    assert off(of(tilted, "cell"), d) < 0.5 * off(of(flat, "cell"), d)
    assert info["variances"]["cell"] == pytest.approx(np.mean(d**2), rel=0.3) and info["sigma2"] < 0.001


def test_a_solve_that_does_not_settle_is_an_error(spark):
    rows, _, _, _ = world(people=30)
    d = joint.design(frame(spark, rows), "id", F.col("y"), joint.Terms().blocks(4e-4, F.lit(1.0)))
    with pytest.raises(RuntimeError, match="did not settle"):
        joint.solve(d, most=1)
    assert joint.solve(joint.design(frame(spark, rows).limit(0), "id", F.col("y"), joint.Terms().blocks(4e-4, F.lit(1.0))))[0].count() == 0


def test_query_against_dense_least_squares(spark, sf):
    """The registered query's whole table, solved densely with persons swept out by the normal equations."""
    from splitline.plans.domain_queries import joint_rows

    got = {(x.block, x.key): x.value for x in catalog.queries()["joint_difficulties"](spark, sf).collect()}
    t = joint_rows(spark, sf).toPandas()
    hats = [np.interp(t["day"], [1, 92, 183, 274, 365], np.eye(5)[k]) for k in range(5)]
    zero = np.zeros(len(t))
    want = dense([(t["person"], 1.0, 0.0), (t["cell"], 1.0, 4.0), (t["race"], 1.0, 40.0), (t["person"], t["side"].to_numpy(), 40.0), *[(zero, h, 1e-3) for h in hats]], t["y"].to_numpy())
    for block, k in (("cell", 1), ("race", 2)):
        for key, v in want[k].items():
            assert got[block, str(key)] == pytest.approx(v, abs=2e-6)


def test_whole_rows_and_entries_give_the_same_product(spark, monkeypatch):
    rows, _, _, _ = world(people=30, cells=4)
    blocks = joint.Terms().blocks(4e-4, F.lit(1.0))
    whole = joint.design(frame(spark, rows), "id", F.col("y"), blocks)
    monkeypatch.setattr(joint, "SENT", 0)
    name = joint._name
    monkeypatch.setattr(joint, "_name", lambda seed, block, key: F.lit(7).cast("long") if seed == 0 else name(seed, block, key))  # the first seed names all alike
    entries = joint.design(frame(spark, rows), "id", F.col("y"), blocks)
    assert whole.wide is not None and whole.by_row is None and entries.wide is None
    got = []
    for d in (whole, entries):
        v = d.unknowns.select("u", F.length("key").cast("double").alias("p"))
        q = joint.product(d, v).join(d.unknowns, "u").collect()
        got.append({(x.block, x.key): x.q for x in q})
        fits = joint.fitted(d, d.unknowns.select("u", F.length("key").cast("double").alias("value"))).collect()
        got.append({x.id: x.fit for x in fits})
        got.append({(x.block, x.key): x.diagonal for x in d.unknowns.collect()})
    assert got[0] == pytest.approx(got[3]) and got[1] == pytest.approx(got[4]) and got[2] == pytest.approx(got[5])
    assert len(got[0]) == 30 + 4 + 12 and len(got[1]) == len(rows)


def test_swept_solve_gives_the_same_effects_in_few_products(spark, monkeypatch):
    r = np.random.default_rng(4)
    rows = [(*x, float(r.choice([-0.5, 0.5])), float(r.uniform(0, 100))) for x in world(people=60, cells=6, each=9, seed=8)[0]]
    df = spark.createDataFrame(rows, "id long, person long, cell long, race long, y double, side double, day double").withColumn("cell", F.col("cell") + 100)
    terms = lambda: joint.Terms(side="side", day="day", knots=[0.0, 50.0, 100.0], variances={"cell": 0.1, "race": 0.01, "side": 0.01})
    fast, few = joint.joint_solve(df, "id", "y", terms(), sigma2=0.4, tol=1e-9)
    monkeypatch.setattr(joint, "_swept", lambda *a: None)
    slow, many = joint.joint_solve(df, "id", "y", terms(), sigma2=0.4, tol=1e-9)
    got, want = ({(x.block, x.key): (x.value, x.diagonal, x.centred) for x in e.collect()} for e in (fast, slow))
    assert got.keys() == want.keys() and {b for b, _ in got} == {"ability", "side", "race", "cell", "curve"}
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-6), k
    assert few["products"] * 2 <= many["products"]


def test_rows_that_cannot_be_swept_take_the_general_solve(spark):
    rows = [(i, i % 7, i % 3, i % 6, float(i % 5)) for i in range(60)]
    laid = lambda some: joint.swept.Rows(frame(spark, some), *[F.col(c) for c in ("person", "cell", "race", "y")], F.lit(0.0), [], 40.0, 4.0).sound
    assert laid(rows) and laid([])
    assert not laid([*rows, (60, 1, 2, 0, 1.0)])  # race 0 lies in courses 0 and 2
    assert not laid([*rows, (60, None, 0, 0, 1.0)]) and not laid([*rows, (60, 1, None, 0, 1.0)]) and not laid([*rows, (60, 1, 0, None, 1.0)])
