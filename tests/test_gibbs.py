"""The Gibbs sampler against the closed form of a small model, and in a planted world."""

import numpy as np
import pytest

from splitline.operators import gibbs


def rows_of(r, people, cells, each, noise, d, a, slope=0.0):
    return [(p, int(c), float(x), float(1 + a[p] + d[c] + slope * x + r.normal(0, noise))) for p in range(people) for c, x in zip(r.integers(0, cells, each), r.normal(size=each))]


def test_posterior_matches_the_closed_form(spark):
    r = np.random.default_rng(1)
    rows = rows_of(r, 12, 4, 3, 0.5, r.normal(0, 1, 4), r.normal(0, 0.25, 12))
    kept, _ = gibbs.draws(spark.createDataFrame(rows, "p int, c int, x double, y double"), "p", "c", "y", chains=60, rounds=14, burn=5, fixed=(1.0, 0.0, 0.25))
    got = {q.cell: q for q in gibbs.posterior(kept).collect()}
    m = np.zeros((len(rows), 16))
    for i, (p, c, _, _) in enumerate(rows):
        m[i, p], m[i, 12 + c] = 1, 1
    cov = np.linalg.inv(m.T @ m / 0.25 + np.diag([16.0] * 12 + [1.0] * 4))
    mean = cov @ m.T @ (np.array([y - 1 for *_, y in rows]) / 0.25)
    for c in range(4):
        sd = cov[12 + c, 12 + c] ** 0.5
        assert got[c].mean == pytest.approx(mean[12 + c], abs=0.25 * sd) and got[c].sd == pytest.approx(sd, rel=0.15) and got[c].draws == 540


def test_planted_slope_noise_and_courses_with_a_pinned_reference(spark):
    r = np.random.default_rng(2)
    d = np.array([0.0, 0.4, -0.3, 0.2, -0.1])
    rows = rows_of(r, 60, 5, 6, 0.05, d, r.normal(0, 0.2, 60), slope=0.07)
    kept, params = gibbs.draws(spark.createDataFrame(rows, "p int, c int, x double, y double"), "p", "c", "y", "x", chains=10, rounds=12, burn=6, reference=0)
    got = {q.cell: q for q in gibbs.posterior(kept).collect()}
    assert got[0].mean == 0 and got[0].sd == 0
    assert all(abs(got[c].mean - d[c]) < 0.05 and got[c].low < got[c].mean < got[c].high for c in range(1, 5))
    last = [p for p in params if p["round"] >= 6]
    assert np.mean([p["beta"] for p in last]) == pytest.approx(0.07, abs=0.01) and np.mean([p["sigma"] for p in last]) == pytest.approx(0.05, rel=0.15)


def test_draws_repeat_and_empty_tables_give_none(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 1.0), (1, 2, 0.0, 2.0), (2, 2, 0.0, 1.5), (2, None, 0.0, 9.0)], "p int, c int, x double, y double")
    one, two = (sorted(tuple(q) for q in gibbs.draws(x, "p", "c", "y", chains=2, rounds=3, burn=1, seed=5)[0].collect()) for x in (df, df.repartition(7)))
    assert [q[:3] for q in one] == [q[:3] for q in two] and [q[3] for q in one] == pytest.approx([q[3] for q in two]) and len(one) == 8
    assert gibbs.draws(df.limit(0), "p", "c", "y")[0].count() == 0


def test_the_constant_of_mean_and_difficulties_is_drawn_too(spark):
    """Closed form with a flat prior of the mean, slope and noise being settled by many rows; the rounds alone hardly move the constant."""
    r = np.random.default_rng(7)
    d = r.normal(0, 1, 5)
    rows = rows_of(r, 40, 5, 50, 0.1, d, r.normal(0, 0.25, 40))
    kept, _ = gibbs.draws(spark.createDataFrame(rows, "p int, c int, x double, y double"), "p", "c", "y", "x", chains=60, rounds=8, burn=4)
    got = {q.cell: q for q in gibbs.posterior(kept).collect()}
    m = np.zeros((len(rows), 46))
    for i, (p, c, _, _) in enumerate(rows):
        m[i, p], m[i, 40 + c], m[i, 45] = 1, 1, 1
    cov = np.linalg.inv(m.T @ m / 0.01 + np.diag([16.0] * 40 + [1.0] * 5 + [1e-6]))
    mean = cov @ m.T @ (np.array([y for *_, y in rows]) / 0.01)
    for c in range(5):
        sd = cov[40 + c, 40 + c] ** 0.5
        assert got[c].mean == pytest.approx(mean[40 + c], abs=0.3 * sd) and got[c].sd == pytest.approx(sd, rel=0.2)


def test_query_keeps_as_many_draws_as_the_reference(spark, sf):
    from splitline import catalog

    got = catalog.queries()["gibbs_posterior"](spark, sf).collect()
    assert got and all(x.draws == 1500 and x.low < x.mean < x.high for x in got)
