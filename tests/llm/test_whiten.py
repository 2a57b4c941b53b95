"""Whitening against a plain NumPy version, and its defined cases."""

import numpy as np
import pytest
from pyspark.sql import Row

from splitline.llm import whiten
from splitline.llm.registry import op11_covariance_whitening

ROWS = "vec_id long, embedding array<float>"


def plain(vectors, k=8):
    """(n, deviations, whitened, explained) by dense NumPy and Python integers."""
    x = [[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x)]
    z = np.array([[float(n * a - b) / n for a, b in zip(row, s)] for row in x])
    e, w = np.linalg.eigh(z.T @ z / n)
    e, w = e[::-1], w[:, ::-1]
    keep = [i for i in range(min(k, len(e))) if e[i] > 1e-12 * e[0]]
    return n, [sum((n * a - b) ** 2 for a, b in zip(row, s)) for row in x], z @ (w[:, keep] / np.sqrt(e[keep])), (e / e.sum())[keep]


def check(got, vectors, k=8):
    n, deviation, white, explained = plain(vectors, k)
    table = {(r.vec_id, r.component): r for r in got}
    assert len(got) == len(vectors) * white.shape[1]
    for j in range(white.shape[1]):
        column = np.array([table[i, j + 1].whitened for i in range(len(vectors))])
        sign = np.sign(column @ white[:, j])
        assert column == pytest.approx(sign * white[:, j], abs=1e-6)
        assert table[0, j + 1].explained == pytest.approx(explained[j], rel=1e-8)
    for i in range(len(vectors)):
        assert table[i, 1].n == n and table[i, 1].deviation == deviation[i]
    assert got[0].identity_error < 1e-8


def test_random_vectors(spark):
    r = np.random.default_rng(3)
    v = (r.normal(size=(300, 12)) @ r.normal(size=(12, 12))).astype(np.float32).tolist()
    got = whiten.whiten(spark.createDataFrame(list(enumerate(v)), ROWS).repartition(7))
    check(got.collect(), v)


def test_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    place = {x.vec_id: i for i, x in enumerate(rows)}
    got = op11_covariance_whitening(spark, sf)
    check([Row(**{**r.asDict(), "vec_id": place[r.vec_id]}) for r in got.collect()], [x.embedding for x in rows])


def test_nulls_lengths_repeats_and_clashing_columns(spark):
    r = np.random.default_rng(4)
    v = r.normal(size=(40, 3)).astype(np.float32).tolist()
    bad = [(None, None), (90, None), (91, []), (92, [1.0, None, 2.0]), (93, [1.0, float("nan"), 2.0]), (94, [float("inf"), 0.0, 0.0]), (95, [1.0, 2.0])]
    plainly = whiten.whiten(spark.createDataFrame(list(enumerate(v)), ROWS))
    messy = whiten.whiten(spark.createDataFrame([*enumerate(v), *bad], ROWS).selectExpr("*", "1 as x", "2 as n", "3 as component", "'a' as whitened", "4 as m"))
    key = lambda q: sorted((x.vec_id, x.component, x.n, x.deviation, round(x.whitened, 9)) for x in q.collect())
    assert key(plainly) == key(messy) and len(key(plainly)) == 120
    twice = whiten.whiten(spark.createDataFrame([*enumerate(v), (None, v[0]), (0, v[0])], ROWS)).where("component = 1").collect()
    assert len(twice) == 42 and len({round(x.whitened, 9) for x in twice if x.vec_id in (0, None)}) == 1


def test_no_spread_and_empty_tables(spark):
    assert whiten.whiten(spark.createDataFrame([], ROWS)).count() == 0
    assert whiten.whiten(spark.createDataFrame([(1, None)], ROWS)).count() == 0
    assert whiten.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], ROWS)).count() == 0
    flat = whiten.whiten(spark.createDataFrame([(1, [1.0, 5.0]), (2, [2.0, 5.0]), (3, [4.0, 5.0])], ROWS)).collect()  # one direction has no spread
    assert {x.component for x in flat} == {1} and flat[0].explained == pytest.approx(1.0) and flat[0].identity_error < 1e-9


def test_numbers_beyond_64_bits_are_errors(spark):
    with pytest.raises(Exception, match="53 bits"):
        whiten.whiten(spark.createDataFrame([(1, [1e14]), (2, [0.0])], ROWS)).count()
    with pytest.raises(Exception, match="64 bits"):
        whiten.whiten(spark.createDataFrame([(1, [1e9]), (2, [0.0])], ROWS).unionByName(spark.range(4_000).selectExpr("id as vec_id", "array(cast(0 as float)) as embedding"))).collect()
