"""Estimates on the test tables: each with SQL where SQL can say it, else with a check of its own in the tests."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import dataquality as dq, estimate as est, solve
from ..operators.store import bucketed
from .base import L, R, query, races, results, table
from .domain_queries import two_way_sql, within_sql


@query(f"WITH {L}, c AS (SELECT team, cell, count(*) AS n FROM l GROUP BY ALL) SELECT team, max(n) AS n, min(cell) FILTER (WHERE n = m) AS mode FROM (SELECT *, max(n) OVER (PARTITION BY team) AS m FROM c) GROUP BY team")
def modal_cell(spark, sf):
    return est.modes(races(spark, sf), ["team"], "cell").select("team", "n", "mode")


@query("SELECT l_returnflag, l_orderkey * 10 + l_linenumber AS id FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY md5(CAST(l_orderkey * 10 + l_linenumber AS VARCHAR)), l_orderkey * 10 + l_linenumber) <= 20")
def reservoir_sample(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return est.reservoir(li, ["l_returnflag"], "id", 20)


@query("SELECT l_returnflag, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.9) AS p90 FROM lineitem GROUP BY l_returnflag")
def approximate_percentiles(spark, sf):
    """Percentiles from one mergeable sketch a group, of relative rank error one in two million: exact on fewer rows than that."""
    both = F.percentile_approx("l_extendedprice", [0.5, 0.9], 2_000_000)
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(both.alias("p")).select("l_returnflag", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p90"))


@query(f"WITH {R}, p AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY mark DESC) AS k FROM r WHERE mark > 0) SELECT person, round(exp(avg(ln(mark))), 6) AS geometric, round(sum(0.5 ** ((40 - dayno) / 14.0) * mark) / sum(0.5 ** ((40 - dayno) / 14.0)), 6) AS ewma, round(avg(mark) FILTER (WHERE k <= 2), 6) AS best2 FROM p GROUP BY person")
def baseline_levels(spark, sf):
    got = est.baselines(results(spark, sf).where("mark > 0"), ["person"], "dayno", "mark", 40, 14.0)
    return got.select("person", *[F.round(c, 6).alias(c) for c in ("geometric", "ewma", "best2")])


@query(f"WITH {L}, s AS (SELECT CAST(year(day) AS BIGINT) AS season, quantile_cont(mark, 0.1) AS level FROM l GROUP BY 1) SELECT season, round(level, 4) AS level, round(ln(level / (SELECT level FROM s WHERE season = 1997)), 8) AS log_ratio FROM s")
def season_benchmarks(spark, sf):
    got = est.benchmark_levels(races(spark, sf).withColumn("season", F.year("day").cast("long")), "season", "mark", 0.1, 1997)
    return got.select("season", F.round("level", 4).alias("level"), F.round("log_ratio", 8).alias("log_ratio"))


@query(f"WITH {R}, p AS (SELECT CAST(dayno // 10 AS BIGINT) AS horizon, mark - avg(mark) OVER (PARTITION BY person ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM r) SELECT horizon, round(avg(e), 6) AS bias, round(quantile_cont(abs(e), 0.5), 6) AS median_abs, round(quantile_cont(abs(e), 0.9), 6) AS p90, round(stddev_samp(e), 6) AS sd, count(e) AS n FROM p GROUP BY horizon")
def error_statistics(spark, sf):
    from ..operators import windows

    p = windows.before_after(results(spark, sf), ["person"], ["ts", "id"], "mark")
    got = est.error_stats(p.select(F.floor(F.col("dayno") / 10).alias("horizon"), (F.col("mark") - F.col("earlier_mean")).alias("e")), ["horizon"], "e")
    return got.select("horizon", *[F.round(c, 6).alias(c) for c in ("bias", "median_abs", "p90", "sd")], "n")


@query(f"WITH {R}, p AS (SELECT dayno, CAST(floor(mark / 20) AS BIGINT) AS a, id % 7 AS p FROM r WHERE mark IS NOT NULL) SELECT x.dayno, CAST(count(*) FILTER (WHERE x.p < y.p) AS BIGINT) AS \"right\", count(*) AS pairs FROM p x JOIN p y ON x.dayno = y.dayno AND x.a < y.a AND x.p <> y.p GROUP BY x.dayno")
def pair_concordance(spark, sf):
    p = results(spark, sf).where("mark IS NOT NULL").select("dayno", F.floor(F.col("mark") / 20).alias("a"), (F.col("id") % 7).alias("p"))
    return est.concordance(p, "dayno", "a", "p")


@query(f"""WITH {R}, o AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY dayno, id) AS pos FROM r), e AS (""" + " UNION ALL ".join(f"(SELECT {k} AS k, quantile_cont(abs(mark - med), 0.5) AS e FROM (SELECT id, mark, quantile_cont(m, 0.5) AS med FROM (SELECT a.id, a.mark, b.mark AS m, row_number() OVER (PARTITION BY a.id ORDER BY abs(b.dayno - a.dayno), b.dayno, b.id) AS n FROM o a JOIN o b ON a.person = b.person AND a.id <> b.id AND abs(a.pos - b.pos) <= {k}) WHERE n <= {k} GROUP BY id, mark HAVING count(*) >= 3))" for k in (4, 8)) + ") SELECT k, round(e, 6) AS error, k = (SELECT k FROM e ORDER BY round(e, 9), k DESC LIMIT 1) AS chosen FROM e")
def neighbour_count(spark, sf):
    chosen, errors = est.choose_k(results(spark, sf), "person", "dayno", "id", "mark", [4, 8])
    return spark.createDataFrame([(k, round(e, 6), k == chosen) for k, e in errors.items()], "k int, error double, chosen boolean")


_GRID = ", ".join(f"({5 + 0.25 * i})" for i in range(41))


@query(f"""WITH {R}, o AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY dayno, id) AS pos FROM r), p AS (SELECT a.id, a.mark, b.mark AS m, row_number() OVER (PARTITION BY a.id ORDER BY abs(b.dayno - a.dayno), b.dayno, b.id) AS k FROM o a JOIN o b ON a.person = b.person AND a.id <> b.id AND abs(a.pos - b.pos) <= 6),
n AS (SELECT * FROM p WHERE k <= 6), d AS (SELECT id, mark, quantile_cont(m, 0.5) AS med, count(*) AS c FROM n GROUP BY id, mark), s AS (SELECT n.id, 1.4826 * quantile_cont(abs(n.m - d.med), 0.5) AS mad FROM n JOIN d USING (id) GROUP BY n.id),
z AS (SELECT abs((d.mark - d.med) / greatest(s.mad, 2.0)) AS a FROM d JOIN s USING (id) WHERE c >= 3), f AS (SELECT count(*) FILTER (WHERE a >= 2 AND a < 3) AS n1, count(*) FILTER (WHERE a >= 3 AND a < 4) AS n2 FROM z), t AS (SELECT *, ln(CAST(n1 AS DOUBLE) / n2) AS slope FROM f WHERE n1 > n2 AND n2 > 0),
e AS (SELECT g.c, n1 / (exp(-2 * slope) - exp(-3 * slope)) * exp(-slope * g.c) AS genuine, (SELECT count(*) FROM z WHERE a >= g.c) AS seen FROM t, (VALUES {_GRID}) g(c)), c AS (SELECT CAST(coalesce(min(c), 15) AS DOUBLE) AS cut FROM e WHERE seen = 0 OR genuine <= 0.01 * seen)
SELECT cut, (SELECT count(*) FROM z WHERE a >= cut) AS beyond FROM c""")
def outlier_cut(spark, sf):
    """The cut of neighbour z at a false-discovery rate of 0.01, and the rows beyond it; a test has a planted tail."""
    z = dq.neighbour_z(results(spark, sf), "person", "dayno", "id", "mark", 6, 2.0).select("id", "z").checkpoint()
    cut = dq.fdr_cut(z)
    return z.agg(F.lit(cut).alias("cut"), F.count_if(F.abs("z") >= cut).alias("beyond"))


_CURVE = "exp(CASE WHEN ln(distance) < ln(2000.0) THEN ln(950.0) + (ln(distance) - ln(1000.0)) * (ln(1200.0) - ln(950.0)) / (ln(2000.0) - ln(1000.0)) ELSE ln(1200.0) + (ln(distance) - ln(2000.0)) * (ln(1800.0) - ln(1200.0)) / (ln(5000.0) - ln(2000.0)) END)"


@query(f"WITH d AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS race, CAST(p_size * 100 AS DOUBLE) AS distance, l_extendedprice AS seconds, l_suppkey % 4 = 0 AS exempt, {_CURVE} AS lim FROM lineitem JOIN part ON l_partkey = p_partkey, LATERAL (SELECT CAST(p_size * 100 AS DOUBLE) AS distance)), b AS (SELECT DISTINCT race FROM d WHERE seconds < lim AND NOT exempt) SELECT id, 'race' AS reason FROM d WHERE race IN (SELECT race FROM b) UNION ALL SELECT id, 'row' FROM d WHERE race NOT IN (SELECT race FROM b) AND seconds < lim * 1.5 AND NOT exempt")
def over_record(spark, sf):
    d = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    d = d.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("race"), (F.col("p_size") * 100).cast("double").alias("distance"), F.col("l_extendedprice").alias("seconds"), (F.col("l_suppkey") % 4 == 0).alias("exempt"))
    return est.over_record(d, "race", "distance", "seconds", [(1000.0, 950.0), (2000.0, 1200.0), (5000.0, 1800.0)], 1.5, "exempt")


@query(f"WITH {L}, c AS (SELECT team, CASE WHEN race % 2 = 0 THEN 1.0 ELSE 0.0 END AS s, mark FROM l), m AS (SELECT team, s - avg(s) OVER (PARTITION BY team) AS s, mark - avg(mark) OVER (PARTITION BY team) AS v FROM c) SELECT team, round(sum(s * v) / (sum(s * s) + 5.0), 6) AS slope, count(*) AS n FROM m GROUP BY team")
def ridge_slopes(spark, sf):
    r = races(spark, sf).withColumn("side", F.when(F.col("race") % 2 == 0, 1.0).otherwise(0.0))
    return est.ridge_slopes(r, "team", "side", "mark", 5.0).select("team", F.round("slope", 6).alias("slope"), "n")


@query(two_way_sql() + """, r AS (SELECT l.person, mark - d AS y FROM l JOIN fit USING (cell)), m AS (SELECT person, avg(y) AS m FROM r GROUP BY person), e AS (SELECT sum((y - m) ** 2) AS ssr, count(*) AS n, count(DISTINCT r.person) AS p FROM r JOIN m USING (person)),
c AS (SELECT count(*) AS c, var_samp(d) AS v, avg(1 / diag) AS u FROM fit WHERE diag > 0), s AS (SELECT ssr / (n - p - (c - 1)) AS sigma2, v, u FROM e, c) SELECT round(ln(sigma2), 6) AS log_sigma2, round(greatest(0, v - sigma2 * u) / sigma2, 6) AS share FROM s""")
def variance_components(spark, sf):
    """Residual variance of the two-way fit, and the difficulties' own as a share of it; a test plants both."""
    r = races(spark, sf)
    d, _ = solve.two_way_cg(r, "person", "cell", "mark", tol=1e-18)
    sigma2, tau2 = est.variance_components(r, "person", "cell", "mark", d)
    return spark.createDataFrame([(round(math.log(sigma2), 6), round(tau2 / sigma2, 6))], "log_sigma2 double, share double")


_B = f"WITH {R}, c0 AS (SELECT DISTINCT cell, 0.0 AS d FROM r)"
for _i in range(3):
    _B += f""", o{_i} AS (SELECT r.person, r.cell, dayno, mark - d AS v FROM r JOIN c{_i} USING (cell)), w{_i} AS (SELECT *, count(v) OVER n - count(v) OVER o AS k, sum(v) OVER n - sum(v) OVER o AS s FROM o{_i} WINDOW n AS (PARTITION BY person ORDER BY dayno RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING), o AS (PARTITION BY person, cell ORDER BY dayno RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
b{_i} AS (SELECT cell, sum(v - s / k) / (count(*) + 20.0) AS x, count(*) AS n FROM w{_i} WHERE k > 0 GROUP BY cell), c{_i + 1} AS (SELECT cell, d + 0.7 * coalesce(x, 0) AS d, coalesce(b{_i}.n, 0) AS n FROM c{_i} LEFT JOIN b{_i} USING (cell))"""


@query(_B + " SELECT cell, round(d, 6) AS difficulty, n FROM c3")
def bracket_engine(spark, sf):
    got = est.bracket_fit(results(spark, sf), ["person"], "cell", "dayno", "mark", 5, 3, 0.7, 20.0)
    return got.select("cell", F.round("difficulty", 6).alias("difficulty"), "n")


_SHAPE = """WITH t AS (SELECT l_suppkey AS k, CAST(p_size AS DOUBLE) AS d, avg(ln(l_extendedprice)) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), q AS (SELECT a.d AS a, b.d AS b, quantile_cont(b.v - a.v, 0.5) AS y, 1 / greatest(1.253 * coalesce(stddev_samp(b.v - a.v), 0) / sqrt(count(*)), 0.01) AS w0 FROM t a JOIN t b ON a.k = b.k AND a.d < b.d GROUP BY ALL),
e AS (SELECT y, w0, ln(b) - ln(a) AS x1, ln(b) ** 2 - ln(a) ** 2 AS x2 FROM q), f0 AS (SELECT *, CAST(1 AS DOUBLE) AS w FROM e)"""
for _i in range(60):  # least squares, then Tukey's weights by the median deviation
    _SHAPE += f""", m{_i} AS (SELECT sum(v * x1 * x1) AS aa, sum(v * x1 * x2) AS ab, sum(v * x2 * x2) AS bb, sum(v * x1 * y) AS ya, sum(v * x2 * y) AS yb FROM (SELECT *, w0 * w0 * w AS v FROM f{_i})), g{_i} AS (SELECT (ya * bb - yb * ab) / (aa * bb - ab * ab) AS g1, (aa * yb - ab * ya) / (aa * bb - ab * ab) AS g2 FROM m{_i}),
r{_i} AS (SELECT f.*, (y - x1 * g1 - x2 * g2) * w0 AS r FROM f{_i} f, g{_i}), d{_i} AS (SELECT 4.685 * 1.4826 * quantile_cont(abs(r - (SELECT quantile_cont(r, 0.5) FROM r{_i})), 0.5) AS s FROM r{_i}), f{_i + 1} AS (SELECT y, w0, x1, x2, (1 - least(abs(r) / s, 1) ** 2) ** 2 AS w FROM r{_i}, d{_i})"""


@query(_SHAPE + " SELECT 1 AS power, round(g1, 5) AS coefficient FROM g59 UNION ALL SELECT 2, round(g2, 5) FROM g59")
def robust_distance_shape(spark, sf):
    """A quadratic potential through the median edges between part sizes; the test plants one with gross outliers."""
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    best = li.groupBy("l_suppkey", F.col("p_size").alias("d")).agg(F.avg(F.log("l_extendedprice")).alias("t"))
    a, b = best.withColumnsRenamed({"d": "a", "t": "x"}), best.withColumnsRenamed({"d": "b", "t": "y"})
    pair = a.join(b, "l_suppkey").where("a < b").select(F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"), (F.col("y") - F.col("x")).alias("lr"))
    got = est.robust_shape(solve.edges(pair, "a", "b", "lr", 0.01), "a", "b", 2)
    return spark.createDataFrame([(i, round(g, 5)) for i, g in enumerate(got, 1)], "power int, coefficient double")


_ERA = f"WITH {L}, s AS (SELECT person, CAST(year(day) AS INTEGER) AS season, avg(ln(mark)) AS v FROM l GROUP BY ALL), t AS (SELECT x.season AS a, quantile_cont(y.v - x.v, 0.5) AS step, CAST(count(*) AS DOUBLE) AS n FROM s x JOIN s y ON x.person = y.person AND y.season = x.season + 1 GROUP BY x.season), x0 AS (SELECT *, step AS x FROM t)"
for _i in range(30):  # a step against its own median and, as second differences, its neighbours
    _ERA += f", x{_i + 1} AS (SELECT a, step, n, (n * step + 5 * (coalesce(lag(x) OVER o, 0) + coalesce(lead(x) OVER o, 0))) / (n + 5 * (CASE WHEN lag(x) OVER o IS NULL THEN 0 ELSE 1 END + CASE WHEN lead(x) OVER o IS NULL THEN 0 ELSE 1 END)) AS x FROM x{_i} WINDOW o AS (ORDER BY a))"


@query(_ERA + ", y AS (SELECT a AS season FROM t UNION SELECT a + 1 FROM t UNION SELECT 1997) SELECT season, round(coalesce((SELECT sum(x) FROM x30 WHERE a >= 1997 AND a < season), 0) - coalesce((SELECT sum(x) FROM x30 WHERE a < 1997 AND a >= season), 0), 7) AS level FROM y")
def era_levels(spark, sf):
    """Season levels from the median steps of persons between neighbouring seasons; the test has the closed form."""
    s = races(spark, sf).groupBy("person", F.year("day").alias("season")).agg(F.avg(F.log("mark")).alias("v"))
    later = s.select("person", (F.col("season") - 1).alias("season"), F.col("v").alias("w"))
    step = s.join(later, ["person", "season"]).groupBy(F.col("season").alias("a")).agg(F.percentile(F.col("w") - F.col("v"), 0.5).alias("step"), F.count("*").cast("double").alias("n")).withColumn("b", F.col("a") + 1)
    got = est.era_curve(step, "a", "b", "step", "n", 5.0, 1997)
    return spark.createDataFrame([(y, round(v, 7)) for y, v in sorted(got.items())], "season int, level double")


_H = lambda key: f"CAST('0x' || substr(md5('3|' || CAST({key} AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < 0.25"


@query(f"WITH {R} SELECT 'row' AS kind, count(*) FILTER (WHERE {_H('id')}) AS held FROM r UNION ALL SELECT 'race', count(*) FILTER (WHERE {_H('dayno')}) FROM r UNION ALL SELECT 'person', count(*) FILTER (WHERE {_H('person')}) FROM r UNION ALL SELECT 'forward', count(*) FILTER (WHERE dayno >= 20) FROM r")
def holdouts(spark, sf):
    r, out = results(spark, sf), None
    for kind, key in (("row", "id"), ("race", "dayno"), ("person", "person"), ("forward", None)):
        df = est.holdout(r, key, 0.25, 3) if key else est.holdout(r, "", 0, 0, "dayno", 20)
        one = df.agg(F.lit(kind).alias("kind"), F.count_if("held").alias("held"))
        out = one if out is None else out.unionByName(one)
    return out


_POISSON = "CASE " + " ".join(f"WHEN u < {c!r} THEN {k}" for k, c in zip(range(8), __import__("itertools").accumulate(__import__("math").exp(-1) / __import__("math").factorial(k) for k in range(8)))) + " ELSE 8 END"


@query(f"WITH {R}, p AS (SELECT dayno, sum(mark) AS s, count(mark) AS n FROM r GROUP BY dayno), m AS (SELECT p.*, t.rep AS repeat, CAST('0x' || substr(md5('5|' || t.rep || '|' || CAST(dayno AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM p, (SELECT unnest(range(1, 21)) AS rep) t) SELECT CAST(repeat AS INTEGER) AS repeat, round(sum({_POISSON} * s) / sum({_POISSON} * n), 6) AS mean FROM m GROUP BY repeat")
def race_bootstrap(spark, sf):
    return est.race_bootstrap(results(spark, sf), "dayno", "mark", 20, 5).withColumn("mean", F.round("mean", 6))


_GAPS = f"WITH {R}, m AS (SELECT person, avg(mark) AS a FROM r GROUP BY person), g AS (SELECT id, dayno, mark - a AS gap FROM r JOIN m USING (person))"


def _gaps(spark, sf):
    r = results(spark, sf)
    return r.join(r.groupBy("person").agg(F.avg("mark").alias("a")), "person").select("id", "dayno", (F.col("mark") - F.col("a")).alias("gap"))


@query(_GAPS + " SELECT dayno, round(quantile_cont(gap, 0.5) * count(*) / (count(*) + 8.0), 6) AS effect, count(*) AS n FROM g GROUP BY dayno")
def provisional_day(spark, sf):
    return est.provisional_effects(_gaps(spark, sf), "dayno", "gap", 8.0).withColumn("effect", F.round("effect", 6))


@query(_GAPS + ", f AS (SELECT dayno, CAST('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 1) AS BIGINT) % 2 AS h, gap FROM g), e AS (SELECT dayno, h, quantile_cont(gap, 0.5) * count(*) / (count(*) + CASE h WHEN 0 THEN 8.0 ELSE 0.0 END) AS x FROM f GROUP BY dayno, h) SELECT round(regr_slope(b.x, a.x), 6) AS slope, count(*) AS n FROM e a JOIN e b ON a.dayno = b.dayno AND a.h = 0 AND b.h = 1")
def provisional_calibration(spark, sf):
    return est.two_fold(_gaps(spark, sf), "dayno", "gap", "id", 8.0).withColumn("slope", F.round("slope", 6))


@query(f"WITH {R}, c AS (SELECT dayno AS x, avg(mark) AS y, count(*) AS n FROM r GROUP BY dayno), p AS (SELECT a.x AS a, b.x AS b, sum(c.y * c.n) / sum(c.n) AS m FROM c a JOIN c b ON a.x <= b.x JOIN c ON c.x BETWEEN a.x AND b.x GROUP BY ALL), q AS (SELECT c.x, p.a, min(m) AS low FROM c JOIN p ON p.a <= c.x AND p.b >= c.x GROUP BY ALL) SELECT x, round(max(low), 6) AS fitted FROM q GROUP BY x")
def form_curve(spark, sf):
    """A monotone form curve over the days."""
    c = results(spark, sf).groupBy(F.col("dayno").alias("x")).agg(F.avg("mark").alias("y"), F.count("*").alias("n"))
    return est.monotone(c, "x", "y", "n").withColumn("fitted", F.round("fitted", 6))


@query(f"WITH {R}, h AS (SELECT id, list({{'ago': dayno, 'v': mark}}) OVER w AS past, dayno FROM r WINDOW w AS (PARTITION BY person ORDER BY dayno, id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) SELECT id, CAST(coalesce(len(past), 0) AS INTEGER) AS n_past, CAST(list_sum(list_transform(past, lambda s: dayno - s.ago)) AS BIGINT) AS days_ago, round(CASE WHEN len(past) >= 2 THEN past[len(past)].v - past[1].v END, 6) AS change FROM h")
def sequence_features(spark, sf):
    got = est.history_features(results(spark, sf), "person", "dayno", "id", "mark", 5)
    ago = F.when(F.col("n_past") > 0, F.aggregate("seq", F.lit(0).cast("long"), lambda a, s: a + s["ago"]))
    return got.select("id", "n_past", ago.alias("days_ago"), F.round("change", 6).alias("change"))


@query(f"WITH {R}, p AS (SELECT mark, avg(mark) OVER (PARTITION BY person) AS a, avg(mark) OVER (PARTITION BY cell) AS b FROM r WHERE mark IS NOT NULL), g AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * mark) AS am, sum(b * mark) AS bm FROM p) SELECT 'person' AS part, round((am * bb - bm * ab) / (aa * bb - ab * ab), 6) AS weight FROM g UNION ALL SELECT 'cell', round((bm * aa - am * ab) / (aa * bb - ab * ab), 6) FROM g")
def blend(spark, sf):
    r = results(spark, sf).where("mark IS NOT NULL")
    p = r.join(r.groupBy("person").agg(F.avg("mark").alias("a")), "person").join(r.groupBy("cell").agg(F.avg("mark").alias("b")), "cell")
    w = est.blend_weights(p, ["a", "b"], "mark")
    return spark.createDataFrame([(n, round(x, 6)) for n, x in zip(("person", "cell"), w)], "part string, weight double")


_KNOTS = [5.0, 15.0, 30.0, 45.0]


def _spline_sql(k: float) -> str:
    cube = lambda x: f"greatest(l_quantity - {x}, 0) ** 3"
    tail = lambda x: f"({cube(x)} - {cube(_KNOTS[-1])}) / {_KNOTS[-1] - x}"
    return f"{tail(k)} - {tail(_KNOTS[-2])}"


_DET = lambda m: "(" + " + ".join(f"{s}{m[0][i]} * {m[1][j]} * {m[2][k]}" for s, i, j, k in (("", 0, 1, 2), ("", 1, 2, 0), ("", 2, 0, 1), ("-1 * ", 2, 1, 0), ("-1 * ", 1, 0, 2), ("-1 * ", 0, 2, 1))) + ")"
_GRAM = [[f"g{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]
# columns scaled to be alike, so that the determinants keep their digits
_BASIS = {"b0": "l_quantity / 10", "b1": f"({_spline_sql(5.0)}) / 1000", "b2": f"({_spline_sql(15.0)}) / 1000"}


@query(within_sql({"y": "l_extendedprice", **_BASIS}) + ", g AS (SELECT " + ", ".join(f"sum(b{i} * b{j}) AS g{i}{j}" for i in range(3) for j in range(i, 3)) + ", " + ", ".join(f"sum(b{i} * y) AS r{i}" for i in range(3)) + " FROM w) " + " UNION ALL ".join(f"SELECT CAST({t} AS INTEGER) AS term, round({_DET([[('r' + str(i)) if j == t else _GRAM[i][j] for j in range(3)] for i in range(3)])} / {_DET(_GRAM)}, 2) AS beta FROM g" for t in range(3)))
def weather_spline(spark, sf):
    """The within regression of weather on a natural spline basis; the test plants a curve."""
    li = table(spark, sf, "lineitem").withColumn("q", F.col("l_quantity").cast("double"))
    basis = [b / s for b, s in zip(est.spline_basis("q", _KNOTS), (10.0, 1000.0, 1000.0))]
    named = li.select("l_suppkey", "l_partkey", "l_extendedprice", *[b.alias(f"b{i}") for i, b in enumerate(basis)])
    got = solve.within_regression(named, "l_suppkey", "l_partkey", "l_extendedprice", [f"b{i}" for i in range(len(basis))], tol=1e-12)
    return spark.createDataFrame([(i, round(b, 2)) for i, b in enumerate(got)], "term int, beta double")


@query(f"WITH {R}, s AS (SELECT *, cast(dayno // 10 AS BIGINT) AS season, row_number() OVER (PARTITION BY person, dayno // 10 ORDER BY dayno, id) = 1 AS first FROM r WHERE mark IS NOT NULL), o AS (SELECT person % 4 AS pool, person, season, max(mark) FILTER (WHERE first) - avg(mark) FILTER (WHERE NOT first) AS d FROM s GROUP BY ALL HAVING count(*) FILTER (WHERE NOT first) >= 2) SELECT pool, round(quantile_cont(d, 0.5) * count(*) / (count(*) + 10), 6) AS rust, count(*) AS n FROM o GROUP BY pool")
def season_rust(spark, sf):
    r = results(spark, sf).withColumn("season", F.floor(F.col("dayno") / 10)).withColumn("pool", F.col("person") % 4)
    return est.rust(r, "person", "season", "dayno", "id", "mark", "pool", 10.0).withColumn("rust", F.round("rust", 6))


@query(f"WITH {R}, v AS (SELECT person, avg(mark) AS a FROM r GROUP BY person), w AS (SELECT cell, avg(mark) AS b FROM r GROUP BY cell), e AS (SELECT dayno, abs(mark - a) - abs(mark - b) AS d FROM r JOIN v USING (person) JOIN w USING (cell) WHERE mark IS NOT NULL), p AS (SELECT dayno, sum(d) AS s, count(d) AS n FROM e GROUP BY dayno), m AS (SELECT p.*, t.rep AS repeat, CAST('0x' || substr(md5('6|' || t.rep || '|' || CAST(dayno AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM p, (SELECT unnest(range(1, 101)) AS rep) t), q AS (SELECT sum({_POISSON} * s) / sum({_POISSON} * n) AS mean FROM m GROUP BY repeat) SELECT round((SELECT avg(d) FROM e), 6) AS difference, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high, avg(CASE WHEN mean >= 0 THEN 1.0 ELSE 0.0 END) AS worse FROM q")
def paired_bootstrap(spark, sf):
    """A person's mean against a cell's mean as predictions, by days drawn anew a hundred times."""
    r = results(spark, sf).where("mark IS NOT NULL")
    e = r.join(r.groupBy("person").agg(F.avg("mark").alias("a")), "person").join(r.groupBy("cell").agg(F.avg("mark").alias("b")), "cell").select("dayno", F.abs(F.col("mark") - F.col("a")).alias("x"), F.abs(F.col("mark") - F.col("b")).alias("y"))
    return est.paired_bootstrap(e, "dayno", "x", "y", 100, 6).withColumns({c: F.round(c, 6) for c in ("difference", "low", "high")})


@query(f"WITH {R}, o AS (SELECT DISTINCT person FROM r WHERE cell <> 'click') SELECT id, CASE WHEN cell <> 'click' THEN false WHEN o.person IS NOT NULL THEN true END AS held FROM r LEFT JOIN o ON r.person = o.person")
def sport_holdout(spark, sf):
    """One kind of event held out whole, for the persons who are known from others."""
    return est.whole_value_holdout(results(spark, sf), "cell", ["click"], "person").select("id", "held")


@query(f"WITH {L}, b AS (SELECT person, avg(ln(mark)) AS base FROM l GROUP BY person), x AS (SELECT race, team, id, mark, base, CASE WHEN id % 4 = 0 THEN NULL ELSE mark END AS extra FROM l JOIN b USING (person)), w AS (SELECT *, count(*) OVER (PARTITION BY race) AS field_n, row_number() OVER o AS k, quantile_cont(base, 0.5) OVER (PARTITION BY race) AS med, lag(base) OVER o AS a, lead(base) OVER o AS z, count(*) OVER t - 1 AS team_n, sum(extra) OVER t AS s, count(extra) OVER t AS c FROM x WINDOW o AS (PARTITION BY race ORDER BY base, id, mark, team), t AS (PARTITION BY race, team)) SELECT id, field_n, round((k - 1) / greatest(field_n - 1, 1), 8) AS rank_pct, round(base - med, 8) AS gap_to_median, round(base - a, 8) AS gap_ahead, round(z - base, 8) AS gap_behind, team_n, round(ln((s - coalesce(extra, 0)) / nullif(c - CASE WHEN extra IS NULL THEN 0 ELSE 1 END, 0)), 7) AS team_mean FROM w")
def race_context(spark, sf):
    r = races(spark, sf)
    x = r.join(r.groupBy("person").agg(F.avg(F.log("mark")).alias("base")), "person").select("race", "team", "id", F.struct("id", "mark", "team").alias("key"), "base", F.when(F.col("id") % 4 != 0, F.col("mark")).alias("extra"))  # some ids repeat
    got = est.race_context(x, "race", "team", "key", "base", "extra").select("id", "field_n", "rank_pct", "gap_to_median", "gap_ahead", "gap_behind", "team_n", "team_mean")
    return got.withColumns({c: F.round(c, 8) for c in ("rank_pct", "gap_to_median", "gap_ahead", "gap_behind")}).withColumn("team_mean", F.round(F.log("team_mean"), 7))


_PRIOR = f"WITH {R}, m AS (SELECT person, avg(mark) AS a FROM r GROUP BY person), g AS (SELECT person % 60 AS cell, dayno, mark - a + sin(person % 60) * 40 AS gap FROM r JOIN m USING (person) WHERE mark IS NOT NULL), c AS (SELECT cell, avg(gap) AS effect, count(*) AS n, sum((gap) ** 2) - count(*) * avg(gap) ** 2 AS ss FROM g GROUP BY cell), w AS (SELECT sum(ss) / (sum(n) - count(*)) AS within, var_samp(effect) AS v, avg(1.0 / n) AS u FROM c)"


@query(_PRIOR + " SELECT cell, round(effect * n / (n + within / (v - within * u)), 6) AS shrunk, n FROM c, w")
def fitted_shrinkage(spark, sf):
    """Cells' effects shrunk by the prior that they themselves give."""
    r = results(spark, sf).where("mark IS NOT NULL")
    g = r.join(r.groupBy("person").agg(F.avg("mark").alias("a")), "person").select((F.col("person") % 60).alias("cell"), (F.col("mark") - F.col("a") + F.sin(F.col("person") % 60) * 40).alias("gap"))
    c = g.groupBy("cell").agg(F.avg("gap").alias("effect"), F.count("*").alias("n"), (F.sum(F.col("gap") ** 2) - F.count("*") * F.avg("gap") ** 2).alias("ss")).checkpoint()
    within = c.agg(F.sum("ss") / (F.sum("n") - F.count("*"))).first()[0]
    prior = est.fitted_prior(c, "effect", "n", within, least=0.0)
    return c.select("cell", F.round(F.col("effect") * F.col("n") / (F.col("n") + prior), 6).alias("shrunk"), "n")


@query(f"WITH {L}, b AS (SELECT person, avg(mark) AS s FROM l GROUP BY person), p AS (SELECT race, cell % 20 AS cell, avg(mark) AS effect, avg(s) AS x FROM l JOIN b USING (person) GROUP BY ALL), d AS (SELECT *, effect - avg(effect) OVER (PARTITION BY cell) AS dy, x - avg(x) OVER (PARTITION BY cell) AS dx FROM p), q AS (SELECT sum(dx * dy) / sum(dx * dx) AS slope, avg(x) AS mean FROM d) SELECT race, cell, round(ln(effect), 5) AS effect, round(ln(effect - slope * (x - mean)), 5) AS adjusted FROM d, q")
def field_adjusted(spark, sf):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    r = bucketed(races(spark, sf).select("race", "person", "cell", "mark").repartition(parts, "person"), "fields", "person", parts)  # joined once, persons' means meet it in place
    own = r.join(r.groupBy("person").agg(F.avg("mark").alias("s")), "person").withColumn("cell", F.col("cell") % 20)
    return est.field_adjusted(own, "race", "cell", "mark", "s").withColumns({c: F.round(F.log(c), 5) for c in ("effect", "adjusted")})
