"""Scoring, normalisation, data quality, solvers, simulation and trees."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import curves
from ..operators import dataquality as dq, ranks, scoring, solve
from .base import L, R, query, races, results, table


@query(f"""WITH {L}, t AS (SELECT cell AS race, team, id, mark FROM (SELECT l.race % 50 AS cell, l.team, l.id, l.mark FROM l)), p AS (SELECT *, row_number() OVER (PARTITION BY race, team ORDER BY mark DESC, id) AS t, count(*) OVER (PARTITION BY race, team) AS n FROM t),
k AS (SELECT *, row_number() OVER (PARTITION BY race ORDER BY mark DESC, id) AS p FROM p WHERE n >= 5 AND t <= 7), s AS (SELECT race, team, CAST(sum(p) FILTER (WHERE t <= 5) AS BIGINT) AS score, coalesce(max(p) FILTER (WHERE t = 6), 1000000) AS sixth FROM k GROUP BY race, team)
SELECT race, team, score, sixth, row_number() OVER (PARTITION BY race ORDER BY score, sixth, team) AS team_place FROM s""")
def xc_team_score(spark, sf):
    r = races(spark, sf).withColumn("race", F.col("race") % 50)
    return scoring.team_scores(r, ["race"], "team", [F.desc("mark"), F.col("id")])


@query(f"""WITH {R}, k AS (SELECT id, dayno, cell, rank() OVER (PARTITION BY dayno, cell ORDER BY floor(mark / 5) DESC) AS place, count(*) OVER (PARTITION BY dayno, cell, floor(mark / 5)) AS tied FROM r),
pts AS (SELECT * FROM (VALUES (1, 10.0), (2, 8.0), (3, 6.0), (4, 5.0), (5, 4.0), (6, 3.0), (7, 2.0), (8, 1.0)) v(s, p))
SELECT id, place, round(coalesce((SELECT sum(p) FROM pts WHERE s >= place AND s < place + tied), 0) / tied, 6) AS points FROM k""")
def points_score_ties(spark, sf):
    got = scoring.points(results(spark, sf), ["dayno", "cell"], F.floor(F.col("mark") / 5).desc())
    return got.select("id", "place", F.round("points", 6).alias("points"))


@query(f"""WITH {L}, a AS (SELECT team, person, round(avg(mark), 6) AS mean FROM l GROUP BY team, person), p AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY mean DESC, person) AS t, count(*) OVER (PARTITION BY team) AS n FROM a),
k AS (SELECT *, row_number() OVER (ORDER BY mean DESC, person, team) AS p FROM p WHERE n >= 5 AND t <= 7), s AS (SELECT team, CAST(sum(p) FILTER (WHERE t <= 5) AS BIGINT) AS score, coalesce(max(p) FILTER (WHERE t = 6), 1000000) AS sixth FROM k GROUP BY team)
SELECT team, score, sixth, row_number() OVER (ORDER BY score, sixth, team) AS team_place FROM s""")
def hypothetical_meet(spark, sf):
    means = races(spark, sf).groupBy("team", "person").agg(F.round(F.avg("mark"), 6).alias("mean")).withColumn("meet", F.lit(1))
    return scoring.team_scores(means, ["meet"], "team", [F.desc("mean"), F.col("person"), F.col("team")]).drop("meet")


@query("""WITH m AS (SELECT l_suppkey, avg(l_extendedprice) AS c FROM lineitem GROUP BY 1), g AS (SELECT avg(l_extendedprice) AS g FROM lineitem), d AS (SELECT l_suppkey, c / g - 1 AS d FROM m, g),
r AS (SELECT l_orderkey * 10 + l_linenumber AS id, 100 * g / (l_extendedprice / (1 + d)) AS rating, d FROM lineitem JOIN d USING (l_suppkey), g)
SELECT id, round(rating, 6) AS rating, round(rating * (1 + d * greatest(0.5, least(1.5, 1 - 0.031 * (rating - 100) / 10))) / (1 + d), 6) AS tilted FROM r""")
def race_and_tilt_rating(spark, sf):
    li = table(spark, sf, "lineitem")
    cell = li.groupBy("l_suppkey").agg(F.avg("l_extendedprice").alias("c"))
    whole = li.agg(F.avg("l_extendedprice").alias("g"))
    d = cell.crossJoin(F.broadcast(whole)).select("l_suppkey", "g", (F.col("c") / F.col("g") - 1).alias("d"))  # one row
    rating = 100 * F.col("g") / (F.col("l_extendedprice") / (1 + F.col("d")))
    r = li.join(d, "l_suppkey").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), rating.alias("rating"), "d")
    return r.select("id", F.round("rating", 6).alias("rating"), F.round(curves.tilted(F.col("rating"), F.col("d")), 6).alias("tilted"))


_KNOTS = [(0.0, 0.0), (2.0, 0.3), (3.0, 0.7), (4.0, 1.5)]


@query("""WITH p AS (SELECT p_partkey, p_retailprice AS t, CAST(p_size AS DOUBLE) AS d FROM part), g AS (SELECT *, ln(d) AS x, ln(10.0) AS y FROM p),
f AS (SELECT *, CASE WHEN x < 2 THEN 0.15 * x WHEN x < 3 THEN 0.3 + (x - 2) * 0.4 ELSE 0.7 + (x - 3) * 0.8 END AS gx, CASE WHEN y < 2 THEN 0.15 * y WHEN y < 3 THEN 0.3 + (y - 2) * 0.4 ELSE 0.7 + (y - 3) * 0.8 END AS gy FROM g)
SELECT p_partkey, round(t * exp(gy - gx), 6) AS normal, round(t * (10.0 / d) ** 1.06, 6) AS riegel FROM f""")
def normalise_time(spark, sf):
    d, t = F.col("p_size").cast("double"), F.col("p_retailprice")
    return table(spark, sf, "part").select("p_partkey", F.round(curves.transfer(t, d, 10.0, _KNOTS), 6).alias("normal"), F.round(curves.riegel(t, d, 10.0), 6).alias("riegel"))


@query("""WITH w AS (SELECT c_custkey, c_acctbal / 500 AS t, c_acctbal / 500 - c_nationkey AS d, CAST(c_nationkey AS DOUBLE) AS la, CAST(c_custkey % 90 AS DOUBLE) AS lo FROM customer)
SELECT c_custkey, round(least(100.0, 100 * exp(17.625 * d / (243.04 + d)) / exp(17.625 * t / (243.04 + t))), 6) AS humidity, round(2 * 6371000.0 * asin(sqrt(least(1.0, sin(radians(10 - la) / 2) ** 2 + cos(radians(la)) * cos(radians(10.0)) * sin(radians(20 - lo) / 2) ** 2))), 3) AS metres FROM w""")
def weather_and_geo(spark, sf):
    t = F.col("c_acctbal") / 500
    la, lo = F.col("c_nationkey").cast("double"), (F.col("c_custkey") % 90).cast("double")
    return table(spark, sf, "customer").select("c_custkey", F.round(curves.relative_humidity(t, t - F.col("c_nationkey")), 6).alias("humidity"), F.round(curves.haversine_m(la, lo, F.lit(10.0), F.lit(20.0)), 3).alias("metres"))


@query(f"""WITH {R} SELECT a.id FROM r a WHERE EXISTS (SELECT 1 FROM r b WHERE b.person = a.person AND b.day = a.day AND b.cell IS NOT DISTINCT FROM a.cell AND abs(a.mark - b.mark) < 5 AND b.id < a.id)""")
def same_day_tolerance_dup(spark, sf):
    return dq.same_day_twins(results(spark, sf), "person", "day", "cell", "mark", "id", 5.0).select("id")


@query(f"""WITH {R}, o AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY dayno, id) AS pos FROM r), p AS (SELECT a.id, a.mark, b.mark AS m, row_number() OVER (PARTITION BY a.id ORDER BY abs(b.dayno - a.dayno), b.dayno, b.id) AS k FROM o a JOIN o b ON a.person = b.person AND a.id <> b.id AND abs(a.pos - b.pos) <= 6),
n AS (SELECT * FROM p WHERE k <= 6), d AS (SELECT id, mark, quantile_cont(m, 0.5) AS med, count(*) AS c FROM n GROUP BY id, mark), s AS (SELECT n.id, 1.4826 * quantile_cont(abs(n.m - d.med), 0.5) AS mad FROM n JOIN d USING (id) GROUP BY n.id)
SELECT d.id, round((d.mark - d.med) / greatest(s.mad, 2.0), 6) AS z FROM d JOIN s USING (id) WHERE c >= 3""")
def neighbour_z(spark, sf):
    got = dq.neighbour_z(results(spark, sf), "person", "dayno", "id", "mark", 6, 2.0)
    return got.where("z IS NOT NULL").select("id", F.round("z", 6).alias("z"))


#: The published rational approximation of the normal quantile's tail (p under 0.02425, relative error 1e-9), with q = sqrt(-2 ln p).
_TAIL = [[-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783], [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996, 3.754408661907416, 1.0]]
_QUANTILE = "-" + " / ".join("(" + " + ".join(f"CAST({c!r} AS DOUBLE) * q ** {len(cs) - 1 - i}" for i, c in enumerate(cs)) + ")" for cs in _TAIL)


@query(f"""WITH {R}, m AS (SELECT person, avg(mark) AS mean FROM r GROUP BY person), g AS (SELECT dayno, mark - mean + CASE WHEN dayno % 11 = 4 THEN 60 ELSE 0 END AS gap FROM r JOIN m USING (person)), s AS (SELECT dayno, quantile_cont(gap, 0.5) AS shift, count(*) AS n, avg(CASE WHEN gap > 0 THEN 1.0 ELSE 0.0 END) AS above FROM g GROUP BY dayno HAVING count(*) >= 5),
z AS (SELECT *, shift / sqrt(25.0 + CAST(1.5707963267948966 AS DOUBLE) * 2500.0 / n) AS z FROM s),
q AS (SELECT sqrt(-2 * ln(0.05 / count(*))) AS q FROM z), c AS (SELECT {_QUANTILE} AS cut FROM q)
SELECT dayno, n, round(z, 6) AS z, abs(z) > cut AND CASE WHEN shift > 0 THEN above ELSE 1 - above END >= 2.0 / 3 AS shifted FROM z, c""")
def race_shift_z(spark, sf):
    r = results(spark, sf)
    gap = r.join(r.groupBy("person").agg(F.avg("mark").alias("mean")), "person").select("dayno", (F.col("mark") - F.col("mean") + F.when(F.col("dayno") % 11 == 4, 60).otherwise(0)).alias("gap"))
    return dq.race_shift(gap, "dayno", "gap", 5.0, 50.0, 5).select("dayno", "n", F.round("z", 6).alias("z"), "shifted")


@query(f"""WITH {L}, m AS (SELECT race, max(CASE WHEN mark > 90000 AND team <> 3 THEN 1 ELSE 0 END) AS bad FROM l GROUP BY race) SELECT id FROM l JOIN m USING (race) WHERE bad = 1""")
def impossible_group(spark, sf):
    return dq.impossible(races(spark, sf).withColumn("exempt", F.col("team") == 3), "race", "mark", 90000.0, "exempt").select("id")


@query(f"""WITH {R} SELECT CASE WHEN mark IS NULL THEN 'no mark' WHEN mark > 150 THEN 'too high' WHEN cell = 'view' THEN 'cell' ELSE 'kept' END AS reason, count(*) AS n FROM r GROUP BY reason""")
def reason_census(spark, sf):
    return dq.census(results(spark, sf), [("no mark", F.col("mark").isNull()), ("too high", F.col("mark") > 150), ("cell", F.col("cell") == "view")])


@query(f"""WITH {R}, p AS (SELECT dayno, cell, mark, avg(mark) OVER (PARTITION BY person ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e, avg(mark) OVER (PARTITION BY person ORDER BY ts, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS l FROM r),
g AS (SELECT dayno, quantile_cont(mark - e, 0.5) AS a, quantile_cont(mark - l, 0.5) AS b, count(e) AS ne, count(l) AS nl FROM p GROUP BY dayno) SELECT dayno, round(CASE WHEN ne >= 10 AND nl >= 10 AND a > 0.5 AND b > 0.5 THEN least(6.0, least(a, b)) ELSE 0 END, 6) AS deflate FROM g""")
def field_check(spark, sf):
    from ..operators import windows

    p = windows.before_after(results(spark, sf), ["person"], ["ts", "id"], "mark")
    return dq.field_check(p, "dayno", "earlier_mean", "later_mean", "mark", 10, 0.5, 6.0).select("dayno", F.round("deflate", 6).alias("deflate"))


@query("""SELECT 'quantity' AS "check", count(*) FILTER (WHERE NOT (l_quantity > 0)) AS violations FROM lineitem UNION ALL SELECT 'discount', count(*) FILTER (WHERE NOT (l_discount <= 0.05)) FROM lineitem""")
def expectation_checks(spark, sf):
    return dq.expectations(table(spark, sf, "lineitem"), {"quantity": F.col("l_quantity") > 0, "discount": F.col("l_discount") <= 0.05})


@query(f"""WITH {L}, d AS (SELECT race, team, min(mark) AS s FROM l GROUP BY ALL) SELECT a.team, b.team AS opponent, count(*) FILTER (WHERE a.s < b.s) AS wins, count(*) AS meetings FROM d a JOIN d b ON a.race = b.race AND a.team <> b.team GROUP BY ALL""")
def win_matrix(spark, sf):
    return scoring.win_matrix(races(spark, sf).groupBy("race", "team").agg(F.min("mark").alias("s")), "race", "team", "s")


_ALS = f"WITH {L}, d0 AS (SELECT DISTINCT cell, 0.0 AS d FROM l)"
for _i in range(3):
    _ALS += f""", a{_i + 1} AS (SELECT person, avg(mark - d) AS a FROM l JOIN d{_i} USING (cell) GROUP BY person), x{_i + 1} AS (SELECT cell, avg(mark - a) AS d, count(*) AS n FROM l JOIN a{_i + 1} USING (person) GROUP BY cell),
d{_i + 1} AS (SELECT cell, d - (SELECT sum(d * n) / sum(n) FROM x{_i + 1}) AS d FROM x{_i + 1})"""


@query(_ALS + " SELECT cell, round(d, 4) AS difficulty FROM d3")
def als_two_way(spark, sf):
    return solve.alternate(races(spark, sf), "person", "cell", "mark", 3)[1].select("cell", F.round("difficulty", 4).alias("difficulty"))


def two_way_sql(rounds: int = 16) -> str:
    """The two-way fit by alternating means, unrolled until it has settled: (cell, d, diag) in ``fit``, d less its mean over rows."""
    sql = f"WITH {L}, n0 AS (SELECT person, cell, count(*) AS n, sum(mark) AS s FROM l GROUP BY ALL), e0 AS (SELECT DISTINCT cell, CAST(0 AS DOUBLE) AS d FROM l)"
    for i in range(rounds):
        sql += f", b{i} AS (SELECT person, sum(s - n * d) / sum(n) AS a FROM n0 JOIN e{i} USING (cell) GROUP BY person), e{i + 1} AS (SELECT cell, sum(s - n * a) / sum(n) AS d FROM n0 JOIN b{i} USING (person) GROUP BY cell)"
    return sql + f""", np AS (SELECT *, sum(n) OVER (PARTITION BY person) AS np FROM n0), dg AS (SELECT cell, sum(n - n * n / np) AS diag, sum(n) AS w FROM np GROUP BY cell),
fit AS (SELECT cell, d - (SELECT sum(d * w) / sum(w) FROM e{rounds} JOIN dg USING (cell)) AS d, diag FROM e{rounds} JOIN dg USING (cell))"""


@query(two_way_sql() + " SELECT cell, round(d, 1) AS difficulty, round(d * 1e6 / (1e6 + 4e8 / diag), 1) AS shrunk FROM fit")
def cg_two_way(spark, sf):
    got = solve.shrink(solve.two_way_cg(races(spark, sf), "person", "cell", "mark", tol=1e-18)[0], 4e8, 1e6)
    return got.select("cell", F.round("difficulty", 1).alias("difficulty"), F.round("shrunk", 1).alias("shrunk"))


_POTENTIALS = f"""WITH {R}, q AS (SELECT a.person, a.cell AS c1, b.cell AS c2, b.mark / a.mark AS ratio, row_number() OVER (PARTITION BY a.person, a.cell, b.cell ORDER BY b.dayno - a.dayno, a.id, b.id) AS k FROM r a JOIN r b ON a.mark > 0 AND b.mark > 0 AND a.person = b.person AND a.id <> b.id AND a.cell <> b.cell AND b.dayno - a.dayno BETWEEN 0 AND 21),
e AS (SELECT c1, c2, quantile_cont(ln(ratio), 0.5) AS edge, 1 / greatest(1.253 * coalesce(stddev_samp(ln(ratio)), 0) / sqrt(count(*)), 0.01) ** 2 AS w FROM q WHERE k = 1 GROUP BY ALL), u AS (SELECT c2 AS i, c1 AS j, edge AS d, w FROM e UNION ALL SELECT c1, c2, -edge, w FROM e), p0 AS (SELECT DISTINCT i, CAST(0 AS DOUBLE) AS p FROM u)"""
for _i in range(80):  # every potential moves most of the way to what its edges say, until all have settled
    _POTENTIALS += f", p{_i + 1} AS (SELECT u.i, 0.3 * any_value(me.p) + 0.7 * sum(w * (it.p + d)) / sum(w) AS p FROM u JOIN p{_i} me ON me.i = u.i JOIN p{_i} it ON it.i = u.j GROUP BY u.i)"


@query(_POTENTIALS + " SELECT i AS cell, round(p - (SELECT p FROM p80 WHERE i = 'click'), 6) AS potential FROM p80")
def transition_potentials(spark, sf):
    from ..operators import joins

    pairs = joins.closest_pairs(results(spark, sf).where("mark > 0"), "person", "id", "dayno", "cell", "mark", 21)
    e = solve.edges(pairs.withColumn("lr", F.log("ratio")), "c1", "c2", "lr", 0.01)
    got = solve.node_potentials(e, "c1", "c2", "click")
    return spark.createDataFrame([(c, round(p, 6)) for c, p in got.items()], "cell string, potential double")


def within_sql(columns: dict[str, str], rounds: int = 14) -> str:
    """Line items with supplier and part means swept out of the columns in turn, unrolled until settled, as the CTE ``w``."""
    sql = "WITH w0 AS (SELECT l_suppkey, l_partkey, " + ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in columns.items()) + " FROM lineitem)"
    for i in range(rounds):
        for j, key in enumerate(("l_suppkey", "l_partkey")):
            source, name = (f"w{i}" if j == 0 else f"h{i}"), (f"h{i}" if j == 0 else f"w{i + 1}")
            sql += f", {name} AS (SELECT l_suppkey, l_partkey, " + ", ".join(f"{c} - avg({c}) OVER (PARTITION BY {key}) AS {c}" for c in columns) + f" FROM {source})"
    return sql + f", w AS (SELECT * FROM w{rounds})"


@query(within_sql({"y": "l_extendedprice", "q": "l_quantity", "x": "l_discount"}) + ", g AS (SELECT sum(q * q) AS a, sum(q * x) AS b, sum(x * x) AS c, sum(q * y) AS u, sum(x * y) AS v FROM w) SELECT 'l_quantity' AS term, round((u * c - v * b) / (a * c - b * b), 4) AS beta FROM g UNION ALL SELECT 'l_discount', round((a * v - b * u) / (a * c - b * b), 4) FROM g")
def weather_within(spark, sf):
    li = table(spark, sf, "lineitem")
    got = solve.within_regression(li, "l_suppkey", "l_partkey", "l_extendedprice", ["l_quantity", "l_discount"], tol=1e-12)
    return spark.createDataFrame([(t, round(b, 4)) for t, b in zip(["l_quantity", "l_discount"], got)], "term string, beta double")


# forward filter, then the smoother over the days in reverse
@query(f"""WITH RECURSIVE {R}, d AS (SELECT person, dayno, avg(mark) AS z, 900.0 / count(*) AS r, row_number() OVER (PARTITION BY person ORDER BY dayno) AS k, count(*) OVER (PARTITION BY person) AS n FROM r WHERE mark IS NOT NULL GROUP BY person, dayno),
f AS (SELECT person, k, n, dayno, CAST(1e6 AS DOUBLE) AS ahead, z AS m, CAST((1 - 1e6 / (1e6 + r)) * 1e6 AS DOUBLE) AS p FROM d WHERE k = 1
UNION ALL SELECT d.person, d.k, d.n, d.dayno, f.p + 4.0 * (d.dayno - f.dayno), f.m + (f.p + 4.0 * (d.dayno - f.dayno)) / (f.p + 4.0 * (d.dayno - f.dayno) + d.r) * (d.z - f.m), (1 - (f.p + 4.0 * (d.dayno - f.dayno)) / (f.p + 4.0 * (d.dayno - f.dayno) + d.r)) * (f.p + 4.0 * (d.dayno - f.dayno)) FROM f JOIN d ON d.person = f.person AND d.k = f.k + 1),
s AS (SELECT person, k, dayno, m AS level, ahead FROM f WHERE k = n UNION ALL SELECT f.person, f.k, f.dayno, f.m + f.p / s.ahead * (s.level - f.m), f.ahead FROM s JOIN f ON f.person = s.person AND f.k = s.k - 1)
SELECT r.person, r.dayno, r.mark, round(s.level, 6) AS level FROM r JOIN s ON r.person = s.person AND r.dayno = s.dayno WHERE r.mark IS NOT NULL""")
def smoothed_levels(spark, sf):
    return solve.smooth_people(results(spark, sf), "person", "dayno", "mark", 4.0, 900.0).withColumn("level", F.round("level", 6))


@query(f"""WITH RECURSIVE {L}, d AS (SELECT race, team, min(mark) AS s FROM l GROUP BY ALL), m AS (SELECT a.team, b.team AS opponent, count(*) FILTER (WHERE a.s < b.s) AS wins, count(*) AS meetings FROM d a JOIN d b ON a.race = b.race AND a.team <> b.team GROUP BY ALL),
beat AS (SELECT coalesce(list(team || '>' || opponent), []) AS b FROM m WHERE wins * 2 > meetings), o AS (SELECT list(team ORDER BY a, team) AS t FROM (SELECT team, avg(mark) AS a FROM l GROUP BY team)),
w AS (SELECT CAST(0 AS BIGINT) AS seat, CAST(NULL AS BIGINT) AS team, t, b FROM o, beat
UNION ALL SELECT seat + 1, CASE WHEN len(t) > 1 AND list_contains(b, t[2] || '>' || t[1]) THEN t[2] ELSE t[1] END, list_filter(t, lambda x: x <> CASE WHEN len(t) > 1 AND list_contains(b, t[2] || '>' || t[1]) THEN t[2] ELSE t[1] END), b FROM w WHERE seat < 8 AND len(t) > 0)
SELECT 'all' AS pool, team, seat FROM w WHERE seat > 0""")
def at_large_selection(spark, sf):
    best = races(spark, sf).groupBy("race", "team").agg(F.min("mark").alias("s"))
    m = scoring.win_matrix(best, "race", "team", "s")
    order = races(spark, sf).groupBy("team").agg(F.avg("mark").alias("a")).withColumn("pool", F.lit("all"))
    order = ranks.numbered(order, [F.col("a"), F.col("team")])
    return scoring.at_large(m, order.drop("a"), "pool", 8)


def _field(spark, sf):
    m = results(spark, sf).where("mark > 0").groupBy("person").agg(F.round(F.avg(F.log("mark")), 9).alias("mu"), F.round(F.coalesce(F.stddev(F.log("mark")), F.lit(0.1)), 9).alias("sigma"))
    return m.withColumn("race", F.col("person") % 7).withColumn("team", F.col("person") % 3)


_U = lambda *x: "((CAST('0x' || substr(md5(concat_ws('|', " + ", ".join(x) + ")), 1, 8) AS BIGINT) + 0.5) / 4294967296.0)"
_N = lambda *x: f"sqrt(-2 * ln({_U(*x, chr(39) + 'a' + chr(39))})) * cos(2 * pi() * {_U(*x, chr(39) + 'b' + chr(39))})"


def _draws(n: int) -> str:
    return f"""{R}, f AS (SELECT person, person % 7 AS race, person % 3 AS team, round(avg(ln(mark)), 9) AS mu, round(coalesce(stddev_samp(ln(mark)), 0.1), 9) AS sigma FROM r WHERE mark > 0 GROUP BY person),
t AS (SELECT race, draw, person, team, exp(mu + sigma * (sqrt(0.3) * {_N("'11'", "race", "draw", "'team'", "team")} + sqrt(0.7) * {_N("'11'", "race", "draw", "'own'", "person")})) AS t FROM f, (SELECT unnest(range(1, {n + 1})) AS draw))"""


@query(f"""WITH {_draws(500)}, b AS (SELECT race, draw, person, 1.0 / count(*) OVER (PARTITION BY race, draw) AS w FROM (SELECT *, min(t) OVER (PARTITION BY race, draw) AS m FROM t) WHERE t = m)
SELECT f.race, f.person, round(coalesce(sum(w), 0) / 500, 9) AS win FROM f LEFT JOIN b ON f.race = b.race AND f.person = b.person GROUP BY f.race, f.person""")
def monte_carlo_win(spark, sf):
    return scoring.simulate(_field(spark, sf), "race", "person", "team", "mu", "sigma", 500, 0.3, 11).withColumn("win", F.round("win", 9))


@query(f"""WITH {_draws(100)}, p AS (SELECT *, row_number() OVER (PARTITION BY race, draw, team ORDER BY t, person) AS k, count(*) OVER (PARTITION BY race, draw, team) AS n FROM t), q AS (SELECT *, row_number() OVER (PARTITION BY race, draw ORDER BY t, person) AS p FROM p WHERE n >= 5 AND k <= 7),
s AS (SELECT race, draw, team, sum(p) FILTER (WHERE k <= 5) AS score, coalesce(max(p) FILTER (WHERE k = 6), 1000000) AS sixth FROM q GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY race, draw ORDER BY score, sixth, team) AS place FROM s)
SELECT race, team, round(count(*) FILTER (WHERE place = 1) / 100.0, 9) AS win FROM w GROUP BY race, team""")
def monte_carlo_team(spark, sf):
    return scoring.simulate_teams(_field(spark, sf), "race", "person", "team", "mu", "sigma", 100, 0.3, 11).withColumn("win", F.round("win", 9))


@query()
def gbt_baseline(spark, sf):
    r = races(spark, sf).join(table(spark, sf, "part"), F.col("race") == F.col("p_partkey")).select("id", F.col("mark").alias("label"), F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size"), "cell")
    held = solve.row_split(r, "id", 0.3, 5)
    return solve.gbt_baseline(held, ["price", "size", "cell"], "label").select("id", "held", "label", "prediction")


def joint_rows(spark, sf):
    """Line items as results for the joint solve: customer, supplier, the supplier's month as its race day, log price, day of year, and a side of +-0.5."""
    e = races(spark, sf)
    return e.select(
        "id", "person", "cell", F.concat_ws("|", F.col("cell").cast("string"), F.date_format("day", "yyyy-MM")).alias("race"), F.log("mark").alias("y"), F.dayofyear("day").cast("double").alias("day"),
        (F.col("team") % 2 - 0.5).cast("double").alias("side"),
    )


@query()
def joint_difficulties(spark, sf):
    """Courses and race days of a joint solve with abilities, sport offsets and a season curve; planted worlds and dense least squares check it."""
    from ..operators import joint

    terms = joint.Terms(side="side", day="day", knots=[1.0, 92.0, 183.0, 274.0, 365.0], variances={"cell": 0.1, "race": 0.01, "side": 0.01})
    effects, _ = joint.joint_solve(joint_rows(spark, sf), "id", "y", terms, sigma2=0.4, tol=1e-9)
    return effects.where("block IN ('cell', 'race')").select("block", "key", "value", "centred")


def _sql_normal(kind, *keys):
    h = "md5('4|" + kind + "|' || " + " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in keys) + ")"
    u = lambda at: f"(CAST('0x' || substr({h}, {at}, 8) AS BIGINT) + 0.5) / 4294967296.0"
    return f"sqrt(-2 * ln({u(1)})) * cos(2 * pi() * {u(9)})"


def _sql_rounds(rounds, chains):
    """The sampler's rounds unrolled: abilities, then difficulties, with mean, slope and noise fixed at 10, 0 and 0.25."""
    sql = f"WITH {L}, c AS (SELECT person, cell, count(*) AS n, sum(ln(mark)) AS sy FROM l GROUP BY ALL), d0 AS (SELECT DISTINCT cell, CAST(chain AS INTEGER) AS chain, CAST(0 AS DOUBLE) AS d FROM c, (SELECT unnest(range({chains})) AS chain))"
    for t in range(rounds):
        for key, name, own, other, prior in (("person", "a", 0.25, f"d{t}", "d"), ("cell", "d", 1.0, f"a{t}", "a")):
            using, out = ("cell", f"a{t}") if name == "a" else ("person", f"d{t + 1}")
            z = _sql_normal(f"{name}|{t}", "chain", key)
            sql += f", s{name}{t} AS (SELECT chain, c.{key}, sum(sy - 10 * n - {prior} * n) AS s, sum(n) / 0.25 + 1 / {own} ** 2 AS p FROM c JOIN {other} USING ({using}) GROUP BY ALL), {out} AS (SELECT chain, {key}, s / 0.25 / p + {z} / sqrt(p) AS {name} FROM s{name}{t})"
    return sql


@query(_sql_rounds(2, 2) + " SELECT chain, cell, round(d, 6) AS d FROM d2")
def gibbs_rounds(spark, sf):
    """Two rounds of two chains of the course sampler over all line items; its whole posterior is checked in planted worlds."""
    from ..operators import gibbs

    kept, _ = gibbs.draws(races(spark, sf).withColumn("y", F.log("mark")), "person", "cell", "y", chains=2, rounds=2, burn=1, seed=4, fixed=(10.0, 0.0, 0.25))
    return kept.select("chain", "cell", F.round("d", 6).alias("d"))


@query()
def gibbs_posterior(spark, sf):
    """Posterior of every course's difficulty with drawn slope, mean and noise, from 1,500 draws: 50 rounds of 30 chains."""
    from ..operators import gibbs

    kept, _ = gibbs.draws(races(spark, sf).withColumn("y", F.log("mark")).withColumn("x", F.dayofyear("day") / 365.0 - 0.5), "person", "cell", "y", "x", chains=30, rounds=70, burn=20)
    return gibbs.posterior(kept)


@query()
def gls_difficulties(spark, sf):
    """Difficulties weighed by levels that wander from day to day; dense generalised least squares checks the operator."""
    from ..operators import gls

    return gls.gls_cells(results(spark, sf), "person", "cell", "dayno", "mark", 4.0, 900.0, 400.0)[0]


@query()
def rank_order(spark, sf):
    """Rows of every part in the order that rank-loss trees expect, from price and quantity; planted races check the operator."""
    from ..operators import rank_trees

    li = table(spark, sf, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber")).withColumn("day", F.dayofyear("l_shipdate").cast("double"))
    model = rank_trees.fit(li, "l_partkey", ["l_extendedprice", "id"], ["l_quantity", "l_discount", "day"], rounds=3)
    return model.transform(li).select("l_partkey", "id", "score")


@query()
def scored_lineup(spark, sf):
    """The lineup that wins most often for the first nation of Europe's meet, entries being each nation's nine best customers; a plain simulation checks it."""
    from ..operators import lineups

    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).where("n_regionkey = 3")
    own = races(spark, sf).groupBy("person").agg(F.avg(F.log("mark")).alias("level"), F.stddev(F.log("mark")).alias("sd"), F.count("*").alias("n")).where("n >= 3")
    entries = own.join(c, own["person"] == c["c_custkey"]).select("person", F.col("c_nationkey").cast("long").alias("team"), F.exp("level").alias("mean"), F.coalesce("sd", F.lit(0.0)).alias("sd"))
    best = entries.withColumn("_k", F.row_number().over(Window.partitionBy("team").orderBy("mean", "person"))).where("_k <= 9").drop("_k")
    first = best.agg(F.min("team")).first()[0]
    got = lineups.best_lineup(best, first, draws=500, seed=1)
    return spark.createDataFrame([(p, got["p_win"], got["score"], got["looked_at"]) for p in got["lineup"]], "person long, p_win double, score double, looked_at long")
