"""Places, links, identities and repairs on the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from ..operators import joins, places
from .base import L, R, query, races, results, table

_P = "p AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'Hill ' ELSE 'Park ' END || CAST(s_suppkey % 4 AS VARCHAR) AS name, 30.0 + (s_suppkey * 7919 % 1000) / 2000.0 AS lat, -100.0 + (s_suppkey * 104729 % 1000) / 2000.0 AS lon FROM supplier)"


def _places(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(k.alias("id"), F.concat(F.when(k % 3 == 0, "Hill ").otherwise("Park "), (k % 4).cast("string")).alias("name"), (30.0 + (k * 7919 % 1000) / 2000.0).alias("lat"), (-100.0 + (k * 104729 % 1000) / 2000.0).alias("lon"))


_HAV = "2 * 6371000.0 * asin(sqrt(least(1.0, sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ** 2)))"
_NEAR = f"n AS (SELECT a.id AS a, b.id AS b, {_HAV} AS metres, (CASE WHEN levenshtein(split_part(a.name, ' ', 1), split_part(b.name, ' ', 1)) <= 1 THEN 1 ELSE 0 END + CASE WHEN levenshtein(split_part(a.name, ' ', 2), split_part(b.name, ' ', 2)) <= 1 THEN 1 ELSE 0 END) / 2.0 AS similarity FROM p a JOIN p b ON a.id < b.id AND {_HAV} <= 9000 WHERE split_part(a.name, ' ', 1) = split_part(b.name, ' ', 1))"


@query(f"WITH {_P}, {_NEAR} SELECT a, b, round(metres, 3) AS metres, similarity FROM n")
def near_places(spark, sf):
    """A park and a hill have one word of two in common at most, which is too little; digits are one edit apart, which is close."""
    return places.near_places(_places(spark, sf), 9000.0, 0.6).withColumn("metres", F.round("metres", 3))


_CANON = f"WITH {_P}, {_NEAR}, e AS (SELECT a AS s, b AS d FROM n UNION SELECT b, a FROM n), m0 AS (SELECT id, id AS c FROM p)"
for _i in range(14):
    _CANON += f", m{_i + 1} AS (SELECT id, min(c) AS c FROM (SELECT * FROM m{_i} UNION ALL SELECT s, c FROM e JOIN m{_i} ON d = id) GROUP BY id)"


@query(_CANON + " SELECT id, c AS canonical FROM m14")
def canonical_places(spark, sf):
    p = _places(spark, sf)
    return places.canonical_places(p, places.near_links(p, 9000.0, 0.6))


@query(f"WITH {_P}, v AS (SELECT round(lat, 1) AS lat, round(lon, 1) AS lon, CAST(min(id) AS DOUBLE) * 3 AS elevation FROM p WHERE id % 3 = 0 GROUP BY 1, 2) SELECT p.id, coalesce(elevation, 100.0) AS elevation FROM p LEFT JOIN v ON CAST(round(p.lat * 10) AS BIGINT) = CAST(round(v.lat * 10) AS BIGINT) AND CAST(round(p.lon * 10) AS BIGINT) = CAST(round(v.lon * 10) AS BIGINT)")
def elevation_backfill(spark, sf):
    """Venues' elevations joined on rounded coordinates, a default where there is none."""
    p = _places(spark, sf)
    v = p.where("id % 3 = 0").groupBy(F.round("lat", 1).alias("lat"), F.round("lon", 1).alias("lon")).agg((F.min("id").cast("double") * 3).alias("elevation"))
    return places.rounded_join(p, v, ["lat", "lon"], 1).select("id", F.coalesce("elevation", F.lit(100.0)).alias("elevation"))


_WEATHER = "w AS (SELECT CAST(floor(lat / 0.25 + 0.5) AS BIGINT) AS cell_lat, CAST(floor(lon / 0.25 + 0.5) AS BIGINT) AS cell_lon, day, hour, CAST((id * 31 + hour * 7) % 40 AS DOUBLE) AS temp FROM p, (SELECT unnest(range(0, 24)) AS hour) h, (SELECT unnest(range(0, 3)) AS day) d WHERE id % 5 < 3)"


def _weather(spark, sf):
    p = _places(spark, sf).where("id % 5 < 3").withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23)))).withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return p.select(places.snap(F.col("lat"), 0.25).alias("cell_lat"), places.snap(F.col("lon"), 0.25).alias("cell_lon"), "day", "hour", ((F.col("id") * 31 + F.col("hour") * 7) % 40).cast("double").alias("temp"))


@query(f"WITH {_P}, {_WEATHER}, d AS (SELECT cell_lat, cell_lon, day, avg(temp) AS temp, count(*) AS n_hours FROM w WHERE (CAST(hour + round(cell_lon * 0.25 / 15) AS BIGINT) % 24 + 24) % 24 BETWEEN 8 AND 12 GROUP BY ALL) SELECT p.id, CAST(p.id % 3 AS BIGINT) AS day, round(temp, 6) AS temp, n_hours FROM p LEFT JOIN d ON cell_lat = CAST(floor(lat / 0.25 + 0.5) AS BIGINT) AND cell_lon = CAST(floor(lon / 0.25 + 0.5) AS BIGINT) AND d.day = p.id % 3")
def weather_cells(spark, sf):
    at = _places(spark, sf).withColumn("day", F.col("id") % 3)
    return places.weather_at(at, _weather(spark, sf), 0.25, (8, 12)).select("id", "day", F.round("temp", 6).alias("temp"), "n_hours")


@query(f"WITH {_P}, c AS (SELECT CAST(floor(lat / 0.05 + 0.5) AS BIGINT) AS cell_lat, CAST(floor(lon / 0.05 + 0.5) AS BIGINT) AS cell_lon FROM p) SELECT CAST(floor(cell_lat / 4.0) AS BIGINT) AS tile_lat, CAST(floor(cell_lon / 4.0) AS BIGINT) AS tile_lon, count(DISTINCT (cell_lat, cell_lon)) AS cells, min(cell_lat) AS south, max(cell_lat) AS north FROM c GROUP BY 1, 2")
def weather_tiles(spark, sf):
    return places.tiles(_places(spark, sf).select(places.snap(F.col("lat"), 0.05).alias("cell_lat"), places.snap(F.col("lon"), 0.05).alias("cell_lon")), 4)


@query("WITH a AS (SELECT c_nationkey, c_mktsegment, round(avg(c_acctbal), 4) AS v FROM customer WHERE c_nationkey % 3 = 0 GROUP BY ALL), b AS (SELECT c_nationkey, round(avg(c_acctbal), 4) AS v FROM customer WHERE c_nationkey % 3 = 1 GROUP BY ALL), g AS (SELECT round(avg(c_acctbal), 4) AS v FROM customer) SELECT c_custkey, coalesce(a.v, b.v, g.v) AS v, CASE WHEN a.v IS NOT NULL THEN 0 WHEN b.v IS NOT NULL THEN 1 ELSE 2 END AS level FROM customer c LEFT JOIN a USING (c_nationkey, c_mktsegment) LEFT JOIN b USING (c_nationkey), g")
def fallback_chain(spark, sf):
    c = table(spark, sf, "customer")
    mean = F.round(F.avg("c_acctbal"), 4).alias("v")
    chain = [(c.where("c_nationkey % 3 = 0").groupBy("c_nationkey", "c_mktsegment").agg(mean), ["c_nationkey", "c_mktsegment"]), (c.where("c_nationkey % 3 = 1").groupBy("c_nationkey").agg(mean), ["c_nationkey"]), (c.agg(mean), [])]
    return places.fallback(c.select("c_custkey", "c_nationkey", "c_mktsegment"), chain, "v").select("c_custkey", "v", "level")


@query("WITH x AS (SELECT l_suppkey AS team, l_orderkey AS k, 'n' || CAST(l_partkey % 30 AS VARCHAR) AS n, l_linenumber % 2 AS side FROM lineitem), v AS (SELECT l.team AS lt, r.team AS rt, count(*) AS votes FROM x l JOIN x r ON l.k = r.k AND l.side = 0 AND r.side = 1 AND levenshtein(l.n, r.n) <= 1 GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY lt ORDER BY votes DESC, rt) AS p, sum(votes) OVER (PARTITION BY lt) AS s FROM v) SELECT a.lt AS left_team, a.rt AS right_team, a.votes FROM o a LEFT JOIN o b ON a.lt = b.lt AND b.p = 2 WHERE a.p = 1 AND a.votes >= 3 AND a.votes >= 0.02 * a.s AND a.votes - coalesce(b.votes, 0) >= 1")
def entity_links(spark, sf):
    """Teams of two feeds linked by the votes of athletes with the same key and a close name."""
    li = table(spark, sf, "lineitem").select("l_linenumber", F.col("l_suppkey").alias("team"), F.col("l_orderkey").alias("k"), F.concat(F.lit("n"), (F.col("l_partkey") % 30).cast("string")).alias("name"))
    votes = places.link_votes(li.where("l_linenumber % 2 = 0"), li.where("l_linenumber % 2 = 1"), ["k"], 1.0)
    return places.decide_links(votes, 3, 0.02, 1)


@query(f"WITH {R}, g AS (SELECT person, CASE id % 5 WHEN 0 THEN 'F' WHEN 4 THEN NULL ELSE 'M' END AS gender FROM r), n AS (SELECT person, count(*) FILTER (WHERE gender = 'M') AS n_m, count(*) FILTER (WHERE gender = 'F') AS n_f FROM g GROUP BY person) SELECT person, CASE WHEN n_m >= 0.76 * (n_m + n_f) THEN 'M' WHEN n_f >= 0.76 * (n_m + n_f) THEN 'F' END AS gender, n_m, n_f, NOT (n_m >= 0.76 * (n_m + n_f) OR n_f >= 0.76 * (n_m + n_f)) AS split FROM n WHERE n_m + n_f > 0")
def majority_gender(spark, sf):
    g = results(spark, sf).withColumn("gender", F.when(F.col("id") % 5 == 0, "F").when(F.col("id") % 5 != 4, "M"))
    return places.majority_gender(g, "person", "gender", 0.76)


_GRADED = f"WITH {L}, s AS (SELECT person, CAST(year(day) AS BIGINT) AS season, CAST(year(day) - 1990 + CASE WHEN person % 3 = 0 AND year(day) >= 1999 THEN -4 WHEN person % 3 = 1 AND year(day) >= 2000 THEN -1 ELSE 0 END AS BIGINT) AS grade FROM l WHERE (person + year(day)) % 7 <> 0 GROUP BY ALL)"


def _graded(spark, sf):
    y = F.year("day").cast("long")
    off = F.when((F.col("person") % 3 == 0) & (y >= 1999), -4).when((F.col("person") % 3 == 1) & (y >= 2000), -1).otherwise(0)
    return races(spark, sf).where((F.col("person") + y) % 7 != 0).select("person", y.alias("season"), (y - 1990 + off).cast("long").alias("grade")).distinct()


@query(_GRADED + ", m AS (SELECT *, season - lag(season) OVER w > 1 OR abs((season - grade) - lag(season - grade) OVER w) > 2 AS moved FROM s WINDOW w AS (PARTITION BY person ORDER BY season)) SELECT person, season, CAST(sum(CASE WHEN moved THEN 1 ELSE 0 END) OVER (PARTITION BY person ORDER BY season) AS BIGINT) AS part FROM m")
def person_splits(spark, sf):
    return places.person_splits(_graded(spark, sf), "person", "season", "grade", 1, 2).select("person", "season", "part")


@query(_GRADED + ", o AS (SELECT *, (grade - lag(grade) OVER w) - (season - lag(season) OVER w) AS off FROM s WINDOW w AS (PARTITION BY person ORDER BY season)) SELECT person, count(*) AS seasons, count(*) FILTER (WHERE off = -1) AS repeats, count(*) FILTER (WHERE off NOT IN (0, -1)) AS breaks, count(*) >= 3 AND count(*) FILTER (WHERE off NOT IN (0, -1)) = 0 AND count(*) FILTER (WHERE off = -1) <= 1 AS trusted FROM o GROUP BY person")
def trusted_grades(spark, sf):
    return places.trusted_grades(_graded(spark, sf), "person", "season", "grade", 3)


_YEARS = "WITH e AS (SELECT DISTINCT o_orderkey % 50 + 100 * CAST(year(o_orderdate) AS BIGINT) AS meet, o_custkey % 40 + 1000 * (CAST(year(o_orderdate) AS BIGINT) % 2) AS person, CAST(year(o_orderdate) AS BIGINT) + CASE WHEN o_orderkey % 50 = 7 THEN 9 ELSE 0 END AS year FROM orders)"


@query(_YEARS + ", o AS (SELECT a.meet, a.person, a.year, min(abs(b.year - a.year)) AS z, min(abs(b.year - a.year - 1)) AS p, min(abs(b.year - a.year + 1)) AS m FROM e a JOIN e b ON a.person = b.person AND a.meet <> b.meet GROUP BY ALL), v AS (SELECT meet, count(*) AS voters, count(*) FILTER (WHERE NOT (z <= p AND z <= m) AND m < p) AS v0, count(*) FILTER (WHERE NOT (z <= p AND z <= m) AND p < m) AS v2 FROM o GROUP BY meet) SELECT meet, CASE WHEN v0 >= v2 THEN -1 ELSE 1 END AS shift, greatest(v0, v2) AS votes, voters, round((SELECT sum(exp(lgamma(voters + 1) - lgamma(k + 1) - lgamma(voters - k + 1) + k * ln(0.25) + (voters - k) * ln(0.75))) FROM (SELECT unnest(range(greatest(v0, v2), voters + 1)) AS k)), 8) AS chance FROM v WHERE voters >= 2 AND greatest(v0, v2) >= 0.6 * voters AND (SELECT sum(exp(lgamma(voters + 1) - lgamma(k + 1) - lgamma(voters - k + 1) + k * ln(0.25) + (voters - k) * ln(0.75))) FROM (SELECT unnest(range(greatest(v0, v2), voters + 1)) AS k)) <= 0.05")
def wrong_year_votes(spark, sf):
    o = table(spark, sf, "orders")
    y = F.year("o_orderdate").cast("long")
    e = o.select((F.col("o_orderkey") % 50 + 100 * y).alias("meet"), (F.col("o_custkey") % 40 + 1000 * (y % 2)).alias("person"), (y + F.when(F.col("o_orderkey") % 50 == 7, 9).otherwise(0)).alias("year")).distinct()
    return places.wrong_years(e.select("meet", "year").distinct(), e, 2, 0.6, 0.25, 0.05).withColumn("chance", F.round("chance", 8))


@query(f"WITH {L}, m AS (SELECT person, avg(ln(mark)) AS a FROM l WHERE mark > 0 GROUP BY person), s AS (SELECT race, CAST(3000 + 1000 * (race % 3) AS DOUBLE) AS listed, quantile_cont(ln(mark) - a, 0.5) AS median, count(*) AS n FROM l JOIN m USING (person) WHERE mark > 0 GROUP BY race HAVING count(*) >= 5), f AS (SELECT *, list_sort([(abs(median - ln(3000 / listed)), 3000.0), (abs(median - ln(4000 / listed)), 4000.0), (abs(median - ln(5000 / listed)), 5000.0)])[1] AS b FROM s) SELECT race, listed, CAST(b[2] AS DOUBLE) AS suggested, round(median, 6) AS median, n FROM f WHERE abs(median) > 0.15 AND b[1] <= 0.15")
def distance_verdicts(spark, sf):
    r = races(spark, sf).where("mark > 0")
    gap = r.join(r.groupBy("person").agg(F.avg(F.log("mark")).alias("a")), "person").select("race", (3000 + 1000 * (F.col("race") % 3)).cast("double").alias("listed"), (F.log("mark") - F.col("a")).alias("gap"))
    return places.distance_verdicts(gap, "race", "gap", "listed", [3000.0, 4000.0, 5000.0], 5, 0.15).withColumn("median", F.round("median", 6))


@query("WITH e AS (SELECT DISTINCT c_nationkey * 10 + c_custkey % 3 AS a, 1000 + c_nationkey % 7 * 40 + c_custkey % 40 AS b FROM customer), u AS (SELECT a AS s, b AS d FROM e UNION SELECT b, a FROM e), m0 AS (SELECT s AS id, s AS c FROM u GROUP BY s)" + "".join(f", m{i + 1} AS (SELECT id, min(c) AS c FROM (SELECT * FROM m{i} UNION ALL SELECT s, c FROM u JOIN m{i} ON d = id) GROUP BY id)" for i in range(16)) + " SELECT c AS cluster, count(*) AS names FROM m16 WHERE id < 1000 GROUP BY c")
def school_identity(spark, sf):
    """School names that race with the same teams belong to one school; nations of one remainder by seven share teams."""
    from ..operators import setops

    e = table(spark, sf, "customer").select((F.col("c_nationkey") * 10 + F.col("c_custkey") % 3).alias("src"), (1000 + F.col("c_nationkey") % 7 * 40 + F.col("c_custkey") % 40).alias("dst")).distinct()
    return setops.components(e).where("id < 1000").groupBy(F.col("component").alias("cluster")).agg(F.count("*").alias("names"))


@query(f"WITH {R}, k AS (SELECT DISTINCT dayno * 10 + id % 3 AS canon, CAST(floor(mark / 10) AS BIGINT) AS place, CAST(round(mark * 10) AS BIGINT) // 20 AS t FROM r WHERE id % 2 = 0) SELECT id FROM r WHERE id % 2 = 1 AND EXISTS (SELECT 1 FROM k WHERE canon = dayno * 10 + id % 3 AND place = CAST(floor(mark / 10) AS BIGINT) AND t = CAST(round(mark * 10) AS BIGINT) // 20)")
def composite_rounded_key(spark, sf):
    keyed = results(spark, sf).where("mark IS NOT NULL").select("id", (F.col("dayno") * 10 + F.col("id") % 3).alias("canon"), F.floor(F.col("mark") / 10).alias("place"), F.floor(F.round(F.col("mark") * 10) / 20).alias("t"))
    return keyed.where("id % 2 = 1").join(keyed.where("id % 2 = 0").drop("id"), ["canon", "place", "t"], "left_semi").select("id")


@query(f"WITH {R}, w AS (SELECT DISTINCT person, dayno AS until FROM r WHERE id % 10 = 0) SELECT w.person, until, count(r.id) AS n, round(max(mark), 6) AS best FROM w LEFT JOIN r ON r.person = w.person AND r.dayno BETWEEN until - 5 AND until GROUP BY w.person, until")
def probe_by_id(spark, sf):
    """Each wanted id's rows of the days before: one join on the id with a date range."""
    r = results(spark, sf)
    wanted = r.where("id % 10 = 0").select("person", F.col("dayno").alias("until")).distinct()
    near = (r["person"] == wanted["person"]) & r["dayno"].between(F.col("until") - 5, F.col("until"))
    return wanted.join(r, near, "left").groupBy(wanted["person"], "until").agg(F.count("id").alias("n"), F.round(F.max("mark"), 6).alias("best"))


@query(f"WITH {R}, w AS (SELECT *, count(mark) OVER n - count(mark) OVER o AS k, sum(mark) OVER n - sum(mark) OVER o AS s FROM r WINDOW n AS (PARTITION BY person ORDER BY dayno RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING), o AS (PARTITION BY person, dayno)) SELECT id, k AS n_other, round(CASE WHEN k > 0 THEN s / k END, 6) AS others FROM w")
def other_race_means(spark, sf):
    """Mean of a person's other races within three days either side; a race is a day here."""
    r = results(spark, sf)
    got = joins.interval_bracket(r.withColumn("race", F.col("dayno")), ["person"], "race", "dayno", "mark", 3)
    return got.select("id", "n_other", F.round(F.col("mark") - F.col("bracket"), 6).alias("others"))


@query(f"WITH {R}, b AS (SELECT person, CAST(dayno // 10 AS BIGINT) AS season, cell, max(mark) AS best FROM r GROUP BY ALL HAVING count(*) >= 1) SELECT a.person, a.season, a.cell AS c1, b.cell AS c2, round(b.best - a.best, 6) AS gap FROM b a JOIN b ON a.person = b.person AND a.season = b.season AND a.cell < b.cell")
def season_best_pairs(spark, sf):
    r = results(spark, sf).withColumn("season", F.floor(F.col("dayno") / 10))
    best = r.groupBy("person", "season", "cell").agg(F.max("mark").alias("best"))
    a, b = best.withColumnsRenamed({"cell": "c1", "best": "x"}), best.withColumnsRenamed({"cell": "c2", "best": "y"})
    return a.join(b, ["person", "season"]).where("c1 < c2").select("person", "season", "c1", "c2", F.round(F.col("y") - F.col("x"), 6).alias("gap"))


@query("WITH s AS (SELECT c_custkey AS id, c_mktsegment AS pool, c_nationkey AS grade, c_acctbal AS rating, 50.0 + c_custkey % 7 * 10 AS error FROM customer) SELECT a.id AS a, b.id AS b, round(abs(a.rating - b.rating), 4) AS gap FROM s a JOIN s b ON a.pool = b.pool AND a.grade = b.grade AND a.id <> b.id AND abs(a.rating - b.rating) <= a.error")
def comps_within_error(spark, sf):
    """Seasons of the same pool and grade within the season's own error radius."""
    s = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("pool"), F.col("c_nationkey").alias("grade"), F.col("c_acctbal").alias("rating"), (50.0 + F.col("c_custkey") % 7 * 10).alias("error"))
    return joins.within_radius(s, ["pool", "grade"], "id", "rating", "error", 110.0).withColumn("gap", F.round("gap", 4))


_MIX = f"""WITH {L}, m AS (SELECT person, avg(ln(mark)) AS a FROM l GROUP BY person), g AS (SELECT race, id, ln(mark) - a + CASE WHEN race % 5 = 0 AND id % 3 = 0 THEN 4 ELSE 0 END AS gap FROM l JOIN m USING (person)),
c AS (SELECT *, count(*) OVER (PARTITION BY race) AS n, gap - avg(gap) OVER (PARTITION BY race) AS x, row_number() OVER (PARTITION BY race ORDER BY gap, id) AS i FROM g),
p AS (SELECT *, sum(x) OVER k AS s, sum(x) OVER (PARTITION BY race) AS st, sum(x * x) OVER (PARTITION BY race) AS qt FROM c WHERE n >= 4 WINDOW k AS (PARTITION BY race ORDER BY i)),
b AS (SELECT race, arg_min(i, (round(qt - s * s / i - (st - s) ** 2 / (n - i), 9), i)) AS n_low FROM p WHERE i < n GROUP BY race),
v AS (SELECT race, n, n_low, quantile_cont(gap, 0.5) FILTER (WHERE i <= n_low) AS low, quantile_cont(gap, 0.5) FILTER (WHERE i > n_low) AS high, quantile_cont(gap, 0.75) FILTER (WHERE i <= n_low) - quantile_cont(gap, 0.25) FILTER (WHERE i <= n_low) AS l, quantile_cont(gap, 0.75) FILTER (WHERE i > n_low) - quantile_cont(gap, 0.25) FILTER (WHERE i > n_low) AS h FROM p JOIN b USING (race) GROUP BY ALL)"""


@query(_MIX + " SELECT race, n, n_low, round(low, 6) AS low, round(high, 6) AS high, least(n_low, n - n_low) >= greatest(4, 0.15 * n) AND high - low >= 1.0 AND high - low >= 2 * greatest(l, h) AS mixed FROM v")
def mixed_races(spark, sf):
    """Races that hold two: every third row of every fifth part is moved by a factor."""
    r = races(spark, sf)
    moved = F.when((F.col("race") % 5 == 0) & (F.col("id") % 3 == 0), 4).otherwise(0)
    gap = r.join(r.groupBy("person").agg(F.avg(F.log("mark")).alias("a")), "person").select("race", "id", (F.log("mark") - F.col("a") + moved).alias("gap"))
    return places.mixture_split(gap, "race", "id", "gap", 4, 0.15, 1.0).withColumns({c: F.round(c, 6) for c in ("low", "high")})


_NAMES = "n AS (SELECT DISTINCT lower(p_name || ' ' || p_brand || ' ' || p_type) AS name FROM part), g AS (SELECT name, list_distinct(list_transform(range(1, len(name) + 2), lambda i: substr('  ' || name || ' ', CAST(i AS BIGINT), 3))) AS g FROM n)"


@query(f"WITH {_NAMES}, p AS (SELECT a.name AS a, b.name AS b, len(list_intersect(a.g, b.g)) AS c, len(a.g) + len(b.g) AS t FROM g a JOIN g b ON a.name < b.name) SELECT a, b, round(c / (t - c), 9) AS similarity FROM p WHERE c / (t - c) >= 0.7")
def trigram_pairs(spark, sf):
    """All pairs of different part names alike in their trigrams, by an inverted index."""
    from ..operators import names

    n = table(spark, sf, "part").select(F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("name"))
    return names.alike(names.trigram_sets(n, "name"), 0.7).withColumn("similarity", F.round("similarity", 9))


@query(f"WITH {_NAMES}, q AS (SELECT lower(s_name) AS word, substr(lower(p_name || ' ' || p_type), 2) AS name FROM supplier JOIN part ON s_suppkey = p_partkey), qg AS (SELECT DISTINCT name, list_distinct(list_transform(range(1, len(name) + 2), lambda i: substr('  ' || name || ' ', CAST(i AS BIGINT), 3))) AS g FROM q), p AS (SELECT qg.name AS query, g.name AS found, len(list_intersect(qg.g, g.g)) AS c, len(qg.g) + len(g.g) AS t FROM qg, g) SELECT query, found, round(c / (t - c), 9) AS similarity, CAST(row_number() OVER (PARTITION BY query ORDER BY c / (t - c) DESC, found) AS INTEGER) AS rank FROM p WHERE c / (t - c) >= 0.4 QUALIFY row_number() OVER (PARTITION BY query ORDER BY c / (t - c) DESC, found) <= 5")
def trigram_search(spark, sf):
    """Misspelt names (their first letter lost, the brand left out) against all part names: the five most alike."""
    from ..operators import names

    n = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("name"), F.concat_ws(" ", "p_name", "p_type").alias("short"))
    asked = n.join(table(spark, sf, "supplier"), F.col("p_partkey") == F.col("s_suppkey")).select(F.substr("short", F.lit(2)).alias("name"))
    return names.search(names.trigram_sets(asked, "name"), names.trigram_sets(n, "name"), 0.4, 5).withColumn("similarity", F.round("similarity", 9))


@query("SELECT CAST(user_id % 36 AS BIGINT) AS lat, CAST(event_id % 48 AS BIGINT) AS lon, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day, round(avg(value), 6) AS value FROM events WHERE value IS NOT NULL AND user_id % 36 BETWEEN 5 AND 20 AND event_id % 48 < 30 GROUP BY ALL")
def array_box(spark, sf):
    """Grid cells from array tiles, a box of them: only its tiles are opened."""
    from ..session import shared_dir
    from ..sources import tiles

    cells = results(spark, sf).where("mark IS NOT NULL").select((F.col("person") % 36).alias("lat"), (F.col("id") % 48).alias("lon"), F.col("dayno").alias("day"), "mark").groupBy("lat", "lon", "day").agg(F.avg("mark").alias("value"))
    path = f"{shared_dir(spark)}/tiles-{uuid.uuid4().hex}"
    tiles.write_tiles(cells, path, 12, 0.1, 20.0)
    return tiles.read_tiles(spark, path, 12).where("lat >= 5 AND lat <= 20 AND lon < 30").select("lat", "lon", "day", F.round("value", 6).alias("value"))


def merge_inputs(spark, sf):
    """Suppliers to be merged: a vote for suppliers that follow each other in an order, and neighbours within a nation that must stay apart."""
    li, s = table(spark, sf, "lineitem"), table(spark, sf, "supplier")
    before = F.lag("l_suppkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    votes = li.withColumn("a", before).where("a IS NOT NULL AND a <> l_suppkey").groupBy("a", F.col("l_suppkey").alias("b")).agg(F.count("*").cast("double").alias("votes"))
    apart = s.withColumn("b", F.lead("s_suppkey").over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))).where("b IS NOT NULL").select(F.col("s_suppkey").alias("a"), "b")
    return s.select(F.col("s_suppkey").alias("id")), votes, apart


@query()
def merged_identities(spark, sf):
    """Suppliers merged by votes without a forbidden pair, with ids kept from a run over the stronger votes alone; a plain version checks it."""
    from ..operators import merging

    ids, votes, apart = merge_inputs(spark, sf)
    first = merging.keep_ids(merging.merge_classes(ids, votes.where("votes >= 12"), apart, 12), None).checkpoint()
    return merging.keep_ids(merging.merge_classes(ids, votes, apart, 8), first)


_GRADED = """e AS (SELECT o_custkey AS person, CAST(year(o_orderdate) AS BIGINT) AS season, o_orderkey % 97 AS race, CASE WHEN o_orderkey % 5 < 2 THEN NULL WHEN o_orderkey % 13 = 0 THEN o_orderkey % 20 ELSE year(o_orderdate) - 1988 + o_custkey % 4 END AS grade FROM orders)"""


@query(f"""WITH {_GRADED}, own AS (SELECT person, season, race, CASE WHEN grade BETWEEN 1 AND 16 THEN grade END AS grade FROM e), s AS (SELECT DISTINCT person, season FROM own),
c AS (SELECT person, season, grade, count(*) AS n FROM own WHERE grade IS NOT NULL GROUP BY ALL), cr AS (SELECT *, row_number() OVER (PARTITION BY person, season ORDER BY n DESC, grade DESC) AS k, lead(n, 1, 0) OVER (PARTITION BY person, season ORDER BY n DESC, grade DESC) AS second FROM c),
a AS (SELECT person, season, grade AS agreed FROM cr WHERE k = 1 AND n >= 2 AND n > second), br AS (SELECT race, grade, count(*) AS n FROM own WHERE grade IS NOT NULL GROUP BY ALL), mn AS (SELECT race, person, season, grade, count(*) AS m FROM own WHERE grade IS NOT NULL GROUP BY ALL),
ot AS (SELECT w.person, w.season, br.grade, sum(br.n - coalesce(m, 0)) AS n FROM (SELECT DISTINCT race, person, season FROM own) w JOIN br USING (race) LEFT JOIN mn ON mn.race = w.race AND mn.person = w.person AND mn.season = w.season AND mn.grade = br.grade GROUP BY ALL HAVING sum(br.n - coalesce(m, 0)) > 0),
fr AS (SELECT *, row_number() OVER (PARTITION BY person, season ORDER BY n DESC, grade DESC) AS k, lead(n, 1, 0) OVER (PARTITION BY person, season ORDER BY n DESC, grade DESC) AS second, sum(n) OVER (PARTITION BY person, season) AS total FROM ot), f AS (SELECT person, season, grade AS fielded FROM fr WHERE k = 1 AND n >= 0.12 * total AND n > second),
p AS (SELECT DISTINCT person, season, 9 AS pinned FROM s WHERE person % 50 = 7 AND season = 1995), l AS (SELECT *, coalesce(pinned, agreed) - season AS o FROM s LEFT JOIN p USING (person, season) LEFT JOIN a USING (person, season) LEFT JOIN f USING (person, season)),
nb AS (SELECT *, last_value(o IGNORE NULLS) OVER (PARTITION BY person ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, first_value(o IGNORE NULLS) OVER (PARTITION BY person ORDER BY season ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM l),
g AS (SELECT person, season, pinned, agreed, CASE WHEN coalesce(b, n) = coalesce(n, b) AND coalesce(b, n) + season BETWEEN 1 AND 16 THEN coalesce(b, n) + season END AS near, fielded FROM nb),
r AS (SELECT person, season, coalesce(pinned, agreed, near, fielded) AS grade, CASE WHEN pinned IS NOT NULL THEN 'pinned' WHEN agreed IS NOT NULL THEN 'corroborated' WHEN near IS NOT NULL THEN 'neighbours' WHEN fielded IS NOT NULL THEN 'field' ELSE 'unknown' END AS method FROM g)
SELECT person, season, CAST(grade AS BIGINT) AS grade, method, method = 'pinned' OR coalesce(grade IS NOT NULL AND count(grade) OVER (PARTITION BY person) >= 2 AND 2 * (count(grade) OVER (PARTITION BY person, grade - season) - 1) > count(grade) OVER (PARTITION BY person) - 1, false) AS trusted FROM r""")
def resolved_grades(spark, sf):
    """Grades of every customer's year by ordered rules: pins, agreement, neighbouring years, the field."""
    o = table(spark, sf, "orders")
    y, k = F.year("o_orderdate").cast("long"), F.col("o_orderkey")
    grade = F.when(k % 5 < 2, F.lit(None)).when(k % 13 == 0, k % 20).otherwise(y - 1988 + F.col("o_custkey") % 4)
    rows = o.select(F.col("o_custkey").alias("person"), y.alias("season"), (k % 97).alias("race"), grade.alias("grade"))
    pins = rows.where("person % 50 = 7 AND season = 1995").select("person", "season", F.lit(9).cast("long").alias("grade")).distinct()
    return places.resolve_grades(rows, pins, 2, 0.12)


@query("WITH s AS (SELECT c_custkey AS id, c_mktsegment AS pool, c_nationkey AS grade, c_acctbal AS rating, 50.0 + c_custkey % 7 * 10 AS error, CAST(c_custkey * 37 % 100 AS DOUBLE) AS trend FROM customer), p AS (SELECT a.id AS a, b.id AS b, abs(a.rating - b.rating) AS gap, abs(a.trend - b.trend) AS turn FROM s a JOIN s b ON a.pool = b.pool AND a.grade = b.grade AND a.id <> b.id AND abs(a.rating - b.rating) <= a.error AND abs(a.trend - b.trend) <= 30) SELECT a, b, round(gap, 4) AS gap, turn FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY gap, b) <= 3")
def comps_trajectory(spark, sf):
    """The three nearest seasons within the error radius whose trend is alike as well."""
    c = table(spark, sf, "customer")
    s = c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("pool"), F.col("c_nationkey").alias("grade"), F.col("c_acctbal").alias("rating"), (50.0 + F.col("c_custkey") % 7 * 10).alias("error"))
    trend = c.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 37 % 100).cast("double").alias("trend"))
    near = joins.within_radius(s, ["pool", "grade"], "id", "rating", "error", 110.0)
    return joins.alike_trends(near, trend, "id", "trend", 30.0, 3).withColumn("gap", F.round("gap", 4))
