"""Records, floors, conversions, qualifying marks, parsing of events and grades."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import curves, events, text
from ..operators import results as res, scoring
from .base import L, R, query, races, results, table

#: part sizes as distances, orders as results over them
_D = "d AS (SELECT l_orderkey * 10 + l_linenumber AS id, o_custkey AS person, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS dayno, CAST(p_size * 100 AS DOUBLE) AS distance, l_extendedprice AS seconds FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"


def distances(spark, sf):
    li, o, p = (table(spark, sf, t) for t in ("lineitem", "orders", "part"))
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("o_custkey").alias("person"), F.datediff(F.to_date("l_shipdate"), F.lit("1992-01-01")).cast("long").alias("dayno"),
        (F.col("p_size") * 100).cast("double").alias("distance"), F.col("l_extendedprice").alias("seconds"),
    )


_STD = [1000.0, 1600.0, 3200.0, 5000.0]
_STDS = "(VALUES (1000.0), (1600.0), (3200.0), (5000.0)) v(std)"


@query(f"""WITH {_D}, b AS (SELECT d.*, CAST(std AS DOUBLE) AS std FROM d JOIN {_STDS} ON distance BETWEEN std * 0.94 AND std * 1.06), h AS (SELECT *, min(seconds) OVER w AS previous, count(seconds) OVER w AS n_before FROM b WINDOW w AS (PARTITION BY person, std ORDER BY dayno RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT id, std, previous, n_before, previous IS NOT NULL AND seconds < previous AS pr FROM h""")
def previous_best_in_band(spark, sf):
    std = spark.createDataFrame([(s,) for s in _STD], "std double")
    return res.band_records(distances(spark, sf), std, "person", "dayno", "distance", "seconds", 0.06).select("id", "std", "previous", "n_before", "pr")


@query(f"""WITH {_D}, s AS (SELECT *, CAST(dayno // 365 AS BIGINT) AS season FROM d), h AS (SELECT *, min(seconds) OVER (PARTITION BY person, distance, season ORDER BY dayno, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s, min(seconds) OVER (PARTITION BY person, distance ORDER BY dayno, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM s)
SELECT id, s IS NULL OR seconds < s AS season_best, p IS NULL OR seconds < p AS personal_best FROM h""")
def season_best_flags(spark, sf):
    """The tables repeat some ids; rows that day and id leave tied go by their time, so that every run gives the same flags. The SQL leaves them open."""
    d = distances(spark, sf).withColumn("season", F.floor(F.col("dayno") / 365))
    return res.season_bests(d, ["person", "distance"], "season", "seconds", ["dayno", "id", "seconds"]).select("id", "season_best", "personal_best")


@query(f"WITH {L}, s AS (SELECT person, CAST(year(day) AS BIGINT) AS season, count(*) AS n FROM l GROUP BY ALL) SELECT * FROM s WHERE n >= 3 OR season >= 1997")
def season_floor(spark, sf):
    s = races(spark, sf).groupBy("person", F.year("day").cast("long").alias("season")).agg(F.count("*").alias("n"))
    return s.where(res.race_floor(F.col("n"), F.col("season"), 1997))


@query("SELECT o_orderkey FROM orders WHERE (o_orderkey % 8) & 5 <> 0 AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F')")
def unit_and_level_filter(spark, sf):
    meets = table(spark, sf, "orders").select(F.col("o_orderkey").alias("meet"), (F.col("o_orderkey") % 8).alias("mask"))
    li = table(spark, sf, "lineitem")
    units = li.select(F.col("l_orderkey").alias("meet"), F.lit("flag").alias("kind"), F.col("l_returnflag").alias("unit")).unionByName(li.select(F.col("l_orderkey").alias("meet"), F.lit("status").alias("kind"), F.col("l_linestatus").alias("unit")))
    return res.with_levels(res.with_units(meets, units, "meet", {"flag": "R", "status": "F"}), "mask", 5).select(F.col("meet").alias("o_orderkey"))


@query("WITH c AS (SELECT n_nationkey AS c_nationkey, 5000.0 + 100 * n_regionkey AS ceiling FROM nation WHERE n_nationkey % 5 <> 0) SELECT c_nationkey, count(*) AS n, count(*) FILTER (WHERE coalesce(c_acctbal > ceiling, false)) AS above FROM customer LEFT JOIN c USING (c_nationkey) GROUP BY c_nationkey")
def pool_ceiling(spark, sf):
    ceilings = table(spark, sf, "nation").where("n_nationkey % 5 <> 0").select(F.col("n_nationkey").alias("c_nationkey"), (5000.0 + 100 * F.col("n_regionkey")).alias("ceiling"))
    marked = res.ceiling_census(table(spark, sf, "customer"), ceilings, "c_nationkey", "c_acctbal")
    return marked.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count_if("above").alias("above"))


@query(f"""WITH {_D} SELECT CASE WHEN distance BETWEEN 940 AND 1060 THEN 1000.0 WHEN distance BETWEEN 1504 AND 1696 THEN 1600.0 WHEN distance BETWEEN 3008 AND 3392 THEN 3200.0 WHEN distance BETWEEN 4700 AND 5300 THEN 5000.0 END AS std, count(*) AS n FROM d GROUP BY std""")
def standard_distance(spark, sf):
    return distances(spark, sf).groupBy(events.standard_of(F.col("distance"), _STD, 0.06).alias("std")).agg(F.count("*").alias("n"))


_GATES = "CASE WHEN seconds IS NULL OR seconds >= 95000 THEN 'sentinel' WHEN distance < 500 THEN 'distance' WHEN seconds / distance < 5 THEN 'too fast' WHEN seconds / distance > 80 THEN 'too slow' ELSE 'kept' END"


@query(f"WITH {_D} SELECT {_GATES} AS reason, count(*) AS n FROM d GROUP BY reason")
def sanity_gates(spark, sf):
    from ..operators import dataquality as dq

    pace = F.try_divide(F.col("seconds"), F.col("distance"))
    gates = [("sentinel", F.col("seconds").isNull() | (F.col("seconds") >= 95000)), ("distance", F.col("distance") < 500), ("too fast", pace < 5), ("too slow", pace > 80)]
    return dq.census(distances(spark, sf), gates)


_TITLES = """t AS (SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN 'Boys ' || p_size || '00m Finals' WHEN 1 THEN p_size || 'K Heat 2' WHEN 2 THEN 'Girls ' || p_size || ' Mile Semi-Final' WHEN 3 THEN '4x' || p_size || '00m Relay' WHEN 4 THEN 'Long Jump' WHEN 5 THEN 'Seated 1,' || lpad(CAST(p_size AS VARCHAR), 3, '0') || ' Meters Prelims' WHEN 6 THEN p_size || ' yd State Championship' ELSE 'Open' END AS title FROM part)"""


def _titles(spark, sf):
    n, s = F.col("p_partkey") % 8, F.col("p_size").cast("string")
    c = F.when(n == 0, F.concat(F.lit("Boys "), s, F.lit("00m Finals"))).when(n == 1, F.concat(s, F.lit("K Heat 2"))).when(n == 2, F.concat(F.lit("Girls "), s, F.lit(" Mile Semi-Final"))).when(n == 3, F.concat(F.lit("4x"), s, F.lit("00m Relay")))
    c = c.when(n == 4, "Long Jump").when(n == 5, F.concat(F.lit("Seated 1,"), F.lpad(s, 3, "0"), F.lit(" Meters Prelims"))).when(n == 6, F.concat(s, F.lit(" yd State Championship"))).otherwise("Open")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), c.alias("title"))


@query(f"""WITH {_TITLES}, p AS (SELECT *, regexp_extract(lower(title), '([0-9]+(?:[.,][0-9]+)?)\\s*(miles|mile|mi|meters|km|k|m|yards|yd|y)\\b', ['n', 'u']) AS g FROM t),
m AS (SELECT *, TRY_CAST(replace(g.n, ',', '') AS DOUBLE) * CASE g.u WHEN 'm' THEN 1 WHEN 'meters' THEN 1 WHEN 'k' THEN 1000 WHEN 'km' THEN 1000 WHEN 'mi' THEN 1609.344 WHEN 'mile' THEN 1609.344 WHEN 'yd' THEN 0.9144 END AS metres FROM p)
SELECT id, round(CASE WHEN NOT regexp_matches(lower(title), 'relay|\\dx|hurdle|steeple|jump|vault|throw') AND metres BETWEEN 0 AND 100000 THEN metres END, 4) AS metres FROM m""")
def event_metres(spark, sf):
    return _titles(spark, sf).select("id", F.round(events.metres_of(F.col("title")), 4).alias("metres"))


@query(f"""WITH {_TITLES} SELECT id, CASE WHEN regexp_matches(lower(title), 'semi') THEN 'semi' WHEN regexp_matches(lower(title), 'prelim|heat') THEN 'prelim' WHEN regexp_matches(lower(title), 'final') THEN 'final' END AS round, regexp_matches(title, '(?i)wheelchair|seated|ambulator') AS chair,
CASE WHEN regexp_matches(lower(title), 'champ|state|nation|region|section') THEN 'champs' WHEN regexp_matches(lower(title), '\\binv') THEN 'invitational' ELSE 'other' END AS kind FROM t""")
def event_classes(spark, sf):
    t = F.col("title")
    return _titles(spark, sf).select("id", events.round_of(t).alias("round"), events.chair_class(t).alias("chair"), events.meet_class(t).alias("kind"))


@query(f"WITH {_TITLES} SELECT count(*) AS n FROM t WHERE NOT regexp_matches(title, '(?i)wheelchair|seated|ambulator')")
def chair_filter(spark, sf):
    return _titles(spark, sf).where(~events.chair_class(F.col("title"))).agg(F.count("*").alias("n"))


_GRADES = ["9", "10th", "012", "FR-1", "Freshman", "sr.", "7t", "2024", "13-14", " ", "JR", "11"]
_G = "g AS (SELECT c_custkey AS id, (['9', '10th', '012', 'FR-1', 'Freshman', 'sr.', '7t', '2024', '13-14', ' ', 'JR', '11'])[CAST(c_custkey % 12 AS INTEGER) + 1] AS grade, (['M', 'f', 'X'])[CAST(c_custkey % 3 AS INTEGER) + 1] AS gender FROM customer), n AS (SELECT *, CASE lower(rtrim(split_part(trim(grade), '-', 1), '. ')) WHEN 'fr' THEN 'FR' WHEN 'freshman' THEN 'FR' WHEN 'sr' THEN 'SR' WHEN 'jr' THEN 'JR' ELSE coalesce(CASE WHEN ltrim(lower(trim(grade)), '0123456789') IN ('', '.', 'st', 'nd', 'rd', 'th', 't', 'st.', 'nd.', 'rd.', 'th.', 't.') AND num < 100 THEN CAST(num AS VARCHAR) END, trim(grade)) END AS norm FROM (SELECT *, TRY_CAST(substr(trim(grade), 1, length(trim(grade)) - length(ltrim(lower(trim(grade)), '0123456789'))) AS INTEGER) AS num FROM g)), v AS (SELECT *, CASE WHEN norm IN ('FR', 'SO', 'JR', 'SR', 'RS') THEN 'college' WHEN TRY_CAST(norm AS INTEGER) BETWEEN 6 AND 8 THEN 'ms' WHEN TRY_CAST(norm AS INTEGER) BETWEEN 9 AND 12 THEN 'hs' END AS level FROM n)"


def _grades(spark, sf):
    k = F.col("c_custkey")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (k % len(xs)).cast("int") + 1)
    return table(spark, sf, "customer").select(k.alias("id"), pick(_GRADES).alias("grade"), pick(["M", "f", "X"]).alias("gender"), "c_nationkey")


@query(f"WITH {_G} SELECT id, norm, CASE WHEN level IS NULL THEN 'unknown_level' ELSE level || '_' || CASE upper(gender) WHEN 'M' THEN 'm' WHEN 'F' THEN 'f' ELSE 'unknown_gender' END END AS pool FROM v")
def grade_pools(spark, sf):
    return _grades(spark, sf).select("id", events.norm_grade(F.col("grade")).alias("norm"), events.pool_of(F.col("grade"), F.col("gender")).alias("pool"))


@query(f"WITH {_G}, s AS (SELECT v.*, (['hs', NULL, 'college'])[CAST(c_nationkey % 3 AS INTEGER) + 1] AS season FROM v JOIN customer ON id = c_custkey) SELECT id, CASE WHEN level IS NULL THEN season WHEN season IS NULL OR level = season THEN level WHEN level = 'college' AND season = 'hs' THEN level ELSE season END AS level FROM s")
def settled_levels(spark, sf):
    season = F.element_at(F.array(F.lit("hs"), F.lit(None).cast("string"), F.lit("college")), (F.col("c_nationkey") % 3).cast("int") + 1)
    return _grades(spark, sf).select("id", events.settle_level(events.level_of(F.col("grade")), season).alias("level"))


@query(f"WITH {_G} SELECT id, trim(regexp_replace(lower(grade), '[^a-z0-9]+', ' ', 'g')) AS name, CASE lower(trim(grade)) WHEN 'freshman' THEN 'FR' WHEN 'jr' THEN 'JR' END AS class, TRY_CAST(split_part(grade, '-', 2) AS INTEGER) AS band, regexp_matches(trim(grade), '^(19|20)[0-9]{{2}}$') AS year FROM g")
def sql_functions(spark, sf):
    """The grade rules as SQL functions."""
    events.register(spark)
    return spark.sql("SELECT id, norm_name(grade) AS name, class_grade(grade) AS class, band_grade(grade) AS band, is_grad_year(grade) AS year FROM {g}", g=_grades(spark, sf))


@query("SELECT c_custkey AS id, split_part(c_name, '#', 2) AS part, substr(c_name, 1, 4) AS head, c_mktsegment ILIKE '%build%' AS likes, list_aggregate(list_sort(list_filter(string_split(trim(regexp_replace(lower(c_mktsegment || ' Jr ' || c_name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w NOT IN ('', 'jr', 'sr', 'ii', 'iii', 'iv'))), 'string_agg', ' ') AS person FROM customer")
def text_parts(spark, sf):
    c = F.col("c_name")
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.split_part(c, F.lit("#"), F.lit(2)).alias("part"), F.substring(c, 1, 4).alias("head"), F.col("c_mktsegment").ilike("%build%").alias("likes"), text.person_key(F.concat_ws(" Jr ", "c_mktsegment", "c_name")).alias("person"),
    )


@query("""WITH w AS (SELECT p_partkey, list_filter(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '') AS x, list_filter(string_split(trim(regexp_replace(lower(p_type || ' ' || p_name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '') AS y FROM part)
SELECT p_partkey, CAST(len(list_filter(x, lambda a: len(list_filter(y, lambda b: levenshtein(a, b) <= 1)) > 0)) AS DOUBLE) / len(x) AS share FROM w""")
def word_similarity(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.similarity(F.col("p_name"), F.concat_ws(" ", "p_type", "p_name")).alias("share"))


@query("SELECT c_custkey, sha256(c_name || chr(31) || CAST(c_nationkey AS VARCHAR)) AS content, md5(c_name) AS digest FROM customer")
def content_ids(spark, sf):
    from ..sources import files

    return table(spark, sf, "customer").select("c_custkey", files.content_id("c_name", "c_nationkey").alias("content"), F.md5("c_name").alias("digest"))


@query("""WITH w AS (SELECT c_custkey, c_acctbal / 500 AS t, CAST(c_custkey % 100 AS DOUBLE) AS rh, CAST(c_nationkey AS DOUBLE) AS wind, CAST(c_custkey % 800 AS DOUBLE) AS sun FROM customer)
SELECT c_custkey, round(t + 0.348 * (rh / 100 * 6.105 * exp(17.27 * t / (237.7 + t))) - 0.70 * wind / 3.6 + 0.70 * (0.1 * sun) / (wind / 3.6 + 10) - 4.25, 6) AS felt FROM w""")
def apparent_temperature(spark, sf):
    k = F.col("c_custkey")
    felt = curves.apparent_temperature(F.col("c_acctbal") / 500, (k % 100).cast("double"), F.col("c_nationkey").cast("double"), (k % 800).cast("double"))
    return table(spark, sf, "customer").select("c_custkey", F.round(felt, 6).alias("felt"))


_KNOTS = [(0.0, 0.0), (2.0, 0.3), (3.0, 0.7), (4.0, 1.5)]
_W = [(0.0, 0.0), (15.0, 0.0), (30.0, 0.06)]


@query("""WITH p AS (SELECT p_partkey, p_retailprice AS t, ln(CAST(p_size AS DOUBLE)) AS x, ln(10.0) AS y, CASE WHEN p_partkey % 4 = 0 THEN 200.0 WHEN p_partkey % 4 = 1 THEN 300.0 END AS len, p_partkey % 8 = 0 AS banked, CAST(2000 + p_partkey % 4 AS INTEGER) AS season, CASE WHEN p_partkey % 9 = 0 THEN 99.0 ELSE CAST(p_partkey % 45 AS DOUBLE) END AS temp FROM part),
g AS (SELECT *, CASE WHEN x < 2 THEN 0.15 * x WHEN x < 3 THEN 0.3 + (x - 2) * 0.4 ELSE 0.7 + (x - 3) * 0.8 END AS gx, CASE WHEN y < 2 THEN 0.15 * y WHEN y < 3 THEN 0.3 + (y - 2) * 0.4 ELSE 0.7 + (y - 3) * 0.8 END AS gy, 400.0 / coalesce(len, 400.0) - 1 AS laps FROM p)
SELECT p_partkey, round(t * exp(gy - gx) * exp(-0.01 * laps) * CASE WHEN banked THEN 1 + 0.008 * laps ELSE 1 END * exp(-CASE season WHEN 2001 THEN -0.01 WHEN 2002 THEN 0.02 ELSE 0 END) * CASE WHEN temp BETWEEN -30 AND 50 THEN exp(-CASE WHEN temp < 15 THEN 0 ELSE (temp - 15) * 0.004 END) ELSE 1 END, 6) AS normal FROM g""")
def normalised_fully(spark, sf):
    """Distance, geometry, era and weather factors of one time."""
    k, d = F.col("p_partkey"), F.col("p_size").cast("double")
    length = F.when(k % 4 == 0, 200.0).when(k % 4 == 1, 300.0)
    temp = F.when(k % 9 == 0, 99.0).otherwise((k % 45).cast("double"))
    t = curves.transfer(F.col("p_retailprice"), d, 10.0, _KNOTS) * curves.length_factor(length, k % 8 == 0, 0.01, 0.008) * curves.era_factor((2000 + k % 4).cast("int"), {2001: -0.01, 2002: 0.02}) * curves.weather_factor(temp, 10.0, _W)
    return table(spark, sf, "part").select("p_partkey", F.round(t, 6).alias("normal"))


@query("""WITH p AS (SELECT p_partkey, ln(p_retailprice) AS lt, ln(CAST(p_size AS DOUBLE) * 100) AS ld, ln(5000.0) AS lr FROM part)
SELECT p_partkey, round(lt + (lr - ld) * (1.08 - 0.01 * (lt - ld)), 8) AS at_ref, round(lt, 8) AS back FROM p""")
def ability_curve(spark, sf):
    import math

    lt, ld, lr = F.log("p_retailprice"), F.log(F.col("p_size").cast("double") * 100), math.log(5000.0)
    there = curves.ability_log(lt, ld, lr, 1.08, -0.01)
    return table(spark, sf, "part").select("p_partkey", F.round(there, 8).alias("at_ref"), F.round(curves.ability_log_inverse(there, ld, lr, 1.08, -0.01), 8).alias("back"))


_POWER = "exp(CASE WHEN ln(x) < ln(100.0) THEN ln(60.0) + (ln(x) - ln(50.0)) * (ln(110.0) - ln(60.0)) / (ln(100.0) - ln(50.0)) ELSE ln(110.0) + (ln(x) - ln(100.0)) * (ln(150.0) - ln(110.0)) / (ln(140.0) - ln(100.0)) END)"


@query(f"WITH r AS (SELECT p_partkey, p_retailprice / 10 AS x FROM part) SELECT p_partkey, round({_POWER}, 6) AS hs FROM r WHERE x > 0")
def pool_scale_map(spark, sf):
    hs = curves.power_map(F.col("p_retailprice") / 10, [(50.0, 60.0), (100.0, 110.0), (140.0, 150.0)])
    return table(spark, sf, "part").where("p_retailprice > 0").select("p_partkey", F.round(hs, 6).alias("hs"))


@query("""WITH p AS (SELECT p_partkey, p_retailprice AS t, CAST(p_size AS DOUBLE) AS d FROM part), n AS (SELECT *, t * (10.0 / d) ** 1.06 / 1.03 AS norm FROM p)
SELECT p_partkey, round(100 * 1000.0 / norm, 6) AS rating, round(norm * 0.98 / (10.0 / 5.0) ** 1.06, 6) AS there FROM n""")
def convert_contexts(spark, sf):
    """A time on one course and distance as a rating, and as a time on another course and distance."""
    norm = curves.riegel(F.col("p_retailprice"), F.col("p_size").cast("double"), 10.0) / 1.03
    return table(spark, sf, "part").select("p_partkey", F.round(F.try_divide(F.lit(100 * 1000.0), norm), 6).alias("rating"), F.round(norm * 0.98 / (10.0 / 5.0) ** 1.06, 6).alias("there"))


@query(f"""WITH {L}, p AS (SELECT cell, CAST(year(day) AS BIGINT) AS season, mark, row_number() OVER (PARTITION BY cell, year(day) ORDER BY mark, id) AS place FROM l), c AS (SELECT cell, season, max(mark) AS v, count(*) AS n FROM p WHERE place <= 5 GROUP BY ALL HAVING count(*) >= 5)
SELECT cell, round(quantile_cont(v, 0.5), 4) AS mark, round(quantile_cont(v, 0.25), 4) AS low, round(quantile_cont(v, 0.75), 4) AS high, round(regr_slope(v, season), 4) AS trend, count(*) AS seasons, count(*) < 3 AS thin FROM c GROUP BY cell""")
def qualifying_marks(spark, sf):
    from ..operators.ranks import ranked_within

    p = ranked_within(races(spark, sf).withColumn("season", F.year("day").cast("long")), ["cell", "season"], [F.col("mark"), F.col("id")], "place")
    got = res.marks_to_qualify(p, ["cell"], "season", "place", "mark", 5)
    return got.select("cell", *[F.round(c, 4).alias(c) for c in ("mark", "low", "high", "trend")], "seasons", "thin")


_SEASONS = f"WITH {L}, s AS (SELECT person, CAST(year(day) AS BIGINT) AS season, avg(mark) AS rating, min(team) AS school, CASE WHEN year(day) < 1998 THEN 'hs' ELSE 'college' END AS level FROM l GROUP BY ALL)"


def _seasons(spark, sf):
    s = races(spark, sf).groupBy("person", F.year("day").cast("long").alias("season")).agg(F.avg("mark").alias("rating"), F.min("team").alias("school"))
    return s.withColumn("level", F.when(F.col("season") < 1998, "hs").otherwise("college"))


@query(_SEASONS + ", h AS (SELECT person, min(season) AS hs FROM s WHERE level = 'college' GROUP BY person), l2 AS (SELECT s.person, max(season) AS ls, min(hs) AS hs FROM s JOIN h USING (person) WHERE level = 'hs' AND season < hs GROUP BY s.person) SELECT l2.person, ls AS from_season, hs AS to_season, round(b.rating - a.rating, 6) AS change FROM l2 JOIN s a ON a.person = l2.person AND a.season = ls JOIN s b ON b.person = l2.person AND b.season = hs")
def recruiting_change(spark, sf):
    return res.first_after_last(_seasons(spark, sf), "person", "season", "level", "rating", "hs", "college").withColumn("change", F.round("change", 6))


@query(_SEASONS + " SELECT * FROM (SELECT person, season, school, lag(school) OVER (PARTITION BY person ORDER BY season) AS from_school FROM s) WHERE from_school <> school")
def school_transfers(spark, sf):
    return res.transfers(_seasons(spark, sf), "person", "season", "school").select("person", "season", "school", "from_school")


@query(f"WITH {L}, m AS (SELECT person, avg(mark) AS a FROM l GROUP BY person), c AS (SELECT cell, round(quantile_cont(mark - a, 0.5), 6) AS median_gap, count(*) AS n FROM l JOIN m USING (person) GROUP BY cell HAVING count(*) >= 5) SELECT *, row_number() OVER (ORDER BY median_gap DESC, cell) AS rank FROM c")
def course_rank(spark, sf):
    r = races(spark, sf)
    gap = r.join(r.groupBy("person").agg(F.avg("mark").alias("a")), "person").withColumn("gap", F.col("mark") - F.col("a"))
    return res.course_ranks(gap, "cell", "gap", 5).withColumn("median_gap", F.round("median_gap", 6))


@query(f"WITH {_D}, b AS (SELECT person, distance, min(seconds) AS t FROM d GROUP BY ALL) SELECT person, round(regr_slope(distance, t), 8) AS speed, round(regr_intercept(distance, t), 4) AS reserve, count(*) AS n FROM b GROUP BY person HAVING count(*) >= 3 AND regr_slope(distance, t) IS NOT NULL")
def critical_speed(spark, sf):
    got = res.critical_speed(distances(spark, sf), "person", "distance", "seconds", 3)
    return got.select("person", F.round("speed", 8).alias("speed"), F.round("reserve", 4).alias("reserve"), "n")


_ZONES = [("easy", 0.7), ("threshold", 0.93), ("interval", 1.05)]


@query(f"WITH {_D}, b AS (SELECT person, distance, min(seconds) AS t FROM d GROUP BY ALL), s AS (SELECT person, regr_slope(distance, t) AS speed FROM b GROUP BY person HAVING count(*) >= 3 AND regr_slope(distance, t) > 0) SELECT person, zone, round(ln(1000 / (speed * share)), 6) AS log_pace FROM s, (VALUES ('easy', 0.7), ('threshold', 0.93), ('interval', 1.05)) z(zone, share)")
def training_paces(spark, sf):
    got = res.critical_speed(distances(spark, sf), "person", "distance", "seconds", 3)
    return res.training_paces(got, "speed", _ZONES).select("person", "zone", F.round(F.log("pace"), 6).alias("log_pace"))


@query(f"WITH {R}, p AS (SELECT a.id, a.mark, quantile_cont(b.mark, 0.8) AS level, count(*) AS n_before FROM r a JOIN r b ON a.person = b.person AND b.dayno < a.dayno AND b.dayno >= a.dayno - 7 GROUP BY a.id, a.mark HAVING count(*) >= 3) SELECT id, round(level, 6) AS level, n_before FROM p WHERE mark > level")
def above_level(spark, sf):
    return res.above_level(results(spark, sf), "person", "dayno", "mark", 7, 0.8, 3).select("id", F.round("level", 6).alias("level"), "n_before")


_MATRIX = f"WITH {L}, d AS (SELECT race, team, min(mark) AS s FROM l GROUP BY ALL), m AS (SELECT a.team, b.team AS opponent, count(*) FILTER (WHERE a.s < b.s) AS wins, count(*) AS meetings FROM d a JOIN d b ON a.race = b.race AND a.team <> b.team GROUP BY ALL)"


@query(_MATRIX + ", s AS (SELECT team, opponent, wins / meetings AS s FROM m) SELECT a.team, b.team AS opponent, count(*) FILTER (WHERE a.s > b.s) AS better, count(*) FILTER (WHERE a.s < b.s) AS worse FROM s a JOIN s b ON a.opponent = b.opponent AND a.team <> b.team WHERE a.opponent <> a.team AND a.opponent <> b.team AND b.opponent <> a.team GROUP BY ALL")
def common_opponents(spark, sf):
    best = races(spark, sf).groupBy("race", "team").agg(F.min("mark").alias("s"))
    return res.common_opponents(scoring.win_matrix(best, "race", "team", "s"))


@query()
def lineup_choice(spark, sf):
    """Greedy entries per team; the test has the rule on a small team."""
    o = races(spark, sf).groupBy("team", "person", (F.col("cell") % 6).alias("event")).agg(F.round(F.max("mark"), 4).alias("points"))
    return res.best_lineups(o, "team", "person", "event", "points", 2, 3, events=6)


@query(f"WITH {R} SELECT id, round(ln(1 + mark) * 10, 6) AS shown FROM r WHERE mark >= 0 ORDER BY shown DESC NULLS LAST, id LIMIT 25")
def order_by_shown(spark, sf):
    """Ordered by the converted value that a reader sees."""
    shown = results(spark, sf).where("mark >= 0").select("id", F.round(F.log1p("mark") * 10, 6).alias("shown"))
    return shown.orderBy(F.col("shown").desc_nulls_last(), "id").limit(25)
