"""Join forms."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import joins, ranks
from .base import L, R, query, races, results, table


@query(f"""WITH {R}, w AS (SELECT *, count(mark) OVER n - count(mark) OVER o AS n_other, sum(mark) OVER n - sum(mark) OVER o AS s FROM r
WINDOW n AS (PARTITION BY person ORDER BY dayno RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING), o AS (PARTITION BY person, cell ORDER BY dayno RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING))
SELECT id, n_other, round(CASE WHEN n_other > 0 THEN mark - s / n_other END, 9) AS bracket FROM w""")
def interval_bracket(spark, sf):
    got = joins.interval_bracket(results(spark, sf), ["person"], "cell", "dayno", "mark", 5)
    return got.select("id", "n_other", F.round("bracket", 9).alias("bracket"))


@query(f"""WITH {R}, o AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY dayno, id) AS pos FROM r),
p AS (SELECT a.id, b.mark, row_number() OVER (PARTITION BY a.id ORDER BY abs(b.dayno - a.dayno), b.dayno, b.id) AS k FROM o a JOIN o b ON a.person = b.person AND a.id <> b.id AND abs(a.pos - b.pos) <= 4)
SELECT id, count(*) AS n, round(sum(mark), 4) AS total FROM p WHERE k <= 4 GROUP BY id""")
def knn_by_date(spark, sf):
    r = results(spark, sf)
    near = joins.nearest_by_day(r, "person", "dayno", "id", "mark", 4)
    return near.where(F.size("near") > 0).select("id", F.size("near").cast("long").alias("n"), F.round(F.aggregate("near", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("""SELECT l.o_orderkey, (SELECT max(CAST(floor(epoch(e.ts)) AS BIGINT)) FROM events e WHERE e.user_id = l.o_custkey % 150 AND e.ts <= TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (l.o_orderkey % 720)) AS last_event FROM orders l""")
def asof_join(spark, sf):
    at = F.lit("2024-01-01").cast("timestamp_ntz") + F.expr("make_dt_interval(0, CAST(o_orderkey % 720 AS INT))")
    left = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 150).alias("user_id"), at.alias("ts"))
    right = table(spark, sf, "events").select("user_id", "ts", F.unix_seconds(F.col("ts").cast("timestamp")).alias("seconds"))
    return joins.as_of(left, right, ["user_id"], "ts", "seconds", "last_event").select("o_orderkey", "last_event")


@query("""WITH b AS (SELECT r_name AS label, r_regionkey * 2000.0 AS low, r_regionkey * 2000.0 + 2500.0 AS high FROM region) SELECT label, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer JOIN b ON c_acctbal BETWEEN low AND high GROUP BY label""")
def range_band_join(spark, sf):
    bands = table(spark, sf, "region").select(F.col("r_name").alias("label"), (F.col("r_regionkey") * 2000.0).alias("low"), (F.col("r_regionkey") * 2000.0 + 2500.0).alias("high"))
    return joins.band_join(table(spark, sf, "customer"), bands, "c_acctbal").groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("""WITH p AS (SELECT s_suppkey AS k, CAST((s_suppkey * 7919) % 1000 AS DOUBLE) AS x, CAST((s_suppkey * 104729) % 1000 AS DOUBLE) AS y FROM supplier)
SELECT a.k AS a, b.k AS b, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 4) AS distance FROM p a JOIN p b ON a.k < b.k AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 50""")
def grid_join(spark, sf):
    p = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), ((F.col("s_suppkey") * 7919) % 1000).cast("double").alias("x"), ((F.col("s_suppkey") * 104729) % 1000).cast("double").alias("y"))
    return joins.grid_pairs(p, "k", "x", "y", 50.0, 50.0).select("a", "b", F.round("distance", 4).alias("distance"))


@query(f"""WITH {R}, p AS (SELECT a.person, a.cell AS c1, b.cell AS c2, a.id AS o1, b.id AS o2, b.dayno - a.dayno AS gap, b.mark / nullif(a.mark, 0) AS ratio,
row_number() OVER (PARTITION BY a.person, a.cell, b.cell ORDER BY b.dayno - a.dayno, a.id, b.id) AS k FROM r a JOIN r b ON a.person = b.person AND a.id <> b.id AND a.cell <> b.cell AND b.dayno - a.dayno BETWEEN 0 AND 21)
SELECT person, c1, c2, o1, o2, gap, round(ratio, 6) AS ratio FROM p WHERE k = 1""")
def closest_pair_21d(spark, sf):
    got = joins.closest_pairs(results(spark, sf), "person", "id", "dayno", "cell", "mark", 21)
    return got.withColumn("ratio", F.round("ratio", 6))


@query(f"""WITH {R}, a AS (SELECT person, row_number() OVER (ORDER BY max(mark) DESC, person) AS old_rank FROM r WHERE dayno < 15 GROUP BY person), b AS (SELECT person, row_number() OVER (ORDER BY max(mark) DESC, person) AS new_rank FROM r WHERE dayno < 25 GROUP BY person)
SELECT person, old_rank, new_rank, CASE WHEN old_rank IS NULL THEN 'new' WHEN new_rank IS NULL THEN 'gone' WHEN new_rank < old_rank THEN 'up' WHEN new_rank > old_rank THEN 'down' ELSE 'same' END AS change FROM a FULL JOIN b USING (person)""")
def full_outer_diff(spark, sf):
    r = results(spark, sf)
    best = lambda until: r.where(F.col("dayno") < until).groupBy("person").agg(F.max("mark").alias("m"))
    old, new = (ranks.numbered(best(until), [F.desc("m"), F.col("person")], "rank") for until in (15, 25))
    return joins.snapshot_diff(old, new, "person", "rank")


@query("SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 45) AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')")
def semi_anti_flags(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    on = F.col("o_orderkey") == F.col("l_orderkey")
    return o.join(li.where("l_quantity > 45"), on, "left_semi").join(li.where("l_returnflag = 'R'"), on, "left_anti").select("o_orderkey")


@query("""SELECT a.p_partkey AS a, min(b.p_partkey) AS b FROM part a JOIN part b ON a.p_brand IS NOT DISTINCT FROM b.p_brand AND a.p_type IS NOT DISTINCT FROM b.p_type AND nullif(a.p_size, 1) IS NOT DISTINCT FROM nullif(b.p_size, 1) AND b.p_partkey < a.p_partkey GROUP BY a.p_partkey""")
def nullsafe_dup(spark, sf):
    p = table(spark, sf, "part").withColumn("size", F.nullif(F.col("p_size"), F.lit(1)))
    first = p.groupBy("p_brand", "p_type", "size").agg(F.min("p_partkey").alias("b"))  # groupBy takes nulls as equal
    same = p["p_brand"].eqNullSafe(first["p_brand"]) & p["p_type"].eqNullSafe(first["p_type"]) & p["size"].eqNullSafe(first["size"])
    return p.join(first, same).where("b < p_partkey").select(F.col("p_partkey").alias("a"), "b")


@query(f"""WITH {L}, s AS (SELECT person, CAST(year(day) AS BIGINT) AS season, max(mark) AS best FROM l GROUP BY ALL) SELECT a.person, a.season, a.best, b.best AS later FROM s a LEFT JOIN s b ON a.person = b.person AND b.season = a.season + 1""")
def season_offset_self_join(spark, sf):
    s = races(spark, sf).groupBy("person", F.year("day").cast("long").alias("season")).agg(F.max("mark").alias("best"))
    return joins.season_offset(s, "person", "season", "best").select("person", "season", "best", "later")


@query(f"WITH {L} SELECT * FROM (SELECT cell, id, mark, row_number() OVER (PARTITION BY cell ORDER BY mark DESC, id) AS k FROM l) WHERE k <= 3")
def topk_per_key(spark, sf):
    return joins.top_k_per_key(races(spark, sf), ["cell"], [F.desc("mark"), F.col("id")], 3).select("cell", "id", "mark", "k")


@query(f"""WITH {L}, m AS (SELECT race, team, row_number() OVER (PARTITION BY race ORDER BY max(mark) DESC, team) AS place FROM l GROUP BY race, team)
SELECT a.race, a.place AS place_a, b.place AS place_b, CASE WHEN a.place < b.place THEN 'a' WHEN a.place > b.place THEN 'b' ELSE 'tie' END AS ahead FROM m a JOIN m b ON a.race = b.race AND a.team = 3 AND b.team = 7""")
def head_to_head(spark, sf):
    best = races(spark, sf).groupBy("race", "team").agg(F.max("mark").alias("m"))
    placed = best.withColumn("place", F.row_number().over(Window.partitionBy("race").orderBy(F.desc("m"), "team")).cast("long"))
    return joins.head_to_head(placed, 3, 7, "race", "team", "place")


@query("""SELECT o_orderkey, n_name, r_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY ALL""")
def star_join(spark, sf):
    t = lambda n: table(spark, sf, n)
    joined = t("lineitem").where(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return joined.groupBy("o_orderkey", "n_name", "r_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings), p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_sum(list_transform(range(1, 65), lambda i: (a.e[i] - b.e[i]) ** 2)) AS d FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.label = b.label AND a.vec_id <> b.vec_id)
SELECT a, b, k FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY d, b) AS k FROM p) WHERE k <= 3""")
def comps_knn(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"), "label")
    a, b = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("a"), F.col("e").alias("x"), "label"), v.select(F.col("vec_id").alias("b"), F.col("e").alias("y"), "label")
    d = F.aggregate(F.zip_with("x", "y", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, t: s + t)
    return joins.top_k_per_key(a.join(b, "label").where("a <> b").withColumn("d", d), ["a"], [F.col("d"), F.col("b")], 3).select("a", "b", "k")
