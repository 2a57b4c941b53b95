"""Aggregates, windows and set operations."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import times
from ..operators import aggregates as agg, ranks, setops, windows
from .base import L, R, query, races, results, table


@query("""SELECT coalesce(n_name, 'ALL') AS nation, coalesce(c_mktsegment, 'ALL') AS segment, CAST(grouping(n_name) * 2 + grouping(c_mktsegment) AS BIGINT) AS level, count(*) AS n, round(sum(c_acctbal), 2) AS total
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY GROUPING SETS ((n_name, c_mktsegment), (n_name), ())""")
def grouping_sets_all(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    n, s = F.col("n_name"), F.col("c_mktsegment")
    g = c.groupingSets([[n, s], [n], []], n, s).agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))
    return g.select(F.coalesce("n_name", F.lit("ALL")).alias("nation"), F.coalesce("c_mktsegment", F.lit("ALL")).alias("segment"), F.col("level").cast("long").alias("level"), "n", "total")


@query("""SELECT coalesce(l_returnflag, '(all)') AS flag, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag) HAVING count(*) > 10""")
def rollup_units(spark, sf):
    g = table(spark, sf, "lineitem").rollup("l_returnflag").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 6).alias("slope"), F.count("*").alias("n"))
    return g.where("n > 10").select(F.coalesce("l_returnflag", F.lit("(all)")).alias("flag"), "slope", "n")


@query("SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS status, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_units(spark, sf):
    g = table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return g.select(F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("status"), "n")


@query(f"WITH {R} SELECT cell, round(quantile_cont(mark, 0.5), 6) AS median, round(quantile_cont(mark, 0.9), 6) AS p90, quantile_disc(mark, 0.25) AS d25 FROM r GROUP BY cell")
def percentile_group(spark, sf):
    return results(spark, sf).groupBy("cell").agg(F.round(F.percentile("mark", 0.5), 6).alias("median"), F.round(F.percentile("mark", 0.9), 6).alias("p90"), F.expr("percentile_disc(0.25) WITHIN GROUP (ORDER BY mark)").alias("d25"))


@query(f"""WITH {R} SELECT person, count(*) FILTER (WHERE cell = 'click') AS clicks, round(sum(mark) FILTER (WHERE mark > 50), 2) AS big, count(DISTINCT cell) AS cells, bool_or(mark > 190) AS any_top, bool_and(mark > 1) AS all_pos FROM r GROUP BY person HAVING count(DISTINCT cell) >= 3""")
def filter_aggs_having(spark, sf):
    g = results(spark, sf).groupBy("person").agg(F.count_if(F.col("cell") == "click").alias("clicks"), F.round(F.sum(F.when(F.col("mark") > 50, F.col("mark"))), 2).alias("big"), F.count_distinct("cell").alias("cells"), F.bool_or(F.col("mark") > 190).alias("any_top"), F.bool_and(F.col("mark") > 1).alias("all_pos"))
    return g.where("cells >= 3")


@query("""WITH w AS (SELECT l_suppkey, l_extendedprice, sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey * 10 + l_linenumber) AS run, sum(l_quantity) OVER (PARTITION BY l_suppkey) AS total FROM lineitem)
SELECT l_suppkey, min(l_extendedprice) AS weighted_median FROM w WHERE run * 2 >= total GROUP BY l_suppkey""")
def weighted_median(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return agg.weighted_median(li, ["l_suppkey"], "l_extendedprice", "l_quantity", "id")


@query(f"""WITH {R}, m AS (SELECT cell, quantile_cont(mark, 0.5) AS median FROM r GROUP BY cell) SELECT cell, round(median, 6) AS median, round(1.4826 * quantile_cont(abs(mark - median), 0.5), 6) AS mad FROM r JOIN m USING (cell) GROUP BY cell, median""")
def mad(spark, sf):
    return agg.robust_scale(results(spark, sf), ["cell"], "mark").select("cell", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"))


@query(f"""WITH {R}, v AS (SELECT person, cell, count(*) AS votes FROM r GROUP BY ALL), k AS (SELECT *, sum(votes) OVER (PARTITION BY person) AS t, row_number() OVER (PARTITION BY person ORDER BY votes DESC, cell) AS k FROM v)
SELECT person, CASE WHEN votes >= 0.25 * t AND t >= 5 THEN cell END AS winner, votes, CAST(t AS BIGINT) AS total FROM k WHERE k = 1""")
def mode_vote(spark, sf):
    return agg.majority(results(spark, sf), ["person"], "cell", 0.25, 5)


@query(f"""WITH {L}, h AS (SELECT person, team, sum(mark) AS s, count(*) AS n FROM l GROUP BY ALL), t AS (SELECT *, sum(s) OVER (PARTITION BY person) AS ts, sum(n) OVER (PARTITION BY person) AS tn FROM h),
x AS (SELECT team, (ts - s) / (tn - n) AS x, s / n - (ts - s) / (tn - n) AS y FROM t WHERE tn - n >= 3), c AS (SELECT team, y, x - avg(x) OVER (PARTITION BY team) AS x FROM x)
SELECT team, round(sum(x * y) / sum(x * x) * (count(*) / (count(*) + 400.0)), 6) AS slope, count(*) AS n_persons FROM c GROUP BY team""")
def loo_slope(spark, sf):
    got = agg.leave_one_out_slope(races(spark, sf), "person", "team", "mark", 3, 400.0)
    return got.select("team", F.round("slope", 6).alias("slope"), "n_persons")


@query("SELECT p_brand, string_agg(p_name, ', ' ORDER BY p_name, p_partkey) AS members, count(*) AS n FROM part GROUP BY p_brand")
def listagg_members(spark, sf):
    p = table(spark, sf, "part")
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_name", "p_partkey"))), lambda s: s["p_name"]), ", ")
    return p.groupBy("p_brand").agg(names.alias("members"), F.count("*").alias("n"))


@query("SELECT l_suppkey, round(corr(l_extendedprice, l_quantity), 6) AS r, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(stddev_samp(l_extendedprice), 4) AS sd FROM lineitem GROUP BY l_suppkey")
def regr_corr(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.round(F.corr("l_extendedprice", "l_quantity"), 6).alias("r"), F.round(F.regr_slope("l_extendedprice", "l_quantity"), 6).alias("slope"), F.round(F.stddev_samp("l_extendedprice"), 4).alias("sd"))


@query(f"""WITH {R} SELECT CAST(CASE WHEN mark < 0 THEN 0 WHEN mark >= 200 THEN 21 ELSE floor(mark / 10) + 1 END AS BIGINT) AS band, count(*) AS n, round(avg(mark), 6) AS mean FROM r GROUP BY band""")
def width_bucket_hist(spark, sf):
    r = results(spark, sf)
    return r.groupBy(F.expr("width_bucket(mark, 0, 200, 20)").alias("band")).agg(F.count("*").alias("n"), F.round(F.avg("mark"), 6).alias("mean"))


@query(f"""WITH {R} SELECT person, round(sum(CASE WHEN dayno <= 20 THEN 0.996 ** (20 - dayno) ELSE 0 END * mark) / sum(CASE WHEN dayno <= 20 THEN 0.996 ** (20 - dayno) ELSE 0 END), 6) AS decayed_mean FROM r WHERE dayno <= 20 GROUP BY person""")
def decayed_mean(spark, sf):
    r = results(spark, sf).where("dayno <= 20")
    got = agg.decayed_mean(r, ["person"], "mark", times.decay_weight(F.col("day"), F.lit("2024-01-21").cast("date")))
    return got.select("person", F.round("decayed_mean", 6).alias("decayed_mean"))


@query("SELECT l_returnflag, count(*) AS n, max(l_orderkey) AS max_key, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY l_returnflag")
def fingerprint(spark, sf):
    return agg.fingerprint(table(spark, sf, "lineitem"), ["l_returnflag"], "l_orderkey", "l_quantity")


@query("""WITH c AS (SELECT p_type, count(*) AS n FROM part GROUP BY p_type), g AS (SELECT CASE WHEN n < 40 THEN 'other' ELSE part.p_type END AS grp, p_retailprice FROM part JOIN c USING (p_type)) SELECT grp, quantile_cont(p_retailprice, 0.5) AS median, count(*) AS n FROM g GROUP BY grp""")
def step_groups(spark, sf):
    return agg.step_groups(table(spark, sf, "part"), "p_type", "p_retailprice", 40)


@query(f"""WITH {L}, p AS (SELECT *, row_number() OVER (PARTITION BY team, person ORDER BY mark DESC, id) AS q FROM l), k AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY mark DESC, id) AS k FROM p WHERE q <= 1) SELECT team, person, id, k FROM k WHERE k <= 5""")
def capped_top(spark, sf):
    return agg.capped_top(races(spark, sf), ["team"], "person", [F.desc("mark"), F.col("id")], 5, 1).select("team", "person", "id", "k")


@query(f"""WITH {R}, s AS (SELECT person, CAST(dayno // 10 AS BIGINT) AS block, mark, id FROM r) SELECT a.id, round(quantile_cont(b.mark, 0.5), 6) AS others FROM s a JOIN s b ON a.person = b.person AND a.block = b.block AND a.id <> b.id GROUP BY a.id""")
def loo_race_median(spark, sf):
    r = results(spark, sf).withColumn("block", F.floor(F.col("dayno") / 10))
    return agg.median_of_others(r, ["person", "block"], "mark", "id").where("others IS NOT NULL").select("id", F.round("others", 6).alias("others"))


@query(f"""WITH {R}, p AS (SELECT *, max(mark) OVER (PARTITION BY cell ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM r) SELECT cell, id, mark, previous FROM p WHERE previous IS NULL OR mark > previous""")
def running_record(spark, sf):
    return windows.running_record(results(spark, sf), ["cell"], ["ts", "id"], "mark").select("cell", "id", "mark", "previous")


@query(f"""WITH {R} SELECT id, dayno - lag(dayno) OVER w AS gap, lead(id) OVER w AS next_id, round(percent_rank() OVER v, 6) AS pr, CAST(ntile(4) OVER v AS BIGINT) AS quarter, dense_rank() OVER (PARTITION BY person ORDER BY dayno) AS day_rank, first_value(cell) OVER w AS first_cell
FROM r WINDOW w AS (PARTITION BY person ORDER BY ts, id), v AS (PARTITION BY person ORDER BY mark, id)""")
def lag_rank_family(spark, sf):
    w, v = Window.partitionBy("person").orderBy("ts", "id"), Window.partitionBy("person").orderBy("mark", "id")
    return results(spark, sf).select(
        "id", (F.col("dayno") - F.lag("dayno").over(w)).alias("gap"), F.lead("id").over(w).alias("next_id"), F.round(F.percent_rank().over(v), 6).alias("pr"), F.ntile(4).over(v).cast("long").alias("quarter"),
        F.dense_rank().over(Window.partitionBy("person").orderBy("dayno")).cast("long").alias("day_rank"), F.first("cell").over(w).alias("first_cell"),
    )


@query(f"""WITH {R}, s AS (SELECT *, CASE WHEN dayno - lag(dayno) OVER (PARTITION BY person ORDER BY dayno, id) > 3 THEN 1 ELSE 0 END AS s FROM r), n AS (SELECT *, sum(s) OVER (PARTITION BY person ORDER BY dayno, id) AS stint FROM s)
SELECT person, CAST(stint AS BIGINT) AS stint, min(dayno) AS first_day, max(dayno) AS last_day, count(*) AS n FROM n GROUP BY person, stint""")
def sessionise_islands(spark, sf):
    return windows.islands(results(spark, sf), "person", "dayno", "id", 3)


@query(f"""WITH {R} SELECT id, round(avg(mark) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 9) AS earlier_mean, round(avg(mark) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 9) AS later_mean, max(mark) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later_best FROM r WINDOW w AS (PARTITION BY person ORDER BY ts, id)""")
def before_after_means(spark, sf):
    got = windows.before_after(results(spark, sf), ["person"], ["ts", "id"], "mark")
    return got.select("id", F.round("earlier_mean", 9).alias("earlier_mean"), F.round("later_mean", 9).alias("later_mean"), "later_best")


@query(f"""WITH {R}, p AS (SELECT a.id, a.mark, count(b.mark) AS n_prior, quantile_cont(b.mark, 0.5) AS med FROM r a JOIN r b ON a.person = b.person AND b.dayno < a.dayno GROUP BY a.id, a.mark) SELECT id, n_prior, round(mark - med, 6) AS jump FROM p WHERE n_prior >= 3""")
def breakouts(spark, sf):
    return windows.breakouts(results(spark, sf), ["person"], "dayno", "mark", 3).select("id", "n_prior", F.round("jump", 6).alias("jump"))


@query(f"""WITH {R} SELECT id, dayno - min(dayno) OVER (PARTITION BY person) AS days_in, dayno = min(dayno) OVER (PARTITION BY person) AS opener FROM r""")
def season_position(spark, sf):
    return windows.season_position(results(spark, sf).withColumn("season", F.lit(2023)), "person", "season", "dayno").select("id", "days_in", "opener")


@query("""SELECT 'all' AS op, count(*) AS n FROM (SELECT o_custkey FROM orders UNION ALL SELECT c_custkey FROM customer) UNION ALL SELECT 'distinct', count(*) FROM (SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer) UNION ALL SELECT 'except', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'except_all', count(*) FROM (SELECT o_custkey FROM orders EXCEPT ALL SELECT c_custkey FROM customer)""")
def set_operations(spark, sf):
    o, c = table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    forms = {"all": o.union(c), "distinct": o.union(c).distinct(), "intersect": o.intersect(c), "except": c.subtract(o), "except_all": o.exceptAll(c)}
    out = None
    for name, df in forms.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
        out = one if out is None else out.union(one)
    return out


@query("""WITH RECURSIVE w AS (SELECT CAST(1 AS BIGINT) AS step, min(o_custkey) AS k FROM orders UNION ALL SELECT step + 1, (SELECT min(o_custkey) FROM orders WHERE o_custkey > w.k) FROM w WHERE w.k IS NOT NULL) SELECT step, k FROM w WHERE k IS NOT NULL""")
def skip_scan(spark, sf):
    return ranks.numbered(table(spark, sf, "orders").select(F.col("o_custkey").alias("k")).distinct(), [F.col("k")], "step")


_EDGES = "e AS (SELECT DISTINCT o_custkey AS a, l_suppkey + 1000000 AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey), b AS (SELECT a AS src, b AS dst FROM e UNION SELECT b, a FROM e)"


def _edges(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    li = li.select("l_orderkey", "l_suppkey").repartition(setops.tasks_for(spark, li.count()), "l_orderkey")  # orders in a row compress to little
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + 1000000).alias("dst"))


_REACH = f"WITH {_EDGES}, m0 AS (SELECT src AS id, src AS c FROM b GROUP BY src)"
for _i in range(8):  # the graph is dense: its paths are far shorter
    _REACH += f", m{_i + 1} AS (SELECT id, min(c) AS c FROM (SELECT id, c FROM m{_i} UNION ALL SELECT src, c FROM b JOIN m{_i} ON dst = id) GROUP BY id)"


@query(_REACH + " SELECT id, c AS component FROM m8")
def connected_components(spark, sf):
    return setops.components(_edges(spark, sf))


def _seeds(spark, sf, e):
    """Customers of two segments carry a label from the start."""
    c = table(spark, sf, "customer").where("c_mktsegment in ('AUTOMOBILE', 'BUILDING')").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 3).cast("long").alias("label"))
    return c.join(e, c["id"] == e["src"], "left_semi")


_LABELS = f"""WITH {_EDGES}, s0 AS (SELECT c_custkey AS id, CAST(c_nationkey % 3 AS BIGINT) AS label FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING') AND c_custkey IN (SELECT src FROM b))"""


def _round(i: int, rule: str) -> str:
    return f""", v{i} AS (SELECT src, label, count(*) AS v FROM b JOIN s{i - 1} ON dst = id GROUP BY ALL), t{i} AS (SELECT src, max_by(label, v * 10 + label) AS label, max(v) AS v, sum(v) AS n FROM v{i} GROUP BY src),
s{i} AS (SELECT * FROM s{i - 1} UNION ALL SELECT src, label FROM t{i} WHERE {rule} AND src NOT IN (SELECT id FROM s{i - 1}))"""


@query(_LABELS + _round(1, "v > 0.4 * n") + _round(2, "v > 0.4 * n") + " SELECT * FROM s2")
def label_propagation(spark, sf):
    e = _edges(spark, sf)
    return setops.propagate(e, _seeds(spark, sf, e), 0.4, 2)


@query(_LABELS + _round(1, "v > 0.4 * n") + _round(2, "v = n") + " SELECT * FROM s2")
def unanimous_commit(spark, sf):
    e = _edges(spark, sf)
    return setops.commit_unanimous(e, setops.propagate(e, _seeds(spark, sf, e), 0.4, 1))


_PEEL = f"WITH {L}, p0 AS (SELECT person, race FROM l)"
for _i in range(12):
    _PEEL += f", p{_i + 1} AS (SELECT person, race FROM p{_i} WHERE person IN (SELECT person FROM p{_i} GROUP BY person HAVING count(*) >= 3) AND race IN (SELECT race FROM p{_i} GROUP BY race HAVING count(DISTINCT person) >= 3))"


@query(_PEEL + " SELECT person, count(*) AS n FROM p12 GROUP BY person")
def informative_peel(spark, sf):
    return setops.informative(races(spark, sf), "person", "race", 3, 3).groupBy("person").agg(F.count("*").alias("n"))
