"""Boards, ranks and paging."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import text, times
from ..operators import boards
from .base import L, R, query, races, results, table


@query(f"""WITH {R}, d AS (SELECT *, row_number() OVER (PARTITION BY person, cell, mark ORDER BY id) AS k FROM r)
SELECT id, person, cell, mark, row_number() OVER (ORDER BY mark DESC NULLS LAST, id) AS rank FROM d WHERE k = 1 ORDER BY mark DESC NULLS LAST, id LIMIT 100""")
def perf_board(spark, sf):
    return boards.performance_board(results(spark, sf), 100).select("id", "person", "cell", "mark", "rank")


@query(f"""WITH {R}, d AS (SELECT *, row_number() OVER (PARTITION BY person, cell, mark ORDER BY id) AS k FROM r WHERE cell IN ('click', 'view', 'purchase') AND day >= DATE '2024-01-05' AND mark <= 200)
SELECT * FROM (SELECT id, person, cell, mark, row_number() OVER (ORDER BY mark DESC NULLS LAST, id) AS rank FROM d WHERE k = 1) WHERE rank > 20 AND rank <= 70""")
def perf_board_filtered(spark, sf):
    f = boards.Filters(cells=("click", "view", "purchase"), since="2024-01-05", high=200.0)
    return boards.performance_board(results(spark, sf), 50, f, offset=20).select("id", "person", "cell", "mark", "rank")


@query(f"""WITH {R}, b AS (SELECT *, row_number() OVER (PARTITION BY person, cell ORDER BY mark DESC NULLS LAST, id) AS k FROM r)
SELECT person, cell, id, mark FROM b WHERE k = 1""")
def pr_board(spark, sf):
    return boards.best_per_person(results(spark, sf)).select("person", "cell", "id", "mark")


@query(f"""WITH {L}, g AS (SELECT person, year(day) AS season, list_sort(list(mark)) AS m, median(mark) AS md FROM l GROUP BY ALL),
k AS (SELECT person, season, len(m) AS n_results, list_filter(m, lambda x: x >= md - 20000) AS a FROM g WHERE len(m) >= 3),
h AS (SELECT *, len(a) AS n, (len(a) + 1.0/3) * 0.8 + 1.0/3 AS h FROM k)
SELECT person, season, n_results, round(CASE WHEN h >= n THEN a[n] WHEN h <= 1 THEN a[1] ELSE a[CAST(floor(h) AS INT)] + (h - floor(h)) * (a[CAST(floor(h) AS INT) + 1] - a[CAST(floor(h) AS INT)]) END, 3) AS ability FROM h""")
def ability_board(spark, sf):
    r = races(spark, sf).withColumn("season", F.year("day").cast("long"))
    return boards.ability(r, band=20000.0).select("person", "season", "n_results", F.round("ability", 3).alias("ability"))


_SCOPED = """WITH c AS (SELECT c_custkey, c_nationkey, n_regionkey, c_mktsegment, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey), e AS (SELECT *, c_acctbal > 0 AS ok FROM c)
SELECT c_custkey"""
for _n, _p in (("all", ""), ("nation", ", c_nationkey"), ("region", ", n_regionkey"), ("segment", ", c_mktsegment"), ("region_segment", ", n_regionkey, c_mktsegment")):
    _SCOPED += f", CASE WHEN ok THEN row_number() OVER (PARTITION BY ok{_p} ORDER BY c_acctbal DESC NULLS LAST, c_custkey) END AS rank_{_n}, CASE WHEN ok THEN count(*) OVER (PARTITION BY ok{_p}) END AS n_{_n}"
_SCOPED += " FROM e"


@query(_SCOPED)
def scoped_ranks(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    scopes = {"all": [], "nation": ["c_nationkey"], "region": ["n_regionkey"], "segment": ["c_mktsegment"], "region_segment": ["n_regionkey", "c_mktsegment"]}
    ranked = boards.scoped_ranks(c.select("c_custkey", "c_nationkey", "n_regionkey", "c_mktsegment", "c_acctbal"), scopes, "c_acctbal", "c_custkey", F.col("c_acctbal") > 0)
    return ranked.select("c_custkey", *[f"{p}_{n}" for n in scopes for p in ("rank", "n")])


@query("WITH m AS (SELECT c_acctbal AS v, c_custkey AS k FROM customer WHERE c_custkey = 100) SELECT count(*) + 1 AS rank FROM customer, m WHERE c_acctbal > v OR (c_acctbal = v AND c_custkey < k)")
def rank_of_one(spark, sf):
    return boards.rank_of(table(spark, sf, "customer"), "c_acctbal", "c_custkey", 100)


@query("""SELECT * FROM (SELECT CAST(c_nationkey AS BIGINT) AS nation, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS position, count(*) OVER (PARTITION BY c_nationkey) AS length, c_acctbal, c_custkey FROM customer) WHERE position % 25 = 1""")
def seek_positions(spark, sf):
    return boards.seek_positions(table(spark, sf, "customer").withColumn("nation", F.col("c_nationkey").cast("long")), ["nation"], "c_acctbal", "c_custkey", 25)


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 5000 OR (c_acctbal = 5000 AND c_custkey > 10) ORDER BY c_acctbal DESC, c_custkey LIMIT 40")
def keyset_page(spark, sf):
    return boards.page_after(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", (5000.0, 10), 40)


@query(f"WITH {R} SELECT count(*) > 100 AS truncated FROM (SELECT * FROM r WHERE cell = 'click' LIMIT 101)")
def capped_query(spark, sf):
    return boards.capped(results(spark, sf).where("cell = 'click'"), 100)[1]


@query("""WITH p AS (SELECT * FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50) SELECT o_orderkey, o_totalprice, c_name FROM p LEFT JOIN customer ON o_custkey = c_custkey""")
def page_then_name(spark, sf):
    page = table(spark, sf, "orders").orderBy(F.col("o_totalprice").desc_nulls_last(), "o_orderkey").limit(50)
    return page.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "o_totalprice", "c_name")


@query(f"""WITH {L}, u AS (SELECT team, person, max(mark) AS best FROM l GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY best DESC, person) AS k FROM u)
SELECT team, round(avg(best), 3) AS average, count(*) AS n_used FROM k WHERE k <= 10 GROUP BY team""")
def unit_board(spark, sf):
    from ..operators import scoring

    best = races(spark, sf).groupBy("team", "person").agg(F.max("mark").alias("best"))
    return scoring.best_n_average(best, ["team"], "best", "person", 10).select("team", F.round("average", 3).alias("average"), "n_used")


@query("""SELECT o_orderkey, CAST(CASE WHEN month(o_orderdate) > 8 OR (month(o_orderdate) = 8 AND day(o_orderdate) >= 1) THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END AS BIGINT) AS season,
strftime(CAST(o_orderdate AS DATE) - CAST((isodow(o_orderdate) + 2) % 7 AS INTEGER), '%Y-%m-%d') AS week FROM orders""")
def season_year(spark, sf):
    d = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", times.season_year(d).cast("long").alias("season"), F.date_format(times.week_key(d), "yyyy-MM-dd").alias("week"))


@query("""WITH s AS (SELECT o_orderkey, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS c FROM orders)
SELECT o_orderkey, CASE WHEN c >= 360000 THEN CAST(c // 360000 AS VARCHAR) || ':' || lpad(CAST(c // 6000 % 60 AS VARCHAR), 2, '0') ELSE CAST(c // 6000 % 60 AS VARCHAR) END || ':' || lpad(CAST(c // 100 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') AS shown, c AS back FROM s""")
def time_parse_format(spark, sf):
    shown = times.format_time(F.col("o_totalprice"))
    return table(spark, sf, "orders").select("o_orderkey", shown.alias("shown")).withColumn("back", F.round(times.parse_time(F.col("shown")) * 100).cast("long"))


@query("""SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS folded, CASE WHEN lower(trim(p_brand)) NOT IN ('unknown', 'n/a', 'none', '-') AND trim(p_brand) <> '' THEN p_brand END AS brand FROM part""")
def name_fold(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.fold(F.col("p_name")).alias("folded"), text.named(F.col("p_brand")).alias("brand"))


@query("""WITH n AS (SELECT n_nationkey AS a, n_name AS x FROM nation) SELECT p.a AS a, q.a AS b, levenshtein(lower(p.x), lower(q.x)) AS d FROM n p JOIN n q ON p.a < q.a AND left(p.x, 1) = left(q.x, 1)""")
def name_similarity(spark, sf):
    n = table(spark, sf, "nation")
    p, q = n.select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("x")), n.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("y"))
    pairs = p.join(q, (F.substring("x", 1, 1) == F.substring("y", 1, 1)) & (F.col("a") < F.col("b")))  # blocked by initial
    return pairs.select("a", "b", F.levenshtein(F.lower("x"), F.lower("y")).cast("long").alias("d"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))
