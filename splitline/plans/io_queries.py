"""Sources, sinks, parsers and streams over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import shared_dir
from ..sources import files, html, reports as parsers
from ..streaming import streams
from .base import query, table


def _folder(spark: SparkSession) -> str:
    """A fresh folder that all machines share."""
    return f"{shared_dir(spark)}/io-{uuid.uuid4().hex}"


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def csv_round_trip(spark, sf):
    path = _folder(spark)
    table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal").write.csv(path, header=True)
    return files.read_csv(spark, path, "c_custkey long, c_name string, c_acctbal double")


@query("SELECT conv_id, turn, role, text FROM conversations")
def json_round_trip(spark, sf):
    path = _folder(spark)
    table(spark, sf, "conversations").write.json(path)
    return files.read_json(spark, path, "conv_id long, turn long, role string, text string")


@query("SELECT p_partkey, p_brand, CAST(p_size AS BIGINT) AS p_size FROM part WHERE p_brand = 'Brand#11' OR p_brand LIKE '%2'")
def partitioned_sink(spark, sf):
    path = _folder(spark)
    files.write_partitioned(table(spark, sf, "part").select("p_partkey", "p_brand", F.col("p_size").cast("long").alias("p_size")), path, ["p_brand"])
    return spark.read.parquet(path).where("p_brand = 'Brand#11' or p_brand like '%2'")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def upsert(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return files.upsert(c, c.where("c_custkey % 3 = 0").withColumn("c_mktsegment", F.lit("new")), ["c_custkey"])


@query("SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, len(regexp_extract_all(html, '<a\\s+href=\"([^\"]*)\"', 1)) AS n_links FROM pages")
def html_parse(spark, sf):
    p = table(spark, sf, "pages")
    n = html.links(p, "page_id", "html").groupBy("page_id").agg(F.count("*").alias("n_links"))
    return p.select("page_id", html.title(F.col("html")).alias("title")).join(n, "page_id", "left").select("page_id", "title", F.coalesce("n_links", F.lit(0)).alias("n_links"))


_TEXT = r"regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
for _a, _b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _TEXT = f"replace({_TEXT}, '{_a}', '{_b}')"


@query(rf"SELECT page_id, trim(regexp_replace({_TEXT}, '\s+', ' ', 'g')) AS text FROM pages")
def html_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", html.page_text(F.col("html")).alias("text"))


_LINES = """SELECT c_nationkey, CAST(place AS VARCHAR) AS place, c_name AS name, c_mktsegment AS team, CAST(c_custkey % 20 + 14 AS VARCHAR) || ':' || lpad(CAST(c_custkey % 60 AS VARCHAR), 2, '0') || '.00' AS mark
FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS place FROM customer)"""


def _entries(spark, sf):
    """Each nation's customers as a race: place, name, team and mark as text."""
    c = table(spark, sf, "customer").withColumn("place", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")))
    mark = F.format_string("%d:%05.2f", (F.col("c_custkey") % 20 + 14).cast("int"), (F.col("c_custkey") % 60).cast("double"))
    return c.select("c_nationkey", "place", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("team"), mark.alias("mark"))


def _report(rows: DataFrame, head: str, line, tail: str = "") -> DataFrame:
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("l")))), lambda s: s["l"]), "\n")
    return rows.groupBy("c_nationkey").agg(F.concat(F.lit(head), body, F.lit(tail)).alias("text"))


def _parsed(reports: DataFrame) -> DataFrame:
    return parsers.rows_of(reports, "c_nationkey", "text").select("c_nationkey", "place", "name", "team", "mark")


@query(_LINES)
def report_rows(spark, sf):
    """Fixed-width reports, columns found from the header's offsets."""
    head = "County meet\n%4s %-25s  %-12s  %8s\n%s\n" % ("Pl", "Athlete", "School", "Time", "=" * 55)
    return _parsed(_report(_entries(spark, sf), head, F.format_string("%4d %-25s  %-12s  %8s", "place", "name", "team", "mark")))


@query(_LINES)
def html_table_rows(spark, sf):
    """HTML result tables, columns found by their titles."""
    cells = F.concat(*[F.concat(F.lit("<td>"), F.col(c).cast("string"), F.lit("</td>")) for c in ("team", "place", "mark", "name")])
    return _parsed(_report(_entries(spark, sf), "<html><table><tr><td>menu</td></tr></table><table><tr><th>Club</th><th>Pos</th><th>Result</th><th>Runner</th></tr>", F.concat(F.lit("<tr>"), cells, F.lit("</tr>")), "</table></html>"))


@query(_LINES.replace("FROM customer)", "FROM customer QUALIFY count(*) OVER (PARTITION BY c_nationkey) >= 3)"))
def html_row_vote(spark, sf):
    """HTML result tables without titles: columns by what most of their rows hold; fewer than three rows decide nothing."""
    cells = F.concat(*[F.concat(F.lit("<td>"), F.col(c).cast("string"), F.lit("</td>")) for c in ("place", "name", "team", "mark")])
    return _parsed(_report(_entries(spark, sf), "<html><table><tr><td>menu</td></tr></table><table>", F.concat(F.lit("<tr>"), cells, F.lit("</tr>")), "</table></html>"))


@query(_LINES)
def csv_header_synonyms(spark, sf):
    quoted = F.concat(F.lit('"'), F.col("team"), F.lit('"'))
    return _parsed(_report(_entries(spark, sf), "Rank,Competitor,Affiliation,Finish\n", F.concat_ws(",", "place", "name", quoted, "mark")))


@query(_LINES)
def tab_format_sniffed(spark, sf):
    return _parsed(_report(_entries(spark, sf), "Mark\tPl\tName\tTeam\n", F.concat_ws("\t", "mark", "place", "name", "team")))


@query("SELECT c_nationkey, c_custkey, CAST(c_acctbal AS VARCHAR) AS name FROM customer WHERE c_custkey % 7 <> 0")
def json_keyed_pages(spark, sf):
    """Keyed JSON pages, as an object for even nations and as a list with nulls in it for odd ones."""
    c = table(spark, sf, "customer").select("c_nationkey", "c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal").cast("string")).alias("v"))
    # a list's places are its keys: the entry of customer k stands at place k, after as many nulls as keys are missing before it
    missing = F.col("c_custkey") - F.coalesce(F.lag("c_custkey").over(Window.partitionBy("c_nationkey").orderBy("c_custkey")), F.lit(-1)) - 1
    g = c.withColumn("missing", missing.cast("int")).groupBy("c_nationkey").agg(F.sort_array(F.collect_list(F.struct("c_custkey", "v", "missing"))).alias("e"))
    as_map = F.to_json(F.map_from_entries(F.transform("e", lambda x: F.struct(x["c_custkey"].cast("string").alias("k"), x["v"].alias("v")))))
    as_list = F.to_json(F.flatten(F.transform("e", lambda x: F.concat(F.array_repeat(F.lit(None).cast("string"), x["missing"]), F.array(x["v"])))))
    pages = g.select("c_nationkey", F.when(F.col("c_nationkey") % 2 == 0, as_map).otherwise(as_list).alias("page"))
    entry = pages.select("c_nationkey", F.explode(html.keyed_entries(F.col("page"))).alias("x"))
    return entry.select("c_nationkey", F.col("x.key").cast("long").alias("c_custkey"), F.col("x.value").alias("name"))


@query("SELECT p_partkey, p_name AS name, p_brand AS place, CAST(p_size AS BIGINT) AS size FROM part")
def linked_data_events(spark, sf):
    """Linked-data scripts of pages as typed rows."""
    p = table(spark, sf, "part")
    data = F.to_json(F.struct(F.lit("SportsEvent").alias("@type"), F.col("p_name").alias("name"), F.struct(F.col("p_brand").alias("name")).alias("location"), F.col("p_size").alias("size")))
    page = F.concat(F.lit("<html><script>var a;</script><script type=\"application/ld+json\">"), data, F.lit("</script><p>x</p></html>"))
    found = p.select("p_partkey", F.explode(html.linked_data(page)).alias("j"))
    e = F.from_json("j", "name string, location struct<name:string>, size long")
    return found.select("p_partkey", e["name"].alias("name"), e["location"]["name"].alias("place"), e["size"].alias("size"))


@query("SELECT s_suppkey % 10 AS page, 'meets/' || CAST(s_suppkey AS VARCHAR) || '.htm' AS key, CAST(s_nationkey AS BIGINT) AS size FROM supplier")
def bucket_listing(spark, sf):
    s = table(spark, sf, "supplier")
    entry = F.concat(F.lit("<Contents><Key>meets/"), F.col("s_suppkey").cast("string"), F.lit(".htm</Key><Size>"), F.col("s_nationkey").cast("string"), F.lit("</Size></Contents>"))
    pages = s.groupBy((F.col("s_suppkey") % 10).alias("page")).agg(F.concat(F.lit("<?xml version='1.0'?><ListBucketResult><Name>b</Name>"), F.array_join(F.collect_list(entry), ""), F.lit("</ListBucketResult>")).alias("xml"))
    return pages.select("page", F.explode(html.listing(F.col("xml"))).alias("x")).select("page", "x.key", "x.size")


@query(r"""WITH h AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a\s+href="([^"]*)"', 1)) AS href FROM pages),
t AS (SELECT DISTINCT page_id, url, CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^([a-z]+:)', 1) || href WHEN starts_with(href, '/') THEN regexp_extract(url, '^([a-z]+://[^/]+)', 1) || href WHEN regexp_matches(href, '^(#|[a-z]+:)') OR href = '' THEN NULL ELSE regexp_replace(url, '[^/]*$', '') || href END AS target FROM h),
s AS (SELECT page_id, target, CAST(CASE WHEN regexp_matches(target, 'results?|[0-9]{4}') THEN 2 ELSE 0 END + CASE WHEN regexp_extract(target, '^[a-z]+://([^/]+)', 1) = regexp_extract(url, '^[a-z]+://([^/]+)', 1) THEN 1 ELSE 0 END AS INTEGER) AS score FROM t WHERE target IS NOT NULL)
SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, target) AS rank FROM s""")
def crawl_candidates(spark, sf):
    return html.candidates(table(spark, sf, "pages"), "page_id", "url", "html", "results?|[0-9]{4}")


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    return streams.events(spark, sf, spark.read.parquet(f"{sf}/events.parquet").schema, "events.parquet")


@query("SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, sf):
    folder = _folder(spark)
    streams.drain(streams.tumbling(_stream(spark, sf), "1 day", "1 hour"), folder, "complete")
    return spark.read.parquet(f"{folder}/out").select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH s AS (SELECT time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR * o AS w, event_type, value FROM events, (VALUES (0), (1)) v(o)) SELECT strftime(w, '%Y-%m-%d %H') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY ALL""")
def stream_sliding(spark, sf):
    folder = _folder(spark)
    streams.drain(streams.sliding(_stream(spark, sf), "24 hours", "12 hours", "1 hour"), folder, "complete")
    return spark.read.parquet(f"{folder}/out").select(F.date_format("window.start", "yyyy-MM-dd HH").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS s FROM events), n AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM o) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM n GROUP BY user_id, g""")
def session_windows(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "n")


@query("""SELECT user_id, event_id, value FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM events WHERE value IS NOT NULL) WHERE p IS NULL OR value > p""")
def stream_running_best(spark, sf):
    folder = _folder(spark)
    streams.drain(streams.running_best(_stream(spark, sf)), folder)
    return spark.read.parquet(f"{folder}/out")


@query("SELECT count(DISTINCT event_id) AS n FROM events")
def stream_distinct_landings(spark, sf):
    folder = _folder(spark)
    streams.drain(streams.distinct_landings(_stream(spark, sf), "event_id", "90 days"), folder)
    return spark.read.parquet(f"{folder}/out").agg(F.count("*").alias("n"))


@query("WITH d AS (SELECT event_type, round(avg(value), 6) AS difficulty FROM events GROUP BY event_type) SELECT event_id, difficulty FROM events LEFT JOIN d USING (event_type)")
def stream_static_pricing(spark, sf):
    folder = _folder(spark)
    d = table(spark, sf, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("difficulty"))
    streams.drain(streams.priced(_stream(spark, sf), d, "event_type").select("event_id", "difficulty"), folder)
    return spark.read.parquet(f"{folder}/out")


@query("SELECT user_id, event_id, value FROM events WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def stream_promotion(spark, sf):
    """Landed rows promoted batch by batch: the newest row of each user, whatever was replayed."""
    folder = _folder(spark)
    landed = _stream(spark, sf).where("user_id IS NOT NULL").select("user_id", "event_id", "value")
    streams.promote(landed, f"{folder}/table", f"{folder}/state", "user_id", "event_id")
    return streams.promoted(spark, f"{folder}/table", "user_id", "event_id")


@query("SELECT event_id, round(value * value, 6) AS square FROM events WHERE value IS NOT NULL")
def stream_row_function(spark, sf):
    folder = _folder(spark)

    def squares(frames):
        for f in frames:
            yield f[["event_id"]].assign(square=f["value"] * f["value"])

    streams.row_function(_stream(spark, sf).where("value IS NOT NULL").select("event_id", "value"), squares, "event_id long, square double", f"{folder}/state", f"{folder}/out")
    return spark.read.parquet(f"{folder}/out").select("event_id", F.round("square", 6).alias("square"))
