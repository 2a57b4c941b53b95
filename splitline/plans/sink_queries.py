"""Sinks, snapshots, incremental runs and samples on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import times
from ..operators import ranks
from ..sources import files, sinks
from ..streaming import streams
from .base import query, table
from .io_queries import _folder, _stream


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 AND c_nationkey % 2 = 0 THEN 'staged' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer")
def staged_update(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    s = table(spark, sf, "customer").where("c_custkey % 5 = 0").select("c_custkey", F.when(F.col("c_nationkey") % 2 == 0, "staged").alias("c_mktsegment"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return sinks.staged_update(c, s, ["c_custkey"], ["c_mktsegment", "c_acctbal"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 11 = 0")
def changed_rows_only(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    new = c.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")))
    return sinks.changed_rows(c.where("c_custkey % 11 <> 0"), new, ["c_custkey"], ["c_mktsegment"])


@query("SELECT 1 AS version, count(*) AS n FROM customer UNION ALL SELECT 2, count(*) FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 0, count(*) FROM customer WHERE c_custkey % 2 = 0")
def versioned_swap(spark, sf):
    v = sinks.Versioned(spark, _folder(spark))
    c = table(spark, sf, "customer")
    v.write(c)
    v.write(c.where("c_custkey % 2 = 0"))
    out = None
    for n in (1, 2, 0):
        one = v.read(n or None).agg(F.count("*").alias("n")).select(F.lit(n).alias("version"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT strftime(d, '%Y-%m-%d') AS snapshot_date, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer, (VALUES (DATE '2024-01-12', 2), (DATE '2024-01-19', 3)) v(d, m) WHERE c_custkey % m = 0 GROUP BY d")
def dated_snapshots(spark, sf):
    """Three weekly snapshots, one taken twice, of which all but two are deleted."""
    path, c = _folder(spark), table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    for day, m in (("2024-01-05", 5), ("2024-01-12", 7), ("2024-01-12", 2), ("2024-01-19", 3)):
        sinks.write_snapshot(c.where(f"c_custkey % {m} = 0"), path, day)
    sinks.prune_snapshots(spark, path, 2)
    return spark.read.parquet(path).groupBy(F.date_format("snapshot_date", "yyyy-MM-dd").alias("snapshot_date")).agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS old_rank FROM customer WHERE c_custkey % 4 <> 0), b AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal + c_nationkey * 100 DESC, c_custkey) AS new_rank FROM customer WHERE c_custkey % 5 <> 0) SELECT c_custkey, old_rank, new_rank, CASE WHEN old_rank IS NULL THEN 'new' WHEN new_rank IS NULL THEN 'gone' WHEN new_rank < old_rank THEN 'up' WHEN new_rank > old_rank THEN 'down' ELSE 'same' END AS change FROM a FULL JOIN b USING (c_custkey)")
def weekly_rank_movers(spark, sf):
    """Ranks of two dated snapshots, compared."""
    from ..operators import joins

    c, path = table(spark, sf, "customer"), _folder(spark)
    old = ranks.numbered(c.where("c_custkey % 4 <> 0"), [F.desc("c_acctbal"), F.col("c_custkey")], "rank")
    new = ranks.numbered(c.where("c_custkey % 5 <> 0").withColumn("v", F.col("c_acctbal") + F.col("c_nationkey") * 100), [F.desc("v"), F.col("c_custkey")], "rank")
    for day, df in (("2024-01-05", old), ("2024-01-12", new)):
        sinks.write_snapshot(df.select("c_custkey", "rank"), path, day)
    taken = spark.read.parquet(path)
    at = lambda day: taken.where(F.col("snapshot_date") == F.lit(day).cast("date"))
    return joins.snapshot_diff(at("2024-01-05"), at("2024-01-12"), "c_custkey", "rank")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS k, CASE WHEN c_custkey % 3 = 0 THEN '''=' || c_name WHEN c_custkey % 3 = 1 THEN CAST(-c_custkey AS VARCHAR) ELSE c_name END AS cell FROM customer""")
def csv_export_guard(spark, sf):
    k = F.col("c_custkey")
    cell = F.when(k % 3 == 0, F.concat(F.lit("="), "c_name")).when(k % 3 == 1, (-k).cast("string")).otherwise(F.col("c_name"))
    path = _folder(spark)
    sinks.export_csv(table(spark, sf, "customer").select(k.alias("k"), cell.alias("cell"), F.lit(None).cast("string").alias("empty")), path)
    return spark.read.csv(path, header=True)


@query("SELECT substr(sha256('s|' || CAST(o_custkey AS VARCHAR)), 1, 12) AS person, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS day, o_totalprice FROM orders")
def anonymised_export(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("person"), F.to_date("o_orderdate").alias("day"), "o_totalprice", F.lit("x").alias("name"))
    return sinks.anonymised(o, "person", "day", ["name"], "s").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("SELECT n_regionkey, CASE WHEN n_regionkey = 0 THEN 'gone' WHEN n_regionkey = 4 THEN 'new' ELSE 'changed' END AS what FROM nation WHERE n_regionkey IN (0, 2, 4) GROUP BY n_regionkey")
def page_payloads(spark, sf):
    """Pages whose payload must be rebuilt, by fingerprint: region 2 changed, 4 is new, 0 is gone."""
    n, path = table(spark, sf, "nation"), _folder(spark)
    sinks.payloads(n.where("n_regionkey <> 4"), ["n_regionkey"], ["n_name"]).write.parquet(path)
    now = n.where("n_regionkey <> 0").withColumn("n_name", F.when(F.col("n_regionkey") == 2, F.upper(F.concat("n_name", F.lit("!")))).otherwise(F.col("n_name")))
    return sinks.stale_keys(sinks.payloads(now, ["n_regionkey"], ["n_name"]), spark.read.parquet(path), ["n_regionkey"])


@query("SELECT CAST(i AS INTEGER) AS chunk, least(64, (SELECT count(*) FROM customer) - 64 * i) AS n FROM (SELECT unnest(range(0, (SELECT CAST(ceil(count(*) / 64.0) AS BIGINT) FROM customer))) AS i)")
def sized_chunks(spark, sf):
    return sinks.write_chunks(table(spark, sf, "customer").select("c_custkey", "c_name"), _folder(spark), ["c_custkey"], 64)


@query("WITH q AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN 'done' ELSE 'pending' END AS state, c_acctbal FROM customer), k AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, state ORDER BY c_acctbal DESC, c_custkey) AS k FROM q) SELECT c_custkey, c_mktsegment, CASE WHEN state = 'pending' AND k <= 5 THEN 'claimed' ELSE state END AS state FROM k")
def queue_claim(spark, sf):
    q = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, "done").otherwise("pending").alias("state"), "c_acctbal")
    return sinks.claim(q, "state", [F.desc("c_acctbal"), F.col("c_custkey")], ["c_mktsegment"], 5)[1].drop("c_acctbal")


@query("SELECT o_orderkey FROM orders WHERE CAST('0x' || substr(md5('s|' || CAST(o_custkey AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < 0.2")
def key_sample(spark, sf):
    return sinks.key_sample(table(spark, sf, "orders"), "o_custkey", 0.2, "s").select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE CAST('0x' || substr(md5('t|' || CAST(l_orderkey * 10 + l_linenumber AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < 0.3")
def table_sample(spark, sf):
    """A row sample of three tenths, the same rows however the table is partitioned."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return sinks.key_sample(li, "id", 0.3, "t").drop("id")


_STATES = """s0 AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, value FROM events WHERE event_id % 5 <> 0)"""


@query(f"WITH {_STATES} SELECT event_id, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, CASE WHEN event_id % 7 = 0 AND CAST(ts AS DATE) > (SELECT max(day) FROM s0) - INTERVAL 10 DAY THEN value + 1 WHEN event_id % 5 = 0 THEN value ELSE value END AS value FROM events WHERE event_id % 5 <> 0 OR CAST(ts AS DATE) > (SELECT max(day) FROM s0) - INTERVAL 10 DAY")
def recheck_window(spark, sf):
    """Late and changed rows are taken in only within ten days of the newest date; older ones are left as they are."""
    e = table(spark, sf, "events").select("event_id", F.to_date("ts").alias("day"), "value")
    old = e.where("event_id % 5 <> 0")
    newest = old.agg(F.max("day").alias("newest"))
    seen = e.withColumn("value", F.when(F.col("event_id") % 7 == 0, F.col("value") + 1).otherwise(F.col("value")))  # what a new crawl brings
    fresh = seen.crossJoin(F.broadcast(newest)).where(F.col("day") > F.date_sub("newest", 10)).drop("newest")  # one row
    got = files.upsert(old, sinks.changed_rows(old, fresh, ["event_id"], ["value"]), ["event_id"])
    return got.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'final' ELSE 'provisional' END AS source, CASE WHEN event_id % 3 = 0 THEN value ELSE value * 0.9 END AS value FROM events")
def provisional_replaced(spark, sf):
    """Final values replace provisional ones of the same key; a provisional one never replaces a final one."""
    e = table(spark, sf, "events")
    early = e.select("event_id", F.lit("provisional").alias("source"), (F.col("value") * 0.9).alias("value"))
    final = e.where("event_id % 3 = 0").select("event_id", F.lit("final").alias("source"), "value")
    stored = files.upsert(early, final, ["event_id"])
    again = early.join(stored.where("source = 'final'").select("event_id"), "event_id", "left_anti")
    return files.upsert(stored, again, ["event_id"])


@query("SELECT user_id, count(*) AS n, round(max(value), 6) AS best FROM events WHERE CAST(ts AS DATE) > (SELECT max(CAST(ts AS DATE)) FROM events) - INTERVAL 7 DAY GROUP BY user_id")
def last_days(spark, sf):
    """The last seven days, counted from the newest date there is."""
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    newest = e.agg(F.max("day").alias("newest"))
    return e.crossJoin(F.broadcast(newest)).where(F.col("day") > F.date_sub("newest", 7)).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.max("value"), 6).alias("best"))  # one row


@query("SELECT event_type, 'skipped' AS action FROM events WHERE event_type <> 'click' GROUP BY event_type UNION ALL SELECT 'click', 'rebuilt'")
def rebuild_by_fingerprint(spark, sf):
    """Groups whose count, largest id or rounded sum changed since the stored run are rebuilt, the others skipped."""
    from ..operators import aggregates as agg

    e, path = table(spark, sf, "events"), _folder(spark)
    print_of = lambda df: agg.fingerprint(df, ["event_type"], "event_id", "value").select("event_type", F.sha2(F.concat_ws("|", "n", "max_key", "total"), 256).alias("sig"))
    print_of(e).write.parquet(path)
    now = e.withColumn("value", F.when(F.col("event_type") == "click", F.col("value") + 1).otherwise(F.col("value")))
    stale = sinks.stale_keys(print_of(now), spark.read.parquet(path), ["event_type"])
    return e.select("event_type").distinct().join(stale, "event_type", "left").select("event_type", F.when(F.col("what").isNull(), "skipped").otherwise("rebuilt").alias("action"))


@query("""WITH d AS (SELECT *, time_bucket(INTERVAL 1 DAY, ts) AS day, max(ts) OVER () AS newest, row_number() OVER (ORDER BY ts DESC, event_id) = 1 AS first FROM events)
SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS n FROM d WHERE event_id % 2 = 1 OR first OR day + INTERVAL 1 DAY > newest - INTERVAL 20 DAY GROUP BY day""")
def stream_late_rows_dropped(spark, sf):
    """Two deliveries of the events as files: the second, the even ids, comes after the watermark has passed all but the last twenty days; what lies
    before it is dropped, what lies after it is counted in."""
    folder = _folder(spark)
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    newest = e.orderBy(F.desc("ts"), "event_id").limit(1)
    counted = lambda: streams.daily_counts(spark.readStream.schema(e.schema).parquet(f"{folder}/in"), "20 days")
    e.where("event_id % 2 = 1").union(newest.where("event_id % 2 = 0")).coalesce(1).write.parquet(f"{folder}/in")
    streams.drain_updates(counted(), f"{folder}/run")
    e.where("event_id % 2 = 0").join(F.broadcast(newest.select("event_id")), "event_id", "left_anti").select(*e.columns).coalesce(1).write.mode("append").parquet(f"{folder}/in")  # one row
    streams.drain_updates(counted(), f"{folder}/run")
    # the last update of each window is its count
    got = spark.read.parquet(f"{folder}/run/out").groupBy("window").agg(F.max_by("n", "batch").alias("n"))
    return got.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n")


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS s FROM events), n AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM o) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM n GROUP BY user_id, g""")
def stream_sessions(spark, sf):
    folder = _folder(spark)
    streams.drain(streams.sessions(_stream(spark, sf), "6 hours", "1 hour"), folder, "complete")
    return spark.read.parquet(f"{folder}/out").select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm").alias("start"), "n")


@query("SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) - CAST((isodow(o_orderdate) + 2) % 7 AS INTEGER), '%Y-%m-%d') AS friday FROM orders")
def snapshot_fridays(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.date_format(times.week_key(F.to_date("o_orderdate")), "yyyy-MM-dd").alias("friday"))


@query("WITH k AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) SELECT c_custkey, CASE WHEN k <= 3 THEN 'done' WHEN k <= 6 THEN 'claimed' ELSE 'pending' END AS state, CASE WHEN k <= 3 THEN 'a' WHEN k <= 6 THEN 'b' END AS worker FROM k")
def leased_claims(spark, sf):
    """Two workers claim three rows of each segment in turn by versions with leases; the first finishes its rows."""
    queue = sinks.ClaimQueue(spark, _folder(spark))
    queue.fill(table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", F.lit("pending").alias("state")))
    best = [F.desc("c_acctbal"), F.col("c_custkey")]
    mine = queue.claim("a", best, ["c_mktsegment"], 3, now=0.0, lease=600.0)
    queue.claim("b", best, ["c_mktsegment"], 3, now=1.0, lease=600.0)
    return queue.done(mine.first()["token"]).select("c_custkey", "state", "worker")


@query("WITH s AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events WHERE value IS NOT NULL), p AS (SELECT user_id, unnest(range(1, 9)) AS k FROM (SELECT DISTINCT user_id FROM events)) SELECT p.user_id, CAST(9 - p.k AS INTEGER) AS step, round(coalesce(value, -1), 6) AS value, CASE WHEN value IS NULL THEN 0 ELSE 1 END AS mask FROM p LEFT JOIN s ON s.k = p.k AND s.user_id IS NOT DISTINCT FROM p.user_id")
def padded_sequences(spark, sf):
    """Every user's last eight values as one shape, written as chunks of users and read back."""
    e = table(spark, sf, "events")
    seq = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("event_id", "value")))), lambda s: s["value"]).alias("seq"))  # one user's events
    path = _folder(spark)
    sinks.padded(seq, "seq", 8, -1.0).write.option("maxRecordsPerFile", 64).parquet(path)
    steps = spark.read.parquet(path).select("user_id", F.posexplode(F.arrays_zip("seq", "mask")).alias("i", "s"))
    return steps.select("user_id", (F.col("i") + 1).alias("step"), F.round("s.seq", 6).alias("value"), F.col("s.mask").alias("mask"))
