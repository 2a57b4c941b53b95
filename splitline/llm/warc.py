"""Not-modified revisit resolution over WARC capture records.

``resolve_revisits(records)`` takes one row per capture: record_id long, url
string, ts long, kind ('response' or 'revisit'), etag, last_modified, digest
strings and headers map<string,string>. Each revisit is joined as-of to the
latest strictly earlier full response with the same canonical URL (ties in time
go to the larger record_id), its validators are checked, and the headers that a
304 answer may update replace those of the stored response.

Skew: records are range-partitioned by URL and time into buckets of about
``bucket_rows`` rows, so that a hot URL is cut along its time. The as-of runs
within (url, bucket) first; then one row per bucket, the bucket's last response,
is carried forward over the URL's buckets. Everything is DataFrame functions.

Defined cases: rows with a null url, ts or kind take no part; status is
'no_response' where no earlier response exists, 'digest_mismatch' or
'validator_mismatch' where a validator both sides give differs, 'unverified'
where no validator is common, else 'resolved'; null header maps count as empty;
null headers stay null; repeated records each resolve; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialize, parts_for

#: Headers that a 304 answer updates in the stored response (RFC 9110, 15.4.5), lower case.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]


def canonical_url(url: Column) -> Column:
    """The address without what doesn't tell pages apart: scheme, user, fragment, default port, www. or m., host case, case of
    percent escapes, tracking parameters, order of parameters, trailing slash, .html or index page."""
    escapes = F.transform(F.split(url, "%"), lambda p, i: F.when((i > 0) & p.rlike("^[0-9A-Fa-f]{2}"), F.concat(F.upper(F.substring(p, 1, 2)), F.substr(p, F.lit(3)))).otherwise(p))
    u = F.regexp_replace(F.array_join(escapes, "%"), r"#.*$", "")
    u = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, r"^([^/?]*)", 1)), r"^.*@|:(80|443)?$", ""), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(u, r"^[^/?]*([^?]*)", 1), r"(/index)?\.html?$|/+$", "")
    own = F.filter(F.split(F.regexp_extract(u, r"\?(.*)$", 1), "&"), lambda x: (x != "") & ~x.rlike(r"^(utm_[a-z]+|ref)="))
    query = F.array_join(F.array_sort(own), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def merge_headers(stored: Column, fresh: Column) -> Column:
    """The stored response's headers, updated by the permitted ones of the 304 answer."""
    stored, fresh = (F.coalesce(m, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))) for m in (stored, fresh))
    allowed = F.map_filter(fresh, lambda k, _: F.lower(k).isin(PERMITTED))
    names = F.transform(F.map_keys(allowed), lambda k: F.lower(k))
    kept = F.map_filter(stored, lambda k, _: ~F.array_contains(names, F.lower(k)))
    return F.map_concat(kept, allowed)


def resolve_revisits(records: DataFrame, bucket_rows: int = 500_000) -> DataFrame:
    """record_id, canonical_url, ts, response_id, response_ts, status, headers: one row per revisit. ``bucket_rows``: about the rows of a bucket."""
    known = records.where(F.col("url").isNotNull() & F.col("ts").isNotNull() & F.col("kind").isin("response", "revisit")).select(
        "record_id", canonical_url(F.col("url")).alias("canonical_url"), "ts", (F.col("kind") == "response").alias("full"),
        F.struct("record_id", "ts", "etag", "last_modified", "digest", "headers").alias("rec"),
    )
    # a response at the revisit's own time comes after it
    order = [F.col("ts"), F.col("full").cast("int"), F.col("record_id")]
    # written once, so that every use below sees the same buckets
    laid = known.repartitionByRange(parts_for(records.sparkSession, known.count(), bucket_rows), "canonical_url", *order)
    r = materialize(laid.withColumn("bucket", F.spark_partition_id()), "captures")
    inside = Window.partitionBy("canonical_url", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    near = r.withColumn("own", F.last(F.when(F.col("full"), F.col("rec")), True).over(inside)).where(~F.col("full"))
    heads = r.where("full").groupBy("canonical_url", "bucket").agg(F.max_by("rec", F.struct("ts", "record_id")).alias("head"))
    wanted = near.where(F.col("own").isNull()).select("canonical_url", "bucket").distinct()
    carried = heads.select("canonical_url", "bucket", "head").unionByName(wanted.select("canonical_url", "bucket", F.lit(None).cast(heads.schema["head"].dataType).alias("head")))
    carried = carried.groupBy("canonical_url", "bucket").agg(F.max_by("head", F.struct("head.ts", "head.record_id")).alias("head"))
    before = Window.partitionBy("canonical_url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.withColumn("earlier", F.last("head", True).over(before)).select("canonical_url", "bucket", "earlier")
    got = near.join(carried, ["canonical_url", "bucket"], "left").withColumn("resp", F.coalesce("own", "earlier"))
    differs = lambda name: F.coalesce(F.col(f"rec.{name}") != F.col(f"resp.{name}"), F.lit(False))
    shared = lambda name: F.col(f"rec.{name}").isNotNull() & F.col(f"resp.{name}").isNotNull()
    status = (
        F.when(F.col("resp").isNull(), "no_response")
        .when(differs("digest"), "digest_mismatch")
        .when(differs("etag") | (~shared("etag") & differs("last_modified")), "validator_mismatch")
        .when(~(shared("digest") | shared("etag") | shared("last_modified")), "unverified")
        .otherwise("resolved")
    )
    return got.select(
        F.col("record_id"), "canonical_url", "ts", F.col("resp.record_id").alias("response_id"), F.col("resp.ts").alias("response_ts"), status.alias("status"),
        F.when(status.isin("resolved", "unverified"), merge_headers(F.col("resp.headers"), F.col("rec.headers"))).alias("headers"),
    )


def crawl_records(pages: DataFrame, later: int = 1_000) -> DataFrame:
    """The records of a crawl of ``pages``: each page is captured in full at ts = page_id and asked again ``later`` ticks on.

    Both records carry the validators that the page's server gives: an ETag (not for page_id % 4 = 1), a payload digest
    (even page_id only) and a Last-Modified (not for page_id % 8 = 5). Record ids are 2 * page_id (response) and
    2 * page_id + 1 (revisit). Rows without page_id are left out.
    """
    html, n = F.coalesce("html", F.lit("")), F.col("page_id")
    p = pages.where(n.isNotNull()).select(
        "page_id", "url", F.length(html).cast("string").alias("size"), F.when(F.pmod(n, F.lit(4)) != 1, F.md5(html.cast("binary"))).alias("etag"),
        F.when(F.pmod(n, F.lit(2)) == 0, F.concat(F.lit("sha256:"), F.sha2(html.cast("binary"), 256))).alias("digest"),
        F.when(F.pmod(n, F.lit(8)) != 5, F.concat(F.lit("size "), F.length(html).cast("string"))).alias("last_modified"),
    )
    both = p.select(
        "url", "etag", "digest", "last_modified",
        F.explode(F.array(
            F.struct((F.col("page_id") * 2).alias("record_id"), F.col("page_id").alias("ts"), F.lit("response").alias("kind"), F.create_map(F.lit("Content-Length"), F.col("size"), F.lit("ETag"), F.coalesce("etag", F.lit("none")), F.lit("Date"), F.col("page_id").cast("string")).alias("headers")),
            F.struct((F.col("page_id") * 2 + 1).alias("record_id"), (F.col("page_id") + later).alias("ts"), F.lit("revisit").alias("kind"), F.create_map(F.lit("Date"), (F.col("page_id") + later).cast("string"), F.lit("Set-Cookie"), F.lit("s=1")).alias("headers")),
        )).alias("c"),
    )
    return both.select("c.record_id", "url", "c.ts", "c.kind", "etag", "last_modified", "digest", "c.headers")


def revisit_report(pages: DataFrame) -> DataFrame:
    """The resolved revisits of :func:`crawl_records`, headers as sorted text."""
    found = resolve_revisits(crawl_records(pages))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(F.lower(e["key"]), F.lit(":"), e["value"])), ";")
    return found.select("record_id", "canonical_url", "response_id", "response_ts", "status", text.alias("headers"))


ORACLE = r"""
WITH p AS (
  SELECT page_id, length(coalesce(html, '')) AS size, CASE WHEN page_id % 4 <> 1 THEN md5(coalesce(html, '')) END AS etag,
         CASE WHEN page_id % 2 = 0 THEN 'sha256:' || sha256(coalesce(html, '')) END AS digest, CASE WHEN page_id % 8 <> 5 THEN 'size ' || length(coalesce(html, '')) END AS lm,
         regexp_replace(regexp_replace(array_to_string(list_transform(string_split(url, '%'), lambda x, i: CASE WHEN i > 1 AND regexp_matches(x, '^[0-9A-Fa-f]{2}') THEN upper(x[1:2]) || x[3:] ELSE x END), '%'),
           '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u
  FROM pages WHERE page_id IS NOT NULL AND url IS NOT NULL),
q AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), '^.*@|:(80|443)?$', '', 'g'), '^(www|m)\.', '')
         || regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '(/index)?\.html?$|/+$', '') AS hp,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref)='))), '&') AS qs
  FROM p),
c AS (SELECT page_id, etag, digest, lm, size, hp || CASE WHEN qs <> '' THEN '?' || qs ELSE '' END AS canonical_url FROM q),
m AS (
  SELECT v.*, r.page_id AS rid, r.etag AS retag, r.digest AS rdigest, r.lm AS rlm, r.size AS rsize,
         row_number() OVER (PARTITION BY v.page_id ORDER BY r.page_id DESC) AS k
  FROM c v JOIN c r ON r.canonical_url = v.canonical_url AND r.page_id < v.page_id + 1000),
s AS (
  SELECT *, CASE WHEN digest <> rdigest THEN 'digest_mismatch' WHEN etag <> retag OR ((etag IS NULL OR retag IS NULL) AND lm <> rlm) THEN 'validator_mismatch'
    WHEN (digest IS NULL OR rdigest IS NULL) AND (etag IS NULL OR retag IS NULL) AND (lm IS NULL OR rlm IS NULL) THEN 'unverified' ELSE 'resolved' END AS status
  FROM m WHERE k = 1)
SELECT page_id * 2 + 1 AS record_id, canonical_url, rid * 2 AS response_id, rid AS response_ts, status,
       CASE WHEN status IN ('resolved', 'unverified') THEN 'content-length:' || rsize || ';date:' || (page_id + 1000) || ';etag:' || coalesce(retag, 'none') END AS headers
FROM s
"""
