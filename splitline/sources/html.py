"""Web pages as rows, by SQL functions: visible text, titles, links and ranked crawl candidates, linked data, bucket listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def page_text(html: Column) -> Column:
    """Visible text: scripts, styles, comments and tags out, entities of the basic kinds in, spaces squeezed."""
    t = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, position, href) of every link."""
    return pages.select(key, F.posexplode(F.expr(f"regexp_extract_all({html}, '<a\\\\s+href=\"([^\"]*)\"', 1)")).alias("position", "href"))


def absolute(url: Column, href: Column) -> Column:
    """``href`` resolved against its page's address; null for fragments and other schemes."""
    site = F.regexp_extract(url, r"^([a-z]+://[^/]+)", 1)
    folder = F.regexp_replace(url, r"[^/]*$", "")
    return (
        F.when(href.rlike("^https?://"), href).when(href.startswith("//"), F.concat(F.regexp_extract(url, "^([a-z]+:)", 1), href)).when(href.startswith("/"), F.concat(site, href))
        .when(href.rlike("^(#|[a-z]+:)") | (href == ""), None).otherwise(F.concat(folder, href))
    )


def candidates(pages: DataFrame, key: str, url: str, html: str, wanted: str) -> DataFrame:
    """(key, target, score, rank): a page's distinct link targets, best first: 2 for a target that matches ``wanted``, 1 for one on the page's own host; ties by address."""
    found = links(pages.select(key, url, html), key, html).join(pages.select(key, url), key)
    host = lambda c: F.regexp_extract(c, r"^[a-z]+://([^/]+)", 1)
    target = found.select(key, url, absolute(F.col(url), F.col("href")).alias("target")).where("target IS NOT NULL").distinct()
    score = F.when(F.col("target").rlike(wanted), 2).otherwise(0) + F.when(host(F.col("target")) == host(F.col(url)), 1).otherwise(0)
    scored = target.select(key, "target", score.alias("score"))
    return scored.withColumn("rank", F.row_number().over(_best_first(key)).cast("long"))  # one page's links, which its length bounds


def _best_first(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(F.desc("score"), "target")


def linked_data(html: Column) -> Column:
    """JSON texts of a page's linked-data scripts."""
    return F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), F.lit(1))


def listing(xml: Column) -> Column:
    """(key, size) structs of an XML bucket listing."""
    entries = F.regexp_extract_all(xml, F.lit(r"(?s)<Contents>(.*?)</Contents>"), F.lit(1))
    part = lambda e, tag: F.regexp_extract(e, f"<{tag}>([^<]*)</{tag}>", 1)
    return F.transform(entries, lambda e: F.struct(part(e, "Key").alias("key"), part(e, "Size").try_cast("long").alias("size")))


def keyed_entries(page: Column) -> Column:
    """(key, value) structs of a JSON page that is either an object or a list: a list's keys are its places, its nulls are skipped."""
    as_map, as_list = F.from_json(page, "map<string,string>"), F.from_json(page, "array<string>")
    of_list = F.filter(F.transform(as_list, lambda v, i: F.when(v.isNotNull(), F.struct(i.cast("string").alias("key"), v.alias("value")))), lambda e: e.isNotNull())
    of_map = F.filter(F.transform(F.map_entries(as_map), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))), lambda e: e["value"].isNotNull())
    return F.when(F.trim(page).startswith("["), of_list).otherwise(of_map)
