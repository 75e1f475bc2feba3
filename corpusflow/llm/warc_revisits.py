"""WARC not-modified revisits resolved against the full responses before them.

A capture is a row (record_id, url, date, type, status, headers).  For each
revisit (``type = 'revisit'``) an as-of join by canonical URL finds the latest
earlier full response (``type = 'response'`` and status 200); of several with the
same date the one with the largest record_id; a response of the revisit's own
date counts as earlier only if its record_id is smaller.  Its validators are
checked: entity tags by weak comparison if both records have one, else
Last-Modified if both have one.  If they agree, the stored headers are merged
with those that a 304 may update (RFC 9110, section 15.4.5).

The as-of join is one window over the captures sorted by canonical URL and date:
one shuffle of keys and headers, never of payloads, which stay where
``resolved_record_id`` points.

verdict: ``resolved``; ``unvalidated`` (neither record shares a kind of validator
with the other; the response is named, nothing is merged); ``mismatch``;
``orphan`` (no earlier response); ``no_url`` (null or empty URL); ``no_date`` (null
date).  A null record_id sorts before others.  Header names are compared in lower
case; null headers are empty; an empty table gives an empty result.  Repeated rows are each resolved.  Extra columns are
not in the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm._common import picked

#: what a 304 may update in the stored response
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: Column) -> Column:
    """http(s) as one scheme, no ``www.`` or ``m.``, lower-case host, no fragment, no default port, sorted query without utm_ and ref, no trailing slash, ``.html`` or ``/index``."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), "^(www|m)\\.", "")
    path = F.regexp_extract(rest, "^[^/?]*([^?]*)", 1)
    path = F.regexp_replace(F.regexp_replace(path, "(\\.html?|/index)$", ""), "/+$", "")
    query = F.regexp_extract(rest, "\\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda q: (q != "") & ~q.rlike("^(utm_[a-z]*|ref)(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _lowered(headers: Column) -> Column:
    pairs = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    keys = F.array_distinct(F.transform(pairs, lambda e: e["key"]))
    last = F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(pairs, lambda e: e["key"] == k), -1)["value"].alias("value"))))
    return F.coalesce(last, F.create_map().cast("map<string,string>"))


def _strong(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^W/", "")


def resolve(captures: DataFrame, permitted: tuple[str, ...] = PERMITTED) -> DataFrame:
    """record_id, canonical, date, resolved_record_id, verdict and headers (a map) for each revisit."""
    c = picked(captures, "record_id", "url", "date", "type", "status", "headers").select("record_id", "url", "date", "type", "status", _lowered(F.col("headers")).alias("headers"))
    c = c.withColumn("canonical", canonical_url(F.col("url")))
    usable = (F.coalesce(F.col("canonical"), F.lit("")) != "") & F.col("date").isNotNull()
    full = F.coalesce((F.col("type") == "response") & (F.col("status") == 200), F.lit(False))
    revisit = F.coalesce(F.col("type") == "revisit", F.lit(False))
    c = c.filter(full | revisit).select("*", full.alias("is_full"), usable.alias("usable"))
    # rows without a key can't be matched: a window of their own each
    order = Window.partitionBy("canonical", F.when(~F.col("usable"), F.coalesce(F.xxhash64("record_id", "url", "date"), F.lit(0)))).orderBy(F.col("date").asc_nulls_first(), F.col("record_id").asc_nulls_first(), F.col("is_full").asc())
    source = F.when(F.col("is_full") & F.col("usable"), F.struct(F.col("record_id"), F.col("headers")))
    latest = F.last(source, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    out = c.withColumn("from", latest).filter(revisit)
    mine, theirs = F.col("headers"), F.col("from.headers")
    both = lambda k: mine[k].isNotNull() & theirs[k].isNotNull()
    agree = F.when(both("etag"), _strong(mine["etag"]) == _strong(theirs["etag"])).when(both("last-modified"), F.trim(mine["last-modified"]) == F.trim(theirs["last-modified"]))
    verdict = (
        F.when(F.coalesce(F.col("canonical"), F.lit("")) == "", "no_url").when(F.col("date").isNull(), "no_date").when(F.col("from").isNull(), "orphan").when(agree.isNull(), "unvalidated").when(agree, "resolved").otherwise("mismatch")
    )
    allowed = F.array(*[F.lit(p) for p in permitted])
    update = F.map_filter(mine, lambda k, v: F.array_contains(allowed, k))
    kept = F.map_filter(theirs, lambda k, v: ~F.array_contains(F.map_keys(update), k))
    out = out.withColumn("verdict", verdict)
    named = F.col("verdict").isin("resolved", "unvalidated", "mismatch")
    return out.select(
        "record_id", "canonical", "date",
        F.when(named, F.col("from.record_id")).alias("resolved_record_id"),
        "verdict",
        F.when(F.col("verdict") == "resolved", F.map_concat(kept, update)).alias("headers"),
    )


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """A capture log over the whole of pages, which has no WARC fields of its own.

    page_id is the time of capture in minutes.  A page whose id leaves 1 or 2 when
    divided by 3 answers not-modified.  A site's entity tag changes each 64 pages;
    pages divisible by 5 have none, and only a Last-Modified date.
    """
    epoch = F.floor(F.col("page_id") / 64).cast("string")
    revisit = F.pmod(F.col("page_id"), F.lit(3)) != 0
    tag = F.concat(F.lit('W/"'), F.substring(F.md5(F.concat(canonical_url(F.col("url")), F.lit("|"), epoch)), 1, 16), F.lit('"'))
    pid = F.col("page_id").cast("string")
    headers = F.map_filter(
        F.create_map(
            F.lit("ETag"), F.when(F.pmod(F.col("page_id"), F.lit(5)) != 0, tag),
            F.lit("Last-Modified"), F.concat(F.lit("epoch "), epoch),
            F.lit("Date"), F.concat(F.lit("minute "), pid),
            F.lit("Content-Type"), F.when(revisit, F.lit("text/plain")).otherwise(F.lit("text/html")),
            F.lit("Content-Length"), F.when(~revisit, F.length("html").cast("string")),
            F.lit("Cache-Control"), F.concat(F.lit("max-age="), pid),
        ),
        lambda k, v: v.isNotNull(),
    )
    return pages.select(
        F.col("page_id").alias("record_id"), "url", F.col("page_id").alias("date"),
        F.when(revisit, "revisit").otherwise("response").alias("type"),
        F.when(revisit, 304).otherwise(200).alias("status"),
        headers.alias("headers"),
    )
