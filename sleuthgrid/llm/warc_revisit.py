"""Not-modified revisits of a web archive, resolved to the full response they stand for.

A revisit says that a page was as before. It is joined, by canonical URL, to
the latest full response captured earlier; if the validators of both agree, its
record is that response's body under the response's headers, of which those
that a not-modified answer may carry are replaced by its own.

The timeline is cut into slices. The latest response is looked for inside the
revisit's slice, and else taken from the last slice before it that has one, so
that a URL with a large share of all captures is never in one task whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import order_bounds, partitions

#: Headers that a 304 answer may update (RFC 9110, 15.4.5, and validators).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that don't choose a page, as a pattern of whole names.
TRACKING = "(utm_[a-z0-9_]*|ref|fbclid|gclid|sessionid)"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www and default port, path without a last slash, other parameters in order; no scheme, fragment or tracking."""
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(plain, "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?([^/?]*)", 1)), "^www\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(plain, "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(plain, "\\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~F.lower(x).rlike(f"^{TRACKING}(=.*)?$")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _validator(etag: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(etag), "^W/", ""), '"', "")


def _lower_names(headers: Column) -> Column:
    """Headers with names in lower case; of names that differ by case alone, the first counts."""
    rows = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.transform(rows, lambda e: e["key"])
    return F.map_from_entries(F.filter(rows, lambda e, i: F.array_position(names, e["key"]) == i + 1))


def resolve(captures: DataFrame) -> DataFrame:
    """One row for each revisit of captures (capture_id, url, ts timestamp or long, kind, status, headers map).

    Columns: capture_id, url_key, ts, response_id, outcome, headers. outcome is
    ``resolved``, ``no_response`` (none earlier) or ``changed`` (the validators
    differ). Validators agree if both have an etag and the tags are equal but
    for weakness, or, if one lacks it, both have a last-modified and those are
    equal. A response is full if its status is 200; one at the same time is not
    earlier; of responses of one time the greatest id counts. Header names
    compare without case; of names that differ by case alone the first counts.
    Other columns are ignored. A null url, ts or kind: a revisit has no response,
    and a response answers none. headers is null unless resolved.
    """
    moment = F.col("ts").cast("double") * 1e6 if dict(captures.dtypes)["ts"].startswith("timestamp") else F.col("ts")
    base = captures.select("capture_id", canonical_url(F.col("url")).alias("url_key"), moment.cast("long").alias("at"), F.col("ts"), "kind", "status", _lower_names(F.col("headers")).alias("headers"))
    bounds = order_bounds(base, "at", partitions(captures.sparkSession))
    cuts = F.array(*[F.lit(x).cast("long") for x in bounds]) if bounds else F.array().cast("array<bigint>")
    base = base.withColumn("slice", F.size(F.filter(cuts, lambda x: x <= F.col("at"))))
    answer = F.struct(F.col("capture_id").alias("id"), "headers")
    full = base.filter((F.col("kind") == "response") & (F.col("status") == 200) & F.col("at").isNotNull() & F.col("url_key").isNotNull())
    full = full.groupBy("url_key", "slice", "at").agg(F.max_by(answer, "capture_id").alias("answer"))
    # the last response of each slice, carried on to the slices after it that have rows
    ends = full.groupBy("url_key", "slice").agg(F.max_by("answer", "at").alias("last"))
    revisits = base.filter(F.col("kind") == "revisit")
    asked = revisits.select("url_key", "slice").distinct().join(ends, ["url_key", "slice"], "full")
    before = Window.partitionBy("url_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = asked.select("url_key", "slice", F.last("last", ignorenulls=True).over(before).alias("carried")).filter("carried is not null")
    timeline = revisits.select("url_key", "slice", "at", "capture_id", "ts", F.col("headers").alias("own"), F.lit(None).cast(full.schema["answer"].dataType).alias("answer"), F.lit(True).alias("asks"))
    timeline = timeline.unionByName(full.withColumn("asks", F.lit(False)), allowMissingColumns=True)
    earlier = Window.partitionBy("url_key", "slice").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    near = timeline.withColumn("near", F.last("answer", ignorenulls=True).over(earlier)).filter("asks")
    found = near.join(carried, ["url_key", "slice"], "left").withColumn("found", F.when(F.col("at").isNotNull(), F.coalesce("near", "carried")))
    old, new = F.col("found.headers"), F.col("own")
    tags = _validator(old["etag"]), _validator(new["etag"])
    agree = F.coalesce(tags[0] == tags[1], old["last-modified"] == new["last-modified"], F.lit(False))
    outcome = F.when(F.col("found").isNull(), "no_response").when(agree, "resolved").otherwise("changed")
    newer = F.map_filter(F.coalesce(new, F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(newer), k))
    merged = F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(kept, newer))))
    return found.select("capture_id", "url_key", "ts", F.col("found.id").alias("response_id"), outcome.alias("outcome"), F.when(outcome == "resolved", merged).alias("headers"))


def captures_of(pages: DataFrame) -> DataFrame:
    """A capture log of crawled pages: a full response for each page, and a revisit of its URL.

    Times are seconds. The revisit comes 5 s after the response, but 5 s before
    it for page ids divisible by 11, and asks with a stale tag for those
    divisible by 7 and by date alone for those divisible by 5.
    """
    at = F.col("page_id") * 10
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    date = F.concat(F.lit("day "), (F.col("page_id") % 28).cast("string"))
    headers = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), tag, F.lit("Last-Modified"), date, F.lit("Date"), at.cast("string"), F.lit("Content-Length"), F.length("html").cast("string"))
    later = F.when(F.col("page_id") % 11 == 0, at - 5).otherwise(at + 5)
    asked = F.when(F.col("page_id") % 7 == 0, F.lit('"stale"')).otherwise(F.concat(F.lit("W/"), tag))
    again = F.map_filter(F.create_map(F.lit("etag"), F.when(F.col("page_id") % 5 != 0, asked), F.lit("last-modified"), date, F.lit("date"), later.cast("string"), F.lit("Server"), F.lit("not permitted")), lambda _, v: v.isNotNull())
    first = pages.select((F.col("page_id") * 2).alias("capture_id"), "url", at.alias("ts"), F.lit("response").alias("kind"), F.lit(200).alias("status"), headers.alias("headers"))
    return first.unionByName(pages.select((F.col("page_id") * 2 + 1).alias("capture_id"), F.regexp_replace("url", "#.*$", "").alias("url"), later.alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), again.alias("headers")))


def query(pages: DataFrame) -> DataFrame:
    out = resolve(captures_of(pages.select("page_id", "url", "html")))
    shown = F.array_join(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")
    return out.select("capture_id", "url_key", "ts", "response_id", "outcome", shown.alias("headers"))


SQL = r"""
WITH p AS (
  SELECT page_id, html, page_id * 10 AS taken, regexp_replace(trim(url), '#.*$', '') AS u FROM pages
), k AS (
  SELECT page_id, html, taken,
    regexp_replace(regexp_replace(lower(regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '')
    || regexp_replace(regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?[^/?]*([^?]*)', 1), '/+$', '') AS front,
    list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[a-z0-9_]*|ref|fbclid|gclid|sessionid)(=.*)?$'))) AS params
  FROM p
), r AS (
  SELECT page_id, taken, front || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS url_key, md5(html) AS tag, 'day ' || (page_id % 28) AS day, length(html) AS size FROM k
), v AS (
  SELECT page_id, url_key, CASE WHEN page_id % 11 = 0 THEN taken - 5 ELSE taken + 5 END AS ts,
    CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 7 = 0 THEN 'stale' ELSE tag END AS tag, day FROM r
), j AS (
  SELECT v.page_id, v.url_key, v.ts, v.tag, v.day, arg_max(r, r.taken) AS f
  FROM v LEFT JOIN r ON r.url_key = v.url_key AND r.taken < v.ts GROUP BY ALL
)
SELECT page_id * 2 + 1 AS capture_id, url_key, ts, f.page_id * 2 AS response_id,
  CASE WHEN f IS NULL THEN 'no_response' WHEN coalesce(tag = f.tag, day = f.day) THEN 'resolved' ELSE 'changed' END AS outcome,
  CASE WHEN f IS NOT NULL AND coalesce(tag = f.tag, day = f.day) THEN
    'content-length: ' || f.size || '; content-type: text/html; date: ' || ts || '; etag: '
    || CASE WHEN tag IS NULL THEN '"' || f.tag || '"' ELSE 'W/"' || tag || '"' END || '; last-modified: ' || day END AS headers
FROM j
"""
